"""A Brown class-based bigram language model.

Exchange clustering gives every counted word a class, in three steps of growing
size.  The most frequent words are exchanged one by one over their full bigram
counts.  The next ones move, round by round, to the class that their counts
with those classes on either side make most likely.  All other words stay
distributed: their counts after the classes found so far are aggregated by
Spark, and tasks give each the class that the same criterion prefers.

The probability of a token is P(class | state of the word before) * P(word |
class).  A word's state is its class, the one state "rare" for words that are
not among the ``history_words`` most frequent.  Words that the training texts
lack go to the class that has the most words.

All counts cover all training rows.  What the driver and tasks hold is bounded
by parameters (clustered, history and lookup words, classes); counts and classes
of the many other words meet the texts' rare words in a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_or_lowest, materialize, null_id, prepare, text_or_empty

#: The end of a text among the words: no word is empty.
END = b""
CLUSTER_WORDS, HISTORY_WORDS, LOOKUP_WORDS, CLASSES, ROUNDS = 1000, 20_000, 100_000, 32, 8
#: Rows of a batch that are encoded at once.
_ROWS = 512


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: what bytes methods do."""
    return text.encode().lower().split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"]
        )

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column("_text"):
            counts.update(words_of(text.as_py()))
            counts[END] += 1
            if len(counts) > 300_000:
                yield out(counts)
                counts = Counter()
    if counts:
        yield out(counts)


class _Ranks(dict):
    """Word to its rank from 1 on, the end to 0, all others to the last number."""

    def __init__(self, words: list[bytes]):
        super().__init__({w: i + 1 for i, w in enumerate(words)})
        self[END] = 0
        self.rest = len(words) + 1

    def __missing__(self, word: bytes) -> int:
        return self.rest


def _encoded(texts: list[str], ranks: _Ranks) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The tokens of all texts, each with its end; their ranks; the ends' places."""
    line: list[bytes] = []
    ends = []
    for text in texts:
        line += words_of(text)
        line.append(END)
        ends.append(len(line))
    return line, np.fromiter(map(ranks.__getitem__, line), np.int64, len(line)), np.array(ends, np.int64) - 1


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _cells(table: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(table)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(table[at], pa.int64())], names=["cell", "n"])


def _count_pairs(words: list[bytes]):
    """Bigram counts of the words, the end and all other words as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _Ranks(words)
        size = ranks.rest + 1
        table = np.zeros(size * size, np.int64)
        for part in _slices(batches):
            _, line, _ = _encoded(part.column("_text").to_pylist(), ranks)
            table += np.bincount(np.append(0, line[:-1]) * size + line, minlength=size * size)
        yield _cells(table)

    return run


def _count_sides(words: list[bytes], state: np.ndarray, states: int):
    """Counts of each word with the state on its left, and on its right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _Ranks(words)
        size = (ranks.rest + 1) * 2 * states
        table = np.zeros(size, np.int64)
        for part in _slices(batches):
            _, line, _ = _encoded(part.column("_text").to_pylist(), ranks)
            near = state[line]
            table += np.bincount(line * 2 * states + np.append(0, near[:-1]), minlength=size)
            table += np.bincount(line * 2 * states + states + np.append(near[1:], 0), minlength=size)
        yield _cells(table)

    return run


def _collected(rows: DataFrame, size: int) -> np.ndarray:
    """Summed cells as one array: ``size`` numbers at most come to the driver."""
    table = np.zeros(size)
    for batch in rows.groupBy("cell").agg(F.sum("n").alias("n")).toArrow().to_batches():
        table[batch.column("cell").to_numpy()] = batch.column("n").to_numpy()
    return table


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange_clusters(pairs: np.ndarray, classes: int, rounds: int, fixed: dict[int, int] | None = None) -> np.ndarray:
    """Class of each unit.  ``pairs[u, v]`` counts v after u; ``fixed`` units
    (unit 0 in class 0) have their classes for themselves.  Units move one by
    one, most frequent first, to the class that makes the likelihood of the
    class bigrams largest."""
    fixed = {0: 0} if fixed is None else fixed
    size, own_only = len(pairs), sorted(fixed.values())
    free = [c for c in range(classes) if c not in own_only]
    order = [u for u in np.argsort(-(pairs.sum(0) + pairs.sum(1)), kind="stable") if u not in fixed]
    member = np.zeros(size, dtype=np.int64)
    for u, c in fixed.items():
        member[u] = c
    for i, u in enumerate(order):
        member[u] = free[i % len(free)]
    table = np.zeros((classes, classes))
    np.add.at(table, (member[:, None], member[None, :]), pairs)
    for _ in range(rounds):
        moved = 0
        for u in order:
            after = np.bincount(member, pairs[u], classes)  # of u's followers
            before = np.bincount(member, pairs[:, u], classes)
            own = pairs[u, u]
            a = member[u]
            after[a] -= own
            before[a] -= own
            table[a] -= after
            table[:, a] -= before
            table[a, a] -= own
            rows, cols = table.sum(1), table.sum(0)
            gain = (_plogp(table + after) - _plogp(table)).sum(1) + (_plogp(table.T + before) - _plogp(table.T)).sum(1)
            # The cell of a class with itself gets both sides and u's own pairs.
            d = np.diag(table)
            gain += _plogp(d + after + before + own) + _plogp(d) - _plogp(d + after) - _plogp(d + before)
            out, into = after.sum() + own, before.sum() + own
            gain -= _plogp(rows + out) - _plogp(rows) + _plogp(cols + into) - _plogp(cols)
            gain[own_only] = -np.inf
            b = int(gain.argmax()) if gain[a] < gain.max() - 1e-9 else a
            table[b] += after
            table[:, b] += before
            table[b, b] += own
            member[u] = b
            moved += b != a
        if not moved:
            break
    return member


def side_preferences(sides: np.ndarray, member: np.ndarray, classes: int) -> np.ndarray:
    """What one count with a state adds to the likelihood of each class:
    ``sides[w, s]`` are the counts of words, ``member`` their classes."""
    table = np.zeros((classes, sides.shape[1]))
    np.add.at(table, member, sides)
    table += 0.5
    share = np.log(table / table.sum(1, keepdims=True)).T
    share[:, 0] = -np.inf  # the end's own class
    return share


def exchange_sides(sides: np.ndarray, member: np.ndarray, held: int, classes: int, rounds: int) -> np.ndarray:
    """Classes of words by their counts with given states.  The first ``held``
    words keep theirs; the others move together, round by round."""
    known = sides[:held], member[:held]
    member = member.copy()
    for _ in range(rounds):
        prefer = side_preferences(*known, classes)
        best = np.where(np.isinf(prefer), -1e18, prefer)
        moved = (sides[held:] @ best).argmax(axis=1)
        same = len(known[1]) == len(member) and (moved == member[held:]).all()
        member[held:] = moved
        known = sides, member
        if same:
            break
    return member


@dataclass
class BrownModel:
    """``lookup`` are the most frequent words, the first ``history`` of them with
    a state of their own; by rank (the end is 0) ``counts`` and ``member``, their
    classes.  ``moves[s, c]`` counts tokens of a class after a state;
    ``assigned (word, n, class)``, of all words that are no history words,
    stays distributed.  ``unseen`` is the class of words that were not counted."""

    lookup: list[bytes]
    history: int
    counts: np.ndarray
    member: np.ndarray
    moves: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    unseen: int
    tokens: int
    distinct: int
    assigned: DataFrame = field(repr=False)

    @property
    def states(self) -> np.ndarray:
        """State by rank; the last one is "rare"."""
        rare = len(self.moves) - 1
        out = np.full(len(self.lookup) + 2, rare, np.int64)
        out[: self.history + 1] = self.member[: self.history + 1]
        return out

    @property
    def log_move(self) -> np.ndarray:
        """log10 P(class | state), with Witten-Bell weights of the class distribution."""
        moves = self.moves
        base = (moves.sum(0) + 1) / (moves.sum() + moves.shape[1])
        kinds = (moves > 0).sum(1) + 1.0
        weight = moves.sum(1, keepdims=True) / (moves.sum(1) + kinds)[:, None]
        own = moves / np.maximum(moves.sum(1, keepdims=True), 1)
        return np.log10(weight * own + (1 - weight) * base)

    @property
    def log_size(self) -> np.ndarray:
        """log10 of what a class's counts, each one more, sum up to; the class of
        unseen words has one word more."""
        more = np.arange(len(self.class_words)) == self.unseen
        return np.log10(np.maximum(self.class_tokens + self.class_words + more, 1))


def train_brown(
    df: DataFrame,
    text_col: str = "text",
    cluster_words: int = CLUSTER_WORDS,
    history_words: int = HISTORY_WORDS,
    lookup_words: int = LOOKUP_WORDS,
    classes: int = CLASSES,
    rounds: int = ROUNDS,
) -> BrownModel:
    """Train on all rows of ``df``; a null text counts as empty (its end only).

    ``cluster_words <= history_words <= lookup_words`` bound what the driver
    holds; class 0 is the end's."""
    prepare(df.sparkSession)
    rows = df.select(text_or_empty(text_col).alias("_text"))
    counts = rows.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "word_counts")
    tokens, distinct, ends = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("n"))), F.lit(0))
    ).first()
    top = counts.where(F.length("word") > 0).orderBy(F.col("n").desc(), "word").limit(lookup_words).collect()
    lookup = [bytes(r["word"]) for r in top]
    n = np.array([ends, *(r["n"] for r in top)], dtype=np.float64)
    rare, states = classes, classes + 1

    first = lookup[:cluster_words]
    size = len(first) + 2
    pairs = _collected(rows.mapInArrow(_count_pairs(first), "cell long, n long"), size * size).reshape(size, size)
    member = exchange_clusters(pairs, states, rounds, {0: 0, size - 1: rare})

    # All other words, and later those without a state, stand in the last place.
    known = lookup[:history_words]
    state = np.full(len(known) + 2, rare, np.int64)
    state[: len(first) + 1] = member[:-1]
    if len(known) > len(first):
        found = rows.mapInArrow(_count_sides(known, state, states), "cell long, n long")
        sides = _collected(found, len(state) * 2 * states).reshape(len(state), 2, states)
        sides = sides[1:-1].reshape(len(known), 2 * states)
        state[1:-1] = exchange_sides(sides, state[1:-1], len(first), classes, rounds)

    spark = df.sparkSession
    rest = rows.mapInArrow(_count_after(known, state, states, classes), "word binary, cell int, n long")
    rest = materialize(rest, "counts_after")
    moves = np.zeros(states * classes)
    for r in rest.where("word IS NULL").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        moves[r["cell"]] = r["n"]
    moves = moves.reshape(states, classes)
    prefer = np.log((moves + 0.5) / (moves + 0.5).sum(0))
    prefer[:, 0] = -1e18
    shared = spark.sparkContext.broadcast(prefer)
    dealt = rest.where("word IS NOT NULL").repartition("word").sortWithinPartitions("word")
    assigned = dealt.mapInArrow(_assign(shared), "word binary, class int, cell int, n long")
    assigned = materialize(assigned, "word_classes")
    for r in assigned.where("word IS NULL").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        moves.reshape(-1)[r["cell"]] += r["n"]
    assigned = assigned.where("word IS NOT NULL").select("word", "n", "class")

    class_tokens, class_words = np.zeros(classes), np.zeros(classes)
    for r in assigned.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect():
        class_tokens[r["class"]], class_words[r["class"]] = r["n"], r["k"]
    np.add.at(class_tokens, state[:-1], n[: len(known) + 1])
    np.add.at(class_words, state[:-1], n[: len(known) + 1] > 0)

    member = np.zeros(len(lookup) + 1, np.int64)
    member[: len(known) + 1] = state[:-1]
    if len(lookup) > len(known):
        others = {w: i + 1 for i, w in enumerate(lookup) if i >= len(known)}
        asked = spark.createDataFrame([(w,) for w in others], "word binary")  # lookup_words at most
        for r in assigned.join(F.broadcast(asked), "word").select("word", "class").collect():
            member[others[bytes(r["word"])]] = r["class"]
    unseen = int(class_words[1:].argmax()) + 1 if classes > 1 else 0
    return BrownModel(
        lookup, len(known), n, member, moves, class_tokens, class_words, unseen, int(tokens), int(distinct), assigned
    )


def _count_after(words: list[bytes], state: np.ndarray, states: int, classes: int):
    """Counts of each other word after each state, as ``(word, state, n)``, and of
    the words' own classes after each state, without a word and as cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, counts = _Ranks(words), Counter()
        moves = np.zeros(states * classes, np.int64)
        last = [bytes([s & 255, s >> 8]) for s in range(states)]

        def out(words: list, cells: list, n: list) -> pa.RecordBatch:
            cols = [pa.array(words, pa.binary()), pa.array(cells, pa.int32()), pa.array(n, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["word", "cell", "n"])

        def rest() -> pa.RecordBatch:
            cells = [k[-2] + 256 * k[-1] for k in counts]
            return out([k[:-2] for k in counts], cells, list(counts.values()))

        for part in _slices(batches):
            line, rank, _ = _encoded(part.column("_text").to_pylist(), ranks)
            before = np.append(0, state[rank[:-1]])
            own = rank < ranks.rest
            moves += np.bincount(before[own] * classes + state[rank[own]], minlength=states * classes)
            at = np.flatnonzero(~own)
            counts.update([line[i] + last[s] for i, s in zip(at.tolist(), before[at].tolist(), strict=True)])
            if len(counts) > 300_000:
                yield rest()
                counts = Counter()
        if counts:
            yield rest()
        at = np.flatnonzero(moves)
        yield out([None] * len(at), at.tolist(), moves[at].tolist())

    return run


def _assign(shared):
    """Rows ``(word, cell, n)`` sorted by word to ``(word, class, n)``; counts of
    classes after states, without a word and as cells, come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefer = shared.value
        states, classes = prefer.shape
        moves, held = np.zeros((states, classes), np.int64), None

        def told(word, table: np.ndarray) -> pa.RecordBatch:
            best = (table @ prefer).argmax(axis=1)
            for c in np.unique(best):
                moves[:, c] += table[best == c].sum(axis=0)
            cols = [word, pa.array(best, pa.int32()), pa.nulls(len(best), pa.int32()), pa.array(table.sum(axis=1), pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["word", "class", "cell", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column("word")
            fresh = np.append(True, pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False))
            row = np.cumsum(fresh) - 1
            table = np.zeros((row[-1] + 1) * states, np.int64)
            np.add.at(table, row * states + batch.column("cell").to_numpy(), batch.column("n").to_numpy())
            table, names = table.reshape(-1, states), word.take(pa.array(np.flatnonzero(fresh)))
            if held is not None and held[0].as_py() == names[0].as_py():
                table[0] += held[1]
            elif held is not None:
                yield told(pa.array([held[0].as_py()], pa.binary()), held[1][None])
            held = names[len(names) - 1], table[-1].copy()
            if len(names) > 1:
                yield told(names.slice(0, len(names) - 1), table[:-1])
        if held is not None:
            yield told(pa.array([held[0].as_py()], pa.binary()), held[1][None])
        at = np.flatnonzero(moves)
        cols = [pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(moves.reshape(-1)[at])]
        yield pa.RecordBatch.from_arrays(cols, names=["word", "class", "cell", "n"])

    return run


LOCAL = (
    "_id long, n_tokens long, _known long, _logs double, score double, "
    "_rare array<struct<word: binary, state: int, times: int>>"
)
_RARE = pa.list_(pa.struct([("word", pa.binary()), ("state", pa.int32()), ("times", pa.int32())]))


def _score_known(shared):
    """All of a text's score but for the words that the lookup does not hold,
    which are passed on with the state before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, counts, member, state, log_move, log_size = shared.value
        ranks = _Ranks(lookup)
        logs = np.append(np.log10(counts + 1), 0.0)
        emit = np.append(logs[:-1] - log_size[member], 0.0)
        member = np.append(member, 0)
        for part in _slices(batches):
            line, rank, ends = _encoded(part.column("_text").to_pylist(), ranks)
            before = np.append(0, state[rank[:-1]])
            known = rank < ranks.rest
            score = np.where(known, log_move[before, member[rank]] + emit[rank], 0.0)
            starts = np.append(0, ends[:-1] + 1)
            sums = [np.add.reduceat(x, starts) if len(starts) else x[:0] for x in (known & (logs[rank] > 0), logs[rank], score)]
            at = np.flatnonzero(~known)
            text = np.searchsorted(ends, at)
            rare: list[Counter] = [Counter() for _ in ends]
            for t, i, s in zip(text.tolist(), at.tolist(), before[at].tolist(), strict=True):
                rare[t][line[i], s] += 1
            words = [[{"word": w, "state": s, "times": k} for (w, s), k in own.items()] for own in rare]
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), pa.array(ends - starts + 1), pa.array(sums[0].astype(np.int64))]
                + [pa.array(sums[1]), pa.array(sums[2]), pa.array(words, _RARE)],
                names=["_id", "n_tokens", "_known", "_logs", "score", "_rare"],
            )

    return run


def score_brown(df: DataFrame, model: BrownModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    ``n_tokens`` counts the words and one end; ``base_score`` is the add-one
    unigram log10 probability, ``score`` the model's.  A null or empty text is
    its end only.  Repeated rows get the same scores; an empty table gives an
    empty result; other columns are not carried."""
    spark = df.sparkSession
    prepare(spark)
    rows = df.select(id_or_lowest(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    log_move, log_size = model.log_move, model.log_size
    # A bounded table: lookup_words words, their counts and classes.
    shared = spark.sparkContext.broadcast((model.lookup, model.counts, model.member, model.states, log_move, log_size))
    local = rows.mapInArrow(_score_known(shared), LOCAL).withColumn("_row", F.monotonically_increasing_id())
    local = materialize(local, "scored")

    cells = [(s, c, float(log_move[s, c] - log_size[c])) for s in range(log_move.shape[0]) for c in range(log_move.shape[1])]
    logs = F.broadcast(spark.createDataFrame(cells, "state int, class int, _log double"))  # states x classes rows
    rare = local.select("_row", F.explode("_rare").alias("r")).select("_row", "r.*")
    rare = rare.join(model.assigned, "word", "left").withColumn("class", F.coalesce("class", F.lit(model.unseen)))
    count = F.log10(F.coalesce("n", F.lit(0)) + 1)
    rare = rare.join(logs, ["state", "class"]).groupBy("_row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("_more"),
        F.sum(F.col("times") * count).alias("_more_logs"),
        F.sum(F.col("times") * (F.col("_log") + count)).alias("_more_score"),
    )
    joined = local.drop("_rare").join(rare, "_row", "left").fillna(0, ["_more", "_more_logs", "_more_score"])
    per_token: Column = F.lit(math.log10(model.tokens + model.distinct + 1)) * F.col("n_tokens")
    return joined.select(
        null_id("_id").alias(id_col),
        "n_tokens",
        (F.col("_known") + F.col("_more")).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("_logs") + F.col("_more_logs") - per_token).alias("base_score"),
        (F.col("score") + F.col("_more_score")).alias("score"),
    )


def perplexity(scored: DataFrame) -> Column:
    """Per-token perplexity of a row of :func:`score_brown`."""
    return F.pow(F.lit(10.0), -scored["score"] / scored["n_tokens"])
