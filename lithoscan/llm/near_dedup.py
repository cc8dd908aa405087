"""Near-duplicate detection with a MinHash LSH forest.

Documents with equal shingle sets become one node.  Each of several trees
orders the nodes by a slice of their MinHash signature; neighbours in that
order that share a long enough prefix are candidates.  How deep a region is
split is left to the order itself: next to a node stands the one with the
longest common prefix, so a crowded region is read at greater depth than a
sparse one, and no region is ever expanded into all its pairs.

Candidates are confirmed on full shingle sets in two rounds.  First each node
is compared with its best candidates, which links groups of copies up; then
all candidates that still lie in different components are compared.

What the forest misses is found exactly, by the pigeonhole principle.  Sets of
one size class are cut into the same number of parts by the hash of their
members; two linked sets differ in few members, so most of their parts are
equal.  A set's parts are ordered by size, the fullest first: of those, as many
as members can differ, and one more, cannot all be missed by a linked set.
Equal parts of several members hardly occur by chance, however many documents
there are.  The nodes that share a part are compared inside tasks, in tiles of
bounded size, by small parity sketches, which rule out no linked pair; only pairs
of different components that pass are confirmed.  In very long lists all nodes are
first compared with the few best linked ones, as long as that finds links.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, id_or_lowest, materialize, null_id, prepare, text_or_empty
from .components import connected_components
from .shingles import mixed, overlap, shingle_sets

#: Trees, hashes from one tree's start to the next, hashes that a crowded region
#: is ordered by, hashes that candidates share, and places looked ahead.
TREES, STEP, DEPTH, MIN_PREFIX, NEIGHBOURS = 20, 6, 12, 3, 3
#: Nodes of one part from which all are first compared with a few of them, the best
#: linked ones; a tile's side; pairs of one node that are confirmed in one group.
CROWD, CENTRES, TILE, GROUP = 2048, 4, 1024, 256
#: Comparisons of sketches in one region that go to one task.
TASK_WORK = 20_000_000
#: Bits of the tables, the same at any size, that tell which parts may be shared
#: and which nodes' texts may be wanted.  A full table rules out less, and more
#: rows are shuffled; none is lost.
SHARED_BITS, WANTED_BITS = 1 << 26, 1 << 24


@cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    seeds = (seeds >> np.uint64(32)).astype(np.uint32)
    return seeds[:n, None] | np.uint32(1), seeds[n:, None]


def min_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """``n`` big-endian 32-bit minima of permutations of the set's hashes."""
    mult, add = _permutations(n)
    short = (values >> np.uint64(32)).astype(np.uint32)
    low = np.full(n, np.iinfo(np.uint32).max, dtype=np.uint32)
    room = np.empty((n, 256), np.uint32)
    for at in range(0, len(short), 256):
        some = short[None, at : at + 256]
        found = np.multiply(some, mult, out=room[:, : some.shape[1]])
        found += add
        np.minimum(low, found.min(axis=1), out=low)
    return low.astype(">u4")


def parities(values: np.ndarray) -> bytes:
    """Of each cell that the set's hashes fall into, whether they are odd in
    number; a power of two of cells, two for each member at least, so that few
    members that differ hide one another."""
    cells = 1 << max(6, int(len(values)).bit_length() + 1)
    odd = np.bincount((values & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Lower bounds of the numbers of members that only one of two sets has."""
    width = min(len(one), others.shape[1])
    one, others = (x.reshape(-1, x.shape[-1] // width, width) for x in (one[None], others))
    return np.bitwise_count(np.bitwise_xor.reduce(one, axis=1) ^ np.bitwise_xor.reduce(others, axis=1)).sum(axis=1, dtype=np.int64)


def _sign(width: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, signatures = [], [], []
            for values in shingle_sets(batch.column("_text").to_pylist(), width):
                sizes.append(len(values))
                prints.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                signatures.append(min_hashes(values, hashes).tobytes() if len(values) else b"")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    batch.column("_th"),
                    pa.array(sizes, pa.int64()),
                    pa.array(prints, pa.binary()),
                    pa.array(signatures, pa.binary()),
                ],
                names=["_id", "_th", "_n", "_print", "_sig"],
            )

    return run


def _neighbours(depth: int, min_prefix: int, reach: int):
    """Pairs up to ``reach`` places apart that share a prefix; the rows at both
    ends of a partition are passed on (``edge``) to be paired across it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "lcp", "edge", "tree", "key"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary()]

        def rows(cols: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names
            )

        def edge(tree, key, node) -> pa.RecordBatch:
            n = len(node)
            return rows([node, [None] * n, [None] * n, [True] * n, tree, key])

        held, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column("tree").to_numpy()
            node = batch.column("node").to_numpy()
            raw = batch.column("key").to_pylist()
            key = np.frombuffer(b"".join(raw), dtype=">u4").reshape(-1, depth)
            if seen < reach:
                m = min(reach - seen, len(node))
                yield edge(tree[:m], raw[:m], node[:m])
                seen += m
            if held is not None:
                tree, key, node = (np.concatenate(x) for x in zip(held, (tree, key, node), strict=True))
            fresh = 0 if held is None else len(held[0])
            for step in range(1, min(reach, len(node) - 1) + 1):
                lcp = np.cumprod(key[step:] == key[:-step], axis=1).sum(axis=1)
                good = (lcp >= min_prefix) & (tree[step:] == tree[:-step])
                good[: max(0, fresh - step)] = False  # pairs of held rows are known
                at = np.flatnonzero(good)
                if len(at):
                    x, y = node[at], node[at + step]
                    n = len(at)
                    yield rows(
                        [np.minimum(x, y), np.maximum(x, y), lcp[at].astype(np.int32), np.zeros(n, bool)]
                        + [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
                    )
            held = tree[-reach:], key[-reach:], node[-reach:]
        if held is not None:
            yield edge(held[0], [k.tobytes() for k in held[1]], held[2])

    return run


PAIRS = "a long, b long, lcp int, edge boolean, tree int, key binary"


def forest_candidates(nodes: DataFrame, trees: int, step: int, depth: int, min_prefix: int, reach: int) -> DataFrame:
    """``nodes (node, _sig)`` to distinct pairs ``(a, b, score)``, a < b.

    A tree's key starts with ``step`` hashes of its own and goes on with those
    of the next trees up to ``depth``: only regions where many nodes share the
    first ones are ordered by the others."""
    around = F.concat("_sig", F.substring("_sig", 1, 4 * depth))
    slices = [F.struct(F.lit(t).alias("tree"), F.substring(around, 4 * t * step + 1, 4 * depth).alias("key")) for t in range(trees)]
    rows = nodes.select("node", F.explode(F.array(*slices)).alias("_s")).select("_s.tree", "_s.key", "node")
    order = ["tree", "key", "node"]
    stream = _neighbours(depth, min_prefix, reach)
    found = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(stream, PAIRS)
    found = materialize(found, "neighbours")
    # A few rows per partition: the ends, in order, in one task.
    ends = found.where("edge").select("tree", "key", F.col("a").alias("node")).distinct()
    across = ends.coalesce(1).sortWithinPartitions(*order).mapInArrow(stream, PAIRS)
    pairs = found.where("NOT edge").unionByName(across.where("NOT edge"))
    return pairs.where("a < b").groupBy("a", "b").agg(F.sum("lcp").alias("score"))


def _confirm(width: int, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, values = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            out = []
            for x, y, own in zip(a, b, shingle_sets(batch.column("_text").to_pylist(), width), strict=True):
                if x == y:
                    centre, values = x, own
                elif centre == x:
                    both = overlap(values, own)
                    if 100 * both >= share * (len(values) + len(own) - both):
                        out.append((x, y))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"]
            )

    return run


def _bit_table(bit: Column, rows: DataFrame, size: int) -> np.ndarray:
    """Sets the bits of all rows; ``size`` bits come to the driver at most."""
    bit = bit + 1  # pages of 2^15 bits are counted from 1
    pages = rows.groupBy(F.bitmap_bucket_number(bit).alias("page"))
    bits = np.zeros(size // 8, np.uint8)
    for page in pages.agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect():
        bits[(page["page"] - 1) << 12 : page["page"] << 12] = np.frombuffer(page["bits"], np.uint8)
    return bits


def _is_set(bits: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def _wanted(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            bit = ((node >> 33) * 40503 + (node & ((1 << 33) - 1))) & (WANTED_BITS - 1)
            yield batch.filter(pa.array(_is_set(table.value, bit)))

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, share: int, most: int | None = None) -> DataFrame:
    """The pairs whose full shingle sets are similar enough.  The text of ``a``
    comes first in its group, then its few partners; many are dealt over
    several groups, which need not be counted where a node has at most ``most``
    partners and these fit one.  Only texts of nodes that may be in a pair are
    shuffled."""
    if most is not None and most < GROUP:
        pairs = pairs.select("a", F.lit(0).cast("long").alias("_g"), "b")
    else:
        groups = pairs.groupBy("a").agg(F.floor(F.count(F.lit(1)) / GROUP + 1).alias("_groups"))
        pairs = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), "_groups").alias("_g"), "b")
    stars = pairs.unionByName(pairs.select("a", "_g", F.col("a").alias("b")).distinct())
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    low = F.col("node").bitwiseAND(F.lit((1 << 33) - 1))
    bit = (F.shiftright("node", 33) * 40503 + low).bitwiseAND(F.lit(WANTED_BITS - 1))
    table = texts.sparkSession.sparkContext.broadcast(_bit_table(bit, nodes, WANTED_BITS))
    own = texts.mapInArrow(_wanted(table), "node long, _text string").withColumnRenamed("node", "b")
    told = stars.join(own, "b").select("a", "_g", "b", "_text")
    dealt = told.repartition("a", "_g").sortWithinPartitions("a", "_g", "b")  # a < b: the centre sorts first
    return dealt.mapInArrow(_confirm(width, share), "a long, b long")


@cache
def _class_bounds() -> list[int]:
    """Sizes at which a size class begins: each is about half as wide as that."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 3 // 2)))
    return bounds


def size_classes(n: int, share: int) -> Iterator[tuple[int, int, int]]:
    """``(class, parts, differing)`` for each class that a set of ``n`` is told
    in: its own, where it is the smaller of two linked sets, and those of the
    smaller sets that it may be linked to.  ``differing`` bounds the members
    that only one of two linked sets has, ``parts`` is the same for a class."""
    bounds = _class_bounds()
    own = bisect_right(bounds, n) - 1
    least = -(-share * n // 100)
    for c in range(bisect_right(bounds, least) - 1, own + 1):
        largest = bounds[c + 1] - 1
        most = (100 - share) * largest // share  # of the class
        differing = (100 - share) * n // share if c == own else (100 - share) * (n + largest) // (100 + share)
        if most:
            yield c, most + 2 + most // 8, min(differing, most)


def part_tokens(values: np.ndarray, share: int) -> np.ndarray:
    """Tokens of a set's parts, such that linked sets that are not equal have one
    in common."""
    out = []
    for c, parts, differing in size_classes(len(values), share):
        salt = np.uint64((c + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        if (100 - share) * (_class_bounds()[c + 1] - 1) // share == 1:
            # One member at most: the set itself and all that lack one of it.
            out.append(mixed(np.append(values.sum() - values, values.sum()) + salt))
            continue
        place = ((values >> np.uint64(32)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
        order = np.argsort(place, kind="stable")
        count = np.bincount(place, minlength=parts)
        sums = np.zeros(parts, np.uint64)
        filled = np.flatnonzero(count)
        sums[filled] = np.add.reduceat(values[order], (np.cumsum(count) - count)[filled])
        token = mixed(sums + np.arange(1, parts + 1, dtype=np.uint64) * salt)
        # The fullest parts have the lowest tokens: the first byte tells how empty one is.
        token = (token >> np.uint64(8)) | (np.uint64(255) - np.minimum(count, 255).astype(np.uint64) << np.uint64(56))
        out.append(np.partition(token, differing)[: differing + 1])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _parts(width: int, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = list(shingle_sets(part.column("_text").to_pylist(), width))
                found = [part_tokens(values, share).view(np.int64) for values in sets]
                ends = np.cumsum([0, *map(len, found)])
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *found])))
                sizes, bits = pa.array([len(v) for v in sets], pa.int64()), pa.array(map(parities, sets), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("node"), sizes, bits, tokens], names=["node", "n", "bits", "tokens"])

    return run


def _maybe_shared(table):
    """The tokens whose bit is set, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            tokens = batch.column("tokens")
            flat = tokens.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(tokens.offsets.to_numpy()))
            bit = flat & (SHARED_BITS - 1)
            good = np.flatnonzero(_is_set(bits, bit))
            at = pa.array(row[good])
            yield pa.RecordBatch.from_arrays([pa.array(flat[good]), batch.column("node").take(at)], names=["token", "node"])

    return run


def shared_parts(told: DataFrame) -> DataFrame:
    """``told (node, tokens)`` to ``(token, node)`` of parts that several nodes
    have, and a few more.

    Tokens are counted with partial aggregation; a table of ``SHARED_BITS`` bits
    tells tasks which rows to pass on, so those of parts that one node has are
    shuffled once, as a count."""
    # Forty bits of a token tell nearly all apart, and take less room in the shuffle.
    some = told.select(F.explode("tokens").alias("token")).select(F.col("token").bitwiseAND(F.lit((1 << 40) - 1)).alias("token"))
    counts = some.groupBy("token").agg(F.count(F.lit(1)).alias("k"))
    bits = _bit_table(F.col("token").bitwiseAND(F.lit(SHARED_BITS - 1)), counts.where("k > 1"), SHARED_BITS)
    rows = told.select("node", "tokens").mapInArrow(_maybe_shared(told.sparkSession.sparkContext.broadcast(bits)), "token long, node long")
    return materialize(rows, "shared_parts")


def _compare(share: int):
    """Rows sorted by tile to the pairs of different components, and of a tile of
    two blocks of different blocks, that sizes and sketches do not rule out."""

    def found(tile: list[tuple]) -> Iterator[tuple[int, int]]:
        node, root, size, block = (np.array([r[i] for r in tile]) for i in range(4))
        width = min(len(r[4]) for r in tile)
        # The widest sketches are folded until all are as long as the shortest.
        bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(r[4], np.uint8).reshape(-1, width)) for r in tile])
        bits = bits.view(np.uint64)
        names, group, count = np.unique(root, return_inverse=True, return_counts=True)
        one, largest = len(np.unique(block)) == 1, count.argmax()
        # Each pair once: the largest component's nodes are met by all others.
        order = np.argsort(group == largest, kind="stable")
        node, group, size, block, bits = (x[order] for x in (node, group, size, block, bits))
        for i in range(len(node) - count[largest]):
            rest = slice(i + 1, None)
            able = (group[rest] != group[i]) & (100 * np.minimum(size[rest], size[i]) >= share * np.maximum(size[rest], size[i]))
            if not one:
                able &= block[rest] != block[i]
            at = np.flatnonzero(able) + i + 1
            if len(at):
                apart = differing(bits[i], bits[at])
                for j in at[(100 + share) * apart <= (100 - share) * (size[i] + size[at])].tolist():
                    yield (int(node[i]), int(node[j])) if node[i] < node[j] else (int(node[j]), int(node[i]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs: set) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        key, tile, pairs = None, [], set()
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("token", "_t", "_u", "node", "root", "n", "_block", "bits")]
            for token, t, u, *row in zip(*cols, strict=True):
                if (token, t, u) != key:
                    pairs.update(found(tile) if len(tile) > 1 else ())
                    key, tile = (token, t, u), []
                    if len(pairs) > 100_000:
                        yield out(pairs)
                        pairs = set()
                tile.append(row)
        pairs.update(found(tile) if len(tile) > 1 else ())
        yield out(pairs)

    return run


def _compared(tiles: DataFrame, share: int) -> DataFrame:
    """``tiles (token, region, salts, _t, _u, node, root, n, _block, bits)`` to
    distinct pairs.  The parts of one region, which share their lowest component,
    share its pairs too: they go to as few tasks as they fill, which tell of a pair
    once."""
    salt = F.pmod(F.xxhash64("token", "_t", "_u"), "salts")
    dealt = tiles.repartition("region", salt).sortWithinPartitions("token", "_t", "_u")
    return dealt.mapInArrow(_compare(share), "a long, b long").distinct()


def exact_rest(
    texts: DataFrame, roots: DataFrame, links: DataFrame, tried: DataFrame, width: int, share: int, crowd: int, side: int
) -> DataFrame:
    """``roots (node, root)`` with all links that join different components.
    Pairs that were ``tried`` and still lie apart are not linked."""
    kind = "node long, n long, bits binary, tokens array<long>"
    told = materialize(texts.select("node", "_text").mapInArrow(_parts(width, share), kind), "part_tokens")
    shared, facts = shared_parts(told), materialize(told.select("node", "n", "bits"), "sketches")
    discard(told)

    def crossing(held: DataFrame) -> DataFrame:
        placed = held.select("token", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        spans = placed.groupBy("token").agg(
            F.min("root").alias("_low"), F.max("root").alias("_high"), F.count(F.lit(1)).alias("k")
        )
        # Written first, so that Spark can split the join of a part that very many have.
        spans = materialize(spans.where("_low < _high").select("token", "k", F.col("_low").alias("region")), "spans")
        # What a part's rows are compared with, summed up by region.
        work = F.sum(F.col("k") * (F.col("k") + 1) / 2)
        salts = spans.groupBy("region").agg(F.ceil(work / TASK_WORK).alias("salts"))
        return materialize(placed.join(spans.join(salts, "region"), "token"), "crossing")

    def link(tiles: DataFrame) -> bool:
        nonlocal roots, links, tried
        pairs = _compared(tiles.join(facts, "node"), share)
        pairs = materialize(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "exact_pairs")
        if pairs.isEmpty():
            return False
        more = materialize(confirmed(pairs, texts, width, share), "links")
        tried = tried.select("a", "b").unionByName(pairs)
        if more.isEmpty():
            return False
        links = links.unionByName(more)
        stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = connected_components(stars.unionByName(more))
        return True

    rows = crossing(shared)
    zero, last = F.lit(0).cast("long"), F.floor((F.col("k") - 1) / side)
    while (most := rows.agg(F.max("k")).first()[0]) is not None and most > crowd:
        long = rows.where(F.col("k") > crowd)
        ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("_degree"))
        best = F.row_number().over(Window.partitionBy("token").orderBy(F.coalesce("_degree", F.lit(0)).desc(), "node"))
        centres = long.join(ends, "node", "left").withColumn("_r", best).where(F.col("_r") <= CENTRES)
        # Tiles of the centres as one block and the others in as many as they fill.
        block = F.pmod(F.xxhash64("node"), last + 1) + 1
        centre = centres.select("token", "region", "salts", "node", "root", F.explode(F.sequence(F.lit(1).cast("long"), last + 1)).alias("_u"), zero.alias("_block"))
        own = long.select("token", "region", "salts", "node", "root", block.alias("_u"), block.alias("_block"))
        if not link(centre.unionByName(own).withColumn("_t", zero)):
            break
        rows = crossing(rows)
    if most is None:
        return roots
    blocks = rows.withColumn("_block", F.pmod(F.xxhash64("node"), last + 1))
    tiles = blocks.withColumn("_other", F.explode(F.sequence(zero, last)))
    tiles = tiles.withColumns({"_t": F.least("_block", "_other"), "_u": F.greatest("_block", "_other")})
    link(tiles.select("token", "region", "salts", "node", "root", "_t", "_u", "_block"))
    return roots


def near_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    share: int = 80,
    trees: int = TREES,
    step: int = STEP,
    depth: int = DEPTH,
    min_prefix: int = MIN_PREFIX,
    reach: int = NEIGHBOURS,
    crowd: int = CROWD,
    side: int = TILE,
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; documents are
    linked if 100 * |intersection| >= ``share`` * |union| of their distinct
    ``width``-word shingles.  A component's id is its smallest document id
    (null is the lowest); documents without words are components of their own.
    Repeated rows fall into one component and are all ``kept`` if they have
    its id.  An empty table gives an empty result; other columns are not
    carried.

    The forest finds most links; those it misses, as between an original and
    very many copies that are not linked to one another, are found by the exact
    prefix filter, so the components are those of all links."""
    spark = df.sparkSession
    prepare(spark)
    text = text_or_empty(text_col)
    rows = df.select(id_or_lowest(id_col).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    kind = "_id long, _th long, _n long, _print binary, _sig binary"
    signed = materialize(rows.mapInArrow(_sign(width, trees * step), kind), "signatures")
    nodes = signed.where("_n > 0").groupBy("_print").agg(F.min(F.struct("_id", "_th")).alias("_r"), F.first("_sig").alias("_sig"))
    nodes = nodes.select("_print", F.col("_r._id").alias("_rep"), F.col("_r._th").alias("_th"), "_sig")
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    pairs = materialize(forest_candidates(nodes, trees, step, depth, min_prefix, reach), "pairs")

    # Texts of the nodes, by id and text: rows may repeat an id with another text.
    wanted = nodes.select("node", F.col("_rep").alias("_id"), "_th")
    texts = rows.join(wanted, ["_id", "_th"]).select("node", "_text")
    if not signed.groupBy("_id", "_th").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["node"])
    texts = materialize(texts, "texts")

    both = pairs.select("a", "b", "score", F.col("a").alias("x")).unionByName(
        pairs.select("a", "b", "score", F.col("b").alias("x"))
    )
    best = F.row_number().over(Window.partitionBy("x").orderBy(F.col("score").desc(), "a", "b"))
    first = materialize(both.withColumn("_r", best).where("_r <= 2").select("a", "b").distinct(), "first_pairs")
    most = 4 * reach * trees  # neighbours on both sides, met once more at the ends of partitions
    links = materialize(confirmed(first, texts, width, share, most), "links")
    roots = connected_components(links)
    rest = pairs.select("a", "b").join(first, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = rest.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"_{end}")), end, "left")
    apart = rest.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
    more = materialize(confirmed(materialize(apart, "second_pairs"), texts, width, share, most), "links")
    if not more.isEmpty():
        # The components so far are stars already: only what joins them is left to contract.
        stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = connected_components(stars.unionByName(more))
    roots = exact_rest(texts, roots, links.unionByName(more), pairs, width, share, crowd, side)

    placed = nodes.join(roots, "node", "left").select("_print", "_rep", F.coalesce("root", "node").alias("root"))
    placed = materialize(placed, "placed")
    # Written first, so that Spark can split the join of a component that is very large.
    lowest = materialize(placed.groupBy("root").agg(F.min("_rep").alias("_component")), "components")
    placed = placed.join(lowest, "root").select("_print", "_component")
    done = signed.select("_id", "_n", "_print").join(placed, "_print", "left")
    component = F.when(F.col("_n") > 0, F.col("_component")).otherwise(F.col("_id"))
    done = done.select("_id", "_n", component.alias("_component"))
    return done.select(
        null_id("_id").alias(id_col),
        F.col("_n").alias("n_shingles"),
        null_id("_component").alias("component_id"),
        (F.col("_id") == F.col("_component")).alias("kept"),
    )


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that are kept, in their own columns: one document of
    each component.  Rows must have distinct ids (as exact deduplication leaves
    them); of rows that repeat an id, all stay or none."""
    kept = near_groups(df, id_col, text_col, **options).where("kept").select(id_or_lowest(id_col).alias("_kept")).distinct()
    own = F.coalesce(df[id_col].cast("long"), F.lit(-(2**63)).cast("long"))
    return df.join(kept, own == kept["_kept"], "left_semi")


__all__ = ["drop_near_copies", "forest_candidates", "near_groups"]
