"""Exact deduplication with Patricia-trie owners.

Rows are dealt out by length and content hash.  Each task inserts the full byte
strings of its partition, in the order of their bytes, into one compressed radix
trie; a terminal node stores the owner of its text.  In that order every subtree
but the one of the newest text is complete: once the held bytes pass a limit,
complete subtrees are written out and dropped.  Memory is bounded by that limit,
not by the partition.

The same trie runs before the shuffle over each Arrow batch, so a text with
very many copies crosses the network once a batch, not once a row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, id_or_lowest, materialize, null_id, prepare, text_or_empty

#: Bytes of text that the trie of one task holds before subtrees are written out.
HELD_BYTES = 32 << 20


class Owner:
    """What a terminal node stores about the rows that hold its text."""

    __slots__ = ("best", "best_rows", "first", "rows")

    def __init__(self, first: int):
        self.first, self.best, self.best_rows, self.rows = first, None, 0, 0

    def add(self, identifier: int, best_rows: int, rows: int, largest: bool) -> None:
        self.rows += rows
        if self.best == identifier:
            self.best_rows += best_rows
        elif self.best is None or (identifier > self.best) == largest:
            self.best, self.best_rows = identifier, best_rows


class _Node:
    __slots__ = ("children", "label", "owner")

    def __init__(self, label: bytes, owner: Owner | None = None):
        self.label, self.owner, self.children = label, owner, {}


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``."""
    most = min(len(label), len(key) - at)
    low, high = 0, min(16, most)
    while low < high and label[low:high] == key[at + low : at + high]:
        low, high = high, min(2 * high, most)
    while low < high:  # they differ before high
        mid = (low + high) // 2
        if label[low : mid + 1] == key[at + low : at + mid + 1]:
            low = mid + 1
        else:
            high = mid
    return low


class PatriciaTrie:
    """A compressed radix trie over byte strings."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = _Node(b"")

    def owner(self, key: bytes, first: int) -> Owner:
        """The terminal of ``key``, made with ``first`` if it is new."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                leaf = _Node(key[at:] if at else key, Owner(first))
                node.children[key[at]] = leaf
                return leaf.owner
            n = _shared(child.label, key, at)
            if n < len(child.label):  # split the edge
                upper = _Node(child.label[:n])
                child.label = child.label[n:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = upper
                child = upper
            node, at = child, at + n
        if node.owner is None:
            node.owner = Owner(first)
        return node.owner

    def owners(self) -> Iterator[Owner]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.owner is not None:
                yield node.owner
            stack.extend(node.children.values())

    def keep_only(self, key: bytes) -> Iterator[Owner]:
        """Drop all subtrees beside ``key``, which is held, and give back their
        owners and those of the nodes above it."""
        kept = self.owner(key, -1)
        yield from (o for o in self.owners() if o is not kept)
        self.root = _Node(b"")
        if key:
            self.root.children[key[0]] = _Node(key, kept)
        else:
            self.root.owner = kept


def _combine(largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trie = PatriciaTrie()
            ids = batch.column("_id").to_pylist()
            for i, (d, text) in enumerate(zip(ids, batch.column("_text"), strict=True)):
                trie.owner(text.as_py(), i).add(d, 1, 1, largest)
            found = list(trie.owners())
            rows = batch.take(pa.array([o.first for o in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("_len"), rows.column("_hash"), rows.column("_sha"), rows.column("_text")]
                + [pa.array([getattr(o, a) for o in found], pa.int64()) for a in ("best", "best_rows", "rows")],
                names=["_len", "_hash", "_sha", "_text", "_best", "_best_rows", "_rows"],
            )

    return run


def _own(largest: bool, held_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, told, held = PatriciaTrie(), [], 0  # told: length and digest by an owner's first

        def rows(found: list[Owner]) -> pa.RecordBatch:
            own = [told[o.first] for o in found]
            return pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in own], pa.int64()), pa.array([sha for _, sha in own], pa.string())]
                + [pa.array([getattr(o, a) for o in found], pa.int64()) for a in ("best", "best_rows", "rows")],
                names=["_len", "_sha", "_best", "_best_rows", "_rows"],
            )

        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in ("_len", "_sha", "_best", "_best_rows", "_rows")]
            for n, sha, best, best_rows, count, text in zip(*cols, batch.column("_text"), strict=True):
                text = text.as_py()
                owner = trie.owner(text, len(told))
                if owner.first == len(told):
                    told.append((n, sha))
                    held += n
                owner.add(best, best_rows, count, largest)
                if held > held_bytes:  # texts are sorted: all subtrees but this text's are complete
                    yield rows(list(trie.keep_only(text)))
                    told, owner.first, held = [told[owner.first]], 0, n
        if found := list(trie.owners()):
            yield rows(found)

    return run


def text_owners(df: DataFrame, id_col: str, text_col: str, keep: str, held_bytes: int) -> DataFrame:
    """One row per distinct text: ``(_len, _sha, _best, _best_rows, _rows)``."""
    prepare(df.sparkSession)
    largest = {"largest": True, "smallest": False}[keep]
    text = text_or_empty(text_col)
    rows = df.select(
        F.octet_length(text).cast("long").alias("_len"),
        F.xxhash64(text).alias("_hash"),
        F.sha2(text, 256).alias("_sha"),
        id_or_lowest(id_col).alias("_id"),
        text.cast("binary").alias("_text"),
    )
    combined = rows.mapInArrow(
        _combine(largest), "_len long, _hash long, _sha string, _text binary, _best long, _best_rows long, _rows long"
    )
    dealt = combined.repartition("_len", "_hash").sortWithinPartitions("_text")
    return dealt.mapInArrow(
        _own(largest, held_bytes), "_len long, _sha string, _best long, _best_rows long, _rows long"
    )


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", held_bytes: int = HELD_BYTES
) -> DataFrame:
    """All input columns' rows, told which group of equal texts they belong to.

    Adds ``keep_id, group_size, kept, text_sha256`` to the identifier column;
    ``keep`` says which identifier owns a group.  A null text counts as empty;
    a null id is the lowest.  If rows repeat both text and owner id, one of
    them has ``kept``.  An empty table gives an empty result; other columns
    are not carried.

    Owners come from the tries.  Rows are joined to them by length and SHA-256
    (a left join would hide nothing: every text has an owner); Spark splits
    the partition of a text with very many copies."""
    owners = materialize(text_owners(df, id_col, text_col, keep, held_bytes), "owners")
    text = text_or_empty(text_col)
    rows = df.select(
        id_or_lowest(id_col).alias("_id"),
        F.octet_length(text).cast("long").alias("_len"),
        F.sha2(text, 256).alias("_sha"),
    )
    joined = rows.join(owners, ["_len", "_sha"])
    kept = F.col("_id") == F.col("_best")
    if not owners.where("_best_rows > 1").isEmpty():
        # Rows that repeat an owner's id: the one of the lowest number stays.  The
        # numbers are written, so they stay the same; the least is aggregated.
        joined = materialize(joined.withColumn("_nth", F.monotonically_increasing_id()), "numbered")
        first = joined.where(kept & (F.col("_best_rows") > 1)).groupBy("_len", "_sha").agg(F.min("_nth").alias("_nth"))
        joined = joined.join(first.select("_nth", F.lit(True).alias("_first")), "_nth", "left")
        kept = kept & ((F.col("_best_rows") == 1) | F.col("_first").isNotNull())
    return joined.select(
        null_id("_id").alias(id_col),
        null_id("_best").alias("keep_id"),
        F.col("_rows").alias("group_size"),
        kept.alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", held_bytes: int = HELD_BYTES
) -> DataFrame:
    """The rows of ``df`` without exact copies, in their own columns.

    A null text counts as empty, a null id is the lowest; of rows that repeat
    both text and id, any one stays.  An empty table gives an empty result."""
    owners = materialize(text_owners(df, id_col, text_col, keep, held_bytes), "owners")
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    sha = F.sha2(text, 256)
    on = (
        (F.coalesce(df[id_col].cast("long"), F.lit(NULL_ID).cast("long")) == owners["_best"])
        & (F.octet_length(text).cast("long") == owners["_len"])
        & (sha == owners["_sha"])
    )
    kept = df.join(owners, on, "left_semi")
    if owners.where("_best_rows > 1").isEmpty():
        return kept
    mark = f"_sha_{uuid.uuid4().hex}"  # no name of the input
    return kept.withColumn(mark, sha).dropDuplicates([id_col, mark]).drop(mark)


__all__ = ["HELD_BYTES", "NULL_ID", "PatriciaTrie", "drop_exact_copies", "exact_groups", "text_owners"]
