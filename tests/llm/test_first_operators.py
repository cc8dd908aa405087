import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from public_tokenizers import path as tokenizer_file

from lithoscan.llm.exact_dedup import PatriciaTrie, drop_exact_copies, exact_groups
from lithoscan.llm.line_dedup import dedup_lines
from lithoscan.llm.packing import SumOfSquares, pack_documents
from lithoscan.llm.sharding import shard_records
from lithoscan.llm.token_counts import count_tokens, read_cache, tokenizer_digest
from lithoscan.llm.tokens import ByteBPE, PieceCounter

from .data import SCHEMA, clashing, empty, frame, rows

BPE, PIECES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
LOWEST = -(2**63)


def key(line):
    stripped = re.sub(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in stripped)


def test_line_dedup_against_brute_force(spark):
    data = rows()
    holders = defaultdict(set)
    for d, t, *_ in data:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(LOWEST if d is None else d)
    want = Counter()
    for d, t, *_ in data:
        lines = (t or "").split("\n")
        keep = [
            x for x in lines
            if len(holders[key(x)]) < 3 or (LOWEST if d is None else d) == max(holders[key(x)])
        ]
        want[d, len(lines), len(lines) - len(keep), "\n".join(keep)] += 1
    got = dedup_lines(clashing(frame(spark))).collect()
    assert Counter(map(tuple, got)) == want
    assert any(r.n_dropped for r in got)


def test_line_dedup_of_a_line_in_most_documents(spark):
    line = "one very common line of text"
    data = [(i, f"{line}\nown line number {i:06d} here\n{line.upper()}", None, None, 0) for i in range(3000)]
    df = spark.createDataFrame(data, SCHEMA).repartition(8)
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert len(got) == 3000 and got[2999].n_dropped == 0
    assert all(got[i].n_dropped == 2 and got[i].kept_text == f"own line number {i:06d} here" for i in range(2999))


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups_against_brute_force(spark, keep):
    data, groups = rows(), defaultdict(list)
    for d, t, *_ in data:
        groups[t or ""].append(LOWEST if d is None else d)
    best = max if keep == "largest" else min
    want, kept = Counter(), Counter()
    for d, t, *_ in data:
        ids = groups[t or ""]
        owner = best(ids)
        want[d, None if owner == LOWEST else owner, len(ids), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = exact_groups(clashing(frame(spark)), keep=keep, held_bytes=500).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    for r in got:
        if r.kept:
            kept[r.text_sha256] += 1
            assert r.doc_id == r.keep_id
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    left = drop_exact_copies(clashing(frame(spark)), keep=keep).collect()
    assert sorted(x.text or "" for x in left) == sorted(groups)


def test_null_and_empty_are_one_text(spark):
    data = [(5, None), (5, ""), (5, ""), (None, "x"), (None, "x"), (7, "y"), (6, "y")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    left = [tuple(r) for r in drop_exact_copies(df).collect()]
    assert Counter((d, t or "") for d, t in left) == Counter([(5, ""), (None, "x"), (7, "y")])
    got = exact_groups(df).collect()
    assert Counter((r.doc_id, r.group_size) for r in got if r.kept) == Counter([(5, 3), (None, 2), (7, 2)]) and len(got) == 7


def test_trie_keeps_only_one_text():
    trie = PatriciaTrie()
    for i, w in enumerate([b"", b"ab", b"abc", b"abd", b"b"]):
        trie.owner(w, i).add(i, 1, 1, True)
    last = trie.owner(b"b", -1)
    assert sorted(o.first for o in trie.keep_only(b"b")) == [0, 1, 2, 3]
    assert list(trie.owners()) == [last] and trie.owner(b"b", 9) is last


def test_trie_splits_edges():
    trie, words = PatriciaTrie(), [b"", b"a", b"abc", b"abd", b"ab", b"b", b"abcdefgh", b"abcdefgx"]
    for round_ in range(2):
        for i, w in enumerate(words):
            trie.owner(w, i).add(10 * round_ + i, 1, 1, largest=True)
    found = {o.first: (o.best, o.rows) for o in trie.owners()}
    assert found == {i: (10 + i, 2) for i in range(len(words))}


def test_tokens_equal_the_libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    whole, piece = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    fast, counter = ByteBPE(BPE), PieceCounter(PIECES)
    assert fast.fast and counter.by_word
    texts = [t or "" for _, t, *_ in rows()]
    texts += ["a  b", " a", "a ", "  ", "\t a  b \n c", "don't we'll  1234 é!!", "<|endoftext|><|endoftext|> a<|endoftext|>"]
    texts += ["  lead and trail  ", "x   y", " a b  c", "<s> a </s>", "a\n  b\n\n c", "   ", "a   "]
    for text in texts:
        assert np.frombuffer(fast.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
        assert counter.count(text) == len(piece.encode(text)), repr(text)


def test_token_counts_and_cache(spark, tmp_path):
    import sentencepiece

    piece, cache = sentencepiece.SentencePieceProcessor(model_file=PIECES), str(tmp_path / "cache")
    want = Counter(
        (d, len((t or "").encode()), n := len(piece.encode(t or "")), n > 4096) for d, t, *_ in rows()
    )
    for _ in range(2):
        assert Counter(map(tuple, count_tokens(clashing(frame(spark)), PIECES, cache).collect())) == want
    version = tokenizer_digest(PIECES)
    distinct = len({t or "" for _, t, *_ in rows()})
    assert spark.read.parquet(cache).count() == distinct  # the second run added nothing
    # stored counts are used
    known = hashlib.sha256(b"a").hexdigest()
    other = str(tmp_path / "other")
    spark.createDataFrame([(version, known, 99)], "tokenizer string, content string, n_tokens long").write.parquet(other)
    got = {r.doc_id: r.n_tokens for r in count_tokens(frame(spark), PIECES, other).collect()}
    assert 99 in got.values() and read_cache(spark, other, version).count() == distinct


def check_packing(pieces, docs, window):
    spans, windows = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert 0 < r.length <= window and len(r.token_ids) == 4 * r.length
        windows[r.sequence_id].append((r.offset, r.length))
        spans[r.doc_id].append((r.start, r.token_ids, r.doc_tokens))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    for name, ids in docs.items():
        parts = sorted(spans[name])
        assert b"".join(p[1] for p in parts) == ids and parts[0][0] == 0
        assert {p[2] for p in parts} == {len(ids) // 4}
    return len(windows)


def test_packing_is_an_exact_round_trip(spark):
    data = [(100 + i, t) for i, (_, t, *_) in enumerate(rows())]
    encode = ByteBPE(BPE).encode
    docs = {d: encode(t or "") + np.array([1], "<u4").tobytes() for d, t in data}
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    for window in (64, 2048):
        n = check_packing(pack_documents(clashing(df), BPE, window=window).collect(), docs, window)
        assert n <= sum(len(x) // 4 for x in docs.values()) / window + 3
    odd = pack_documents(frame(spark), BPE).collect()
    assert sum(r.length for r in odd) == sum(len(encode(t or "")) // 4 + 1 for _, t, *_ in rows())


def test_sum_of_squares_takes_the_best_level():
    rng, levels = np.random.default_rng(1), SumOfSquares(50)
    for size in rng.integers(1, 50, 800):
        def after(h, size=size):
            count = levels.count.copy()
            if h:
                count[h] -= 1
            if h + size < 50:
                count[h + size] += 1
            return int((count**2).sum())

        open_levels = [0] + [h for h in range(1, 51 - size) if levels.count[h]]
        assert after(levels.level_for(size)) == min(map(after, open_levels))
        levels.place((1, 0, bytes(4 * size), size))
    poured = list(levels.pour())
    assert all(sum(len(p[2]) for p in w) == 200 for w in poured[:-1])


def test_sharding(spark):
    got = shard_records(clashing(frame(spark)), n_shards=5).collect()
    assert sorted(zip((r.size for r in got), (r.text_crc32 for r in got))) == sorted(
        (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in rows()
    )
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 5)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    bigger = {(r.doc_id, r.text_crc32): r.shard for r in shard_records(frame(spark), n_shards=6).collect()}
    assert all(bigger[r.doc_id, r.text_crc32] == r.grown_shard for r in got)
    many = spark.range(20000).selectExpr("id AS doc_id", "'x' AS text")
    counts = Counter(r.shard for r in shard_records(many, n_shards=3, weights=[1, 1, 2]).collect())
    assert abs(counts[2] - 10000) < 400 and abs(counts[0] - 5000) < 300


def test_empty_tables(spark):
    none = empty(spark)
    assert dedup_lines(none).count() == exact_groups(none).count() == drop_exact_copies(none).count() == 0
    assert count_tokens(none, PIECES).count() == pack_documents(none, BPE).count() == shard_records(none).count() == 0
