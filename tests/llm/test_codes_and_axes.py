"""Byte-level codes, alignment and whitening against brute force."""

import random
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import accumulate

import hashlib
import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN
from public_tokenizers import path as tokenizer_file

from lithoscan.llm import byte_codec, queries
from lithoscan.llm.alignment import Aligner, align_tokens, link_counts, score_links
from lithoscan.llm.common import materialize
from lithoscan.llm.whitening import whiten

from .data import SCHEMA, clashing, empty, frame, rows

RANKS, A, B = (tokenizer_file(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))

#: Blanks and controls, contraction marks, characters that Unicode versions tell apart, and long ones.
CODES = [0x20, 0x20, 0x20, 0x0A, 0x61, 0x62, 0x27, 0x73, 0x31, 0xA0, 0x3000, 0x85, 0x1C, 0, 0x58B, 0x208F, 0x3FC3F, 0x11DE0, 0x16FF6, 0x1F600, 0x301, 0xE9, 0xD55C, 0xFB01, 0x2581]
ODD = ["<|endoftext|> a </s> <0x41>", "a  \n b", " ", "\n", "it's he'll", "x" * 50_000, "ab c\n" * 9000 + " " * 999, "é" * 3000]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return [*ODD, *("".join(chr(rng.choice(CODES)) for _ in range(rng.randrange(25))) for _ in range(n))]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_codec_agrees_with_the_library(name):
    path = tokenizer_file(name)
    codec = byte_codec.ByteCodec(path)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_codec.read_ranks(path), special_tokens={})
    texts = [*odd_texts(1500), *(t or "" for _, t, *_ in rows())]
    coded = [ids for at in range(0, len(texts), 200) for ids in codec.encode_all(texts[at : at + 200])]
    for text, ids in zip(texts, coded, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text[:40])
    assert codec.decode_all(coded) == [text.encode() for text in texts]
    with pytest.raises(ValueError, match="60000"):
        codec.decode_all([np.array([60_000], "<u4").tobytes()])


def test_model_serialisation():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 400, b"zz": 500, b"bc": 350}
    data, order = byte_codec.serialise_model(ranks)
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto.FromString(data)
    assert order == sorted(ranks.values()) and [p.score for p in pb.pieces][:-1] == [-float(r) for r in order]
    assert pb.trainer_spec.model_type == 2 and pb.trainer_spec.unk_id == len(order) and pb.pieces[-1].type == 2
    norm = pb.normalizer_spec
    assert norm.name == "identity" and not (norm.add_dummy_prefix or norm.remove_extra_whitespaces or norm.escape_whitespaces)
    with pytest.raises(ValueError, match="single bytes"):
        byte_codec.serialise_model({b"a": 0})


def test_an_entry_that_no_merge_reaches_is_its_own_token(tmp_path):
    import base64

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"xyz": 257}
    path = tmp_path / "own.tiktoken"
    path.write_text("".join(f"{base64.b64encode(e).decode()} {r}\n" for e, r in ranks.items()))
    codec = byte_codec.ByteCodec(str(path))
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("xyz", "xyz xyz", "abxyz", "xyz1"):
        assert np.frombuffer(codec.encode_all([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_memo_forgets_what_is_not_asked_for():
    memo = byte_codec.Recent(4)
    for word in "abcdef":
        for new in memo.missing({word, "a"}):
            memo.young[new] = new
        memo.forget([])
    assert memo.missing({"a"}) == [] and memo.missing({"b"}) == ["b"]
    assert len(memo.young) + len(memo.old) <= 5


def test_encoded_rows(spark):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_codec.read_ranks(RANKS), special_tokens={})
    coded = byte_codec.encode_texts(clashing(frame(spark), "token_ids", "decoded"), RANKS)
    got = byte_codec.decode_ids(coded, RANKS)
    assert got.columns == ["doc_id", "token_ids", "decoded"]
    want = Counter((d, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t, *_ in rows())
    assert Counter((r.doc_id, bytes(r.token_ids), bytes(r.decoded)) for r in got.collect()) == want
    assert all(r.n_tokens * 4 == len(r.token_ids) for r in coded.collect())
    assert byte_codec.decode_ids(byte_codec.encode_texts(empty(spark), RANKS), RANKS).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, token_ids binary")
    assert bytes(byte_codec.decode_ids(none, RANKS).first().decoded) == b""


class Plain:
    """The contract word by word: all pairs of tokens of one document are compared."""

    def __init__(self):
        from tokenizers import Tokenizer

        self.aligner = Aligner(A, B)
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True

    def __call__(self, text):
        own, nothing = self.aligner, (0, 0, 0, "", Counter())
        if not text:
            return nothing
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, own.b.model.encode(text)
        parts_a, parts_b = [own.a_bytes[i] for i in a], [own.b_bytes[i] for i in b]
        if b"".join(parts_a) != (" " + text).encode() or b"".join(parts_b) != (" " + text).encode():
            return nothing
        ends_a, ends_b = list(accumulate(map(len, parts_a))), list(accumulate(map(len, parts_b)))
        groups, low = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            inside = lambda ids, ends: ",".join(str(i) for i, e in zip(ids, ends, strict=True) if low < e <= cut)  # noqa: B023, E731
            groups.append(inside(a, ends_a) + "|" + inside(b, ends_b))
            low = cut
        links = Counter()
        for i, end_a, part_a in zip(a, ends_a, parts_a, strict=True):
            for j, end_b, part_b in zip(b, ends_b, parts_b, strict=True):
                if max(end_a - len(part_a), end_b - len(part_b)) < min(end_a, end_b):
                    links[i << 32 | j] += 1
        return len(a), len(b), len(groups), ";".join(groups), links


@pytest.fixture(scope="module")
def plain():
    return Plain()


def test_alignment_of_odd_texts(plain):
    texts = [t for t in odd_texts(1200) if len(t) < 3000] + ["a ▁b", "▁", "naïve café über straße", "日本語のテキスト と 한국어"]
    nothing = 0
    for text, (n_a, n_b, n_groups, n_links, groups, pairs, times) in zip(texts, plain.aligner.align_all(texts), strict=True):
        want = plain(text)
        assert (n_a, n_b, n_groups, groups, dict(zip(pairs, times, strict=True))) == want, repr(text)
        assert n_links == want[4].total()
        nothing += not n_a
    assert 0 < nothing < len(texts)


def test_aligning_whole_texts_gives_the_same(plain):
    texts = [t for t in odd_texts(300) if len(t) < 3000] + ["one two  three\nfour"]
    whole = Aligner(A, B)
    whole.by_word = False
    order = lambda rows: [(*r[:5], dict(zip(r[5], r[6], strict=True))) for r in rows]
    assert order(whole.align_all(texts)) == order(plain.aligner.align_all(texts))


def expected(plain, data):
    """The result columns by brute force, over ``(doc_id, text)``."""
    found = [(d, *plain(t if t is None or len(t) < 3000 else "")) for d, t in data]
    docs = Counter(p for *_, links in found for p in links)
    best_a, best_b = defaultdict(int), defaultdict(int)
    for pair, n in docs.items():
        best_a[pair >> 32] = max(best_a[pair >> 32], n)
        best_b[pair & 0xFFFFFFFF] = max(best_b[pair & 0xFFFFFFFF], n)
    for d, n_a, n_b, n_groups, groups, links in found:
        yield (
            d, n_a, n_b, n_groups, links.total(), sum(n for p, n in links.items() if docs[p] == best_a[p >> 32]),
            sum(n for p, n in links.items() if docs[p] == best_b[p & 0xFFFFFFFF]),
            sum(n * docs[p] for p, n in links.items()), hashlib.sha256(groups.encode()).hexdigest() if n_a else "",
        )


@pytest.mark.parametrize("hot", [100_000, 5, 1])
def test_link_scores(spark, plain, monkeypatch, hot):
    from pyspark.sql import functions as F

    monkeypatch.setattr("lithoscan.llm.alignment.HOT_PAIRS", hot)
    data = [(d, t) for d, t, *_ in rows() if t is None or len(t) < 3000] + [(900 + i, "the the same words") for i in range(30)] + [(990, "a ▁b")]
    docs = clashing(spark.createDataFrame(data, "doc_id long, text string").repartition(3), "pairs", "n_a", "groups", "docs")
    scored = score_links(align_tokens(docs, A, B))
    sha = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    got = scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best_a", "n_best_b", "count_sum", sha)
    assert Counter(map(tuple, got.collect())) == Counter(expected(plain, data))


def test_link_counts_and_empty_tables(spark, plain):
    data = [(1, "the cat"), (2, "the the"), (2, "the cat"), (3, None)]
    aligned = materialize(align_tokens(spark.createDataFrame(data, "doc_id long, text string"), A, B), "aligned")
    want = Counter(p for _, t in data for p in plain(t)[4])
    assert {r.a_id << 32 | r.b_id: r.docs for r in link_counts(aligned).collect()} == want
    assert score_links(align_tokens(empty(spark), A, B)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows(seed=5, n=60, d=6):
    rng = np.random.default_rng(seed)
    found = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(rng.normal(size=(n, d)) * [9, 5, 3, 2, 1, 0.5] + 4)]
    found += [(100 + i, found[3][1], 1) for i in range(40)] + [(None, found[5][1], None), (7, found[5][1], 2)]
    odd = [None, [], [None] * d, [1.0] * (d - 1), [float("nan")] + [0.0] * (d - 1), [float("inf")] * d, [1.0, None, *[0.0] * (d - 2)]]
    return found + [(200 + i, v, 0) for i, v in enumerate(odd)], d


def check_whitening(got, data, d, most=4):
    good = [(i, [float(np.float32(c)) for c in v]) for i, v, _ in data if v and len(v) == d and all(c is not None and np.isfinite(c) for c in v)]
    whole = [(i, tuple(int(np.floor(256 * c)) for c in v)) for i, v in good]
    fit = sorted({x for _, x in whole})
    n, sums = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    dev = lambda x: sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
    centred = np.array(fit, float) - np.array([float(Fraction(s, n)) for s in sums])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    total = float(Fraction(sum(map(dev, fit)), n**3))
    assert Counter((r.vec_id, r.component, r.n, int(r.deviation)) for r in got) == Counter(
        (i, k + 1, n, dev(x)) for i, x in whole for k in range(len(values))
    )
    assert all(r.identity_error <= 1e-9 and abs(r.explained / (values[r.component - 1] / total) - 1) < 1e-9 for r in got)
    by_key = defaultdict(list)
    for r in got:
        by_key[r.component, int(r.deviation)].append(r.whitened)
    for k, value in enumerate(values):
        want = {dev(x): (np.array(x) - np.array(sums) / n) @ axes[:, k] / np.sqrt(value) for _, x in whole}
        sign = np.sign(sum(by_key[k + 1, key][0] * w for key, w in want.items()))
        for key, w in want.items():
            assert np.allclose(by_key[k + 1, key], sign * w, atol=1e-8)


def test_whitening(spark):
    data, d = vector_rows()
    df = clashing(spark.createDataFrame(data, VECTORS).repartition(3), "n", "component", "whitened", "deviation", "_x", "_d", "_v")
    check_whitening(whiten(df).collect(), data, d)
    assert whiten(df, most=2).agg({"component": "max"}).first()[0] == 2


def test_whitening_of_large_numbers_and_of_little(spark):
    data = [(i, [float(1 << 40) * i, 3.0 * i * i, -float(i % 3)], 0) for i in range(20)]
    got = whiten(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()
    x = [[256 * int(c) for c in v] for _, v, _ in data]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert {(r.vec_id, int(r.deviation)) for r in got} == {(i, sum((20 * c - s) ** 2 for c, s in zip(v, sums, strict=True))) for i, v in enumerate(x)}
    for few in ([], [(1, [1.0, 2.0], 0)] * 3, [(1, None, 0)]):
        none = whiten(spark.createDataFrame(few, VECTORS))
        assert none.count() == 0 and none.columns[0] == "vec_id" and len(none.columns) == 7
    two = whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [2.0, 2.0], 0), (3, [2.0, 2.0], 0)], VECTORS)).collect()
    assert len(two) == 3 and all(r.component == 1 and abs(r.explained - 1) < 1e-12 and abs(abs(r.whitened) - 1) < 1e-12 for r in two)


def test_queries_over_a_folder(spark, plain, tmp_path):
    data, d = vector_rows(6)
    spark.createDataFrame(data, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    texts = [(i, t, *rest) for i, t, *rest in rows() if t is None or len(t) < 3000]
    spark.createDataFrame(texts, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    check_whitening(queries.op11_whitening(spark, str(tmp_path)).collect(), data, d)
    want = Counter(row[:6] + row[7:] for row in expected(plain, [(i, t) for i, t, *_ in texts]))
    assert Counter(map(tuple, queries.op13_alignment(spark, str(tmp_path)).collect())) == want
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_codec.read_ranks(RANKS), special_tokens={})
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = Counter()
    for i, t, *_ in texts:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())] += 1
    assert Counter(map(tuple, queries.op12_byte_bpe(spark, str(tmp_path)).collect())) == want
