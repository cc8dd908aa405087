"""Every registered query of the subpackage over a small folder of odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from public_tokenizers import path as tokenizer_file
from pyspark.sql import functions as F

from lithoscan.llm import queries
from lithoscan.llm.tokens import ByteBPE

from .data import SCHEMA, clashing, rows, sentence
from .test_leaks_pages import pages


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng, out = random.Random(1), str(tmp_path_factory.mktemp("tables"))
    data = [*rows(), (77, "long " * 6000, "en", "s", 30000)]
    docs = clashing(spark.createDataFrame(data, SCHEMA).repartition(3))
    docs.write.parquet(f"{out}/documents.parquet")
    docs.limit(0).write.parquet(f"{out}/none/documents.parquet")
    pages(spark)[1].write.parquet(f"{out}/pages.parquet")
    items = [(1, sentence(rng, 20)), (2, data[4][1]), (3, None), (4, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    labels = [(d, int(i % 3 == 0)) for i, (d, *_) in enumerate(data) if i % 2]
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{out}/labels.parquet")
    vectors = [(i % 9, [float(i), float(i * i % 7), -0.5], 0) for i in range(20)] + [(77, None, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{out}/embeddings.parquet")
    for name in ("pages", "benchmark", "labels", "embeddings"):
        spark.read.parquet(f"{out}/{name}.parquet").limit(0).write.parquet(f"{out}/none/{name}.parquet")
    return out, data


def remainder(d, n):
    return zlib.crc32(b"" if d is None else str(d).encode()) % n


def test_line_and_exact_dedup(spark, folder):
    out, data = folder
    lines = queries.op1_line_dedup(spark, out).collect()
    assert Counter((r.doc_id, r.n_lines) for r in lines) == Counter((d, (t or "").count("\n") + 1) for d, t, *_ in data)
    for r in lines:
        if not r.n_dropped:
            texts = {hashlib.sha256((t or "").encode()).hexdigest() for d, t, *_ in data if d == r.doc_id}
            assert r.kept_sha256 in texts
    copies = Counter(t or "" for _, t, *_ in data)
    got = queries.op3_exact_dedup(spark, out).collect()
    sha = {hashlib.sha256(t.encode()).hexdigest(): n for t, n in copies.items()}
    assert len(got) == len(data) and all(sha[r.text_sha256] == r.group_size for r in got)


def test_packing_digests(spark, folder):
    out, data = folder
    encode = ByteBPE(tokenizer_file("byte_bpe_50k.json")).encode
    ids = defaultdict(list)
    for d, t, *_ in data:
        ids[d].append(encode(t or "") + np.array([1], "<u4").tobytes())
    places = defaultdict(list)
    for r in queries.op2_packing(spark, out).collect():
        wanted = {zlib.crc32(x[4 * r.start : 4 * (r.start + r.length)]) for x in ids[r.doc_id] if len(x) == 4 * r.doc_tokens}
        assert r.ids_crc32 in wanted
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        ends = np.cumsum([0, *(n for _, n in sorted(parts))])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 2048
    assert sum(n for p in places.values() for _, n in p) == sum(len(x) // 4 for own in ids.values() for x in own)


def test_counts_shards_and_marks(spark, folder):
    out, data = folder
    counts = queries.op6_token_counts(spark, out).collect()
    assert any(r.over_limit for r in counts) and all(r.over_limit == (r.n_tokens > 4096) for r in counts)
    assert Counter((r.doc_id, r.n_bytes) for r in counts) == Counter((d, len((t or "").encode())) for d, t, *_ in data)
    shards = queries.op8_sharding(spark, out).collect()
    assert {r.law for r in shards} == {"key"} and all(0 <= r.shard < 24 and r.grown_shard in (r.shard, 24) for r in shards)
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in data)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in shards) == want
    scores = queries.op9_toxicity(spark, out).collect()
    assert Counter((r.doc_id, r.held_out) for r in scores) == Counter((d, remainder(d, 5) == 0) for d, *_ in data)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scores)
    model = queries.op10_brown_lm(spark, out).collect()
    assert Counter((r.doc_id, r.held_out) for r in model) == Counter((d, remainder(d, 7) == 2) for d, *_ in data)
    tokens = sum(len((t or "").encode().split()) + 1 for d, t, *_ in data if remainder(d, 7) != 2)
    assert {r.train_tokens for r in model} == {tokens}


def test_leaks_pages_and_near_groups(spark, folder):
    out, data = folder
    text = " ".join((data[4][1] or "").lower().split())
    found = {r.doc_id for r in queries.op4_decontaminate(spark, out).where("item_id = 2").collect()}
    assert found >= {d for d, t, *_ in data if text in " ".join((t or "").lower().split())}
    for r in queries.op5_html_extract(spark, out).collect():
        assert r.n_chars == len(r.text)
    near = queries.op7_near_dedup(spark, out).collect()
    assert Counter(r.doc_id for r in near) == Counter(d for d, *_ in data) and all(r.kept == (r.doc_id == r.component_id) for r in near)


def test_empty_tables_give_empty_results(spark, folder):
    out, _ = folder
    for name, query in queries.queries().items():
        assert query(spark, f"{out}/none").count() == 0, name
