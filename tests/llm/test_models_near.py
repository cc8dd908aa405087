import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lithoscan.llm.brown_lm import exchange_clusters, exchange_sides, score_brown, train_brown
from lithoscan.llm.components import connected_components
from lithoscan.llm.near_dedup import drop_near_copies, near_groups, part_tokens
from lithoscan.llm.toxicity import drop_toxic, score_toxicity, train_toxicity

from .data import SCHEMA, clashing, empty, frame, rows, sentence

LOWEST = -(2**63)


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(data, width):
    sets, root = [shingles(t, width) for _, t, *_ in data], list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    ids = [LOWEST if d is None else d for d, *_ in data]
    low = {}
    for i in range(len(data)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return Counter(
        (data[i][0], len(sets[i]), None if low[find(i)] == LOWEST else low[find(i)], ids[i] == low[find(i)]) for i in range(len(data))
    )


@pytest.mark.parametrize("width", [2, 5])
def test_near_groups_against_brute_force(spark, width):
    rng, data = random.Random(3), rows()
    for base in range(6):
        own = sentence(rng, rng.randrange(20, 150)).split(" ")
        for copy in range(8):
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(99)}"
            data.append((500 + 10 * base + copy, " ".join(own), None, None, 0))
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = near_groups(clashing(df, "node", "a", "b"), width=width).collect()
    assert Counter(map(tuple, got)) == components(data, width)


@pytest.mark.parametrize("copies, options", [(2000, {}), (100, {"trees": 1, "reach": 1, "crowd": 16, "side": 8})])
def test_near_copies_that_only_the_original_links(spark, copies, options):
    rng = random.Random(11)
    own = [f"w{i}" for i in range(300)]
    data = [(copies, " ".join(own))]  # not the lowest id
    for copy in range(copies):
        text = list(own)
        for at in rng.sample(range(5, 295), 6):
            text[at] = f"x{copy}x{at}"
        data.append((copy, " ".join(text)))
    sets = [shingles(t, 5) for _, t in data[:12]]
    similar = [[100 * len(a & b) >= 80 * len(a | b) for b in sets] for a in sets]
    assert all(similar[0]) and sum(map(sum, similar[1:])) <= 2 * 11 + 6  # hardly any pair of copies
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert {r.component_id for r in near_groups(df, **options).collect()} == {0}


def test_near_groups_without_the_forest(spark):
    rng, data = random.Random(5), []
    for base in range(4):
        own = sentence(rng, 60).split(" ")
        for copy in range(25):
            text = list(own)
            for _ in range(rng.randrange(6)):
                text[rng.randrange(len(text))] = f"new{rng.randrange(9)}"
            data.append((100 * base + copy, " ".join(text)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    # Lists of a part fill many tiles, some are crowds: the exact part finds all links.
    got = near_groups(df, width=2, trees=1, depth=6, min_prefix=6, crowd=6, side=4).collect()
    assert Counter(map(tuple, got)) == components(data, 2)


@pytest.mark.parametrize("share", [80, 90, 60])
def test_linked_sets_share_a_part(share):
    rng, linked = np.random.default_rng(share), 0
    for i in range(6000):
        n = int(rng.integers(1, 60 if i % 2 else 900))
        pool = rng.integers(0, 2**63, 3 * n, dtype=np.uint64)
        few = max(1, (100 - share) * n // share)
        a = np.unique(pool[:n])
        b = np.unique(np.r_[a[int(rng.integers(0, few + 1)) :], pool[n : n + int(rng.integers(0, few + 1))]])
        both, all_ = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * both >= share * all_ and both != all_:
            linked += 1
            assert len(np.intersect1d(part_tokens(a, share), part_tokens(b, share)))
    assert linked > 1000


def test_recall_in_a_crowded_region(spark):
    """Unlinked documents that share most words, each with one linked partner."""
    rng, data = random.Random(1), []
    base = [f"w{i}" for i in range(300)]
    for i in range(150):
        text = list(base)
        for k in range(50):
            text.insert(rng.randrange(len(text)), f"own{i}x{k}")
        data.append((2 * i, " ".join(text)))
        for k in rng.sample(range(len(text)), 30):
            text[k] = f"new{i}x{k}"
        data.append((2 * i + 1, " ".join(text)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = near_groups(df, width=1).collect()
    assert Counter(map(tuple, got)) == components(data, 1)
    assert len({r.component_id for r in got}) == 150


def test_components_of_many_tasks(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(1000 + i, 1001 + i) for i in range(60)]
    df = spark.createDataFrame(links, "a long, b long")
    root = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in root:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    for task_edges in (7, 10_000):
        got = connected_components(df, task_edges).collect()
        assert {r.node: r.root for r in got} == root and len(got) == len(root)


def test_drop_near_copies_and_empty_tables(spark):
    assert near_groups(empty(spark)).count() == drop_near_copies(empty(spark)).count() == 0
    df = frame(spark).where("doc_id BETWEEN 0 AND 34 AND text != 'another text under the same id'").dropDuplicates(["doc_id"])
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    want = {r.doc_id for r in near_groups(df).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want and len(want) < 35


def test_toxicity_on_held_out_rows(spark):
    rng, data, labels = random.Random(9), [], []
    for i in range(500):
        toxic = int(i % 4 == 0)
        text = sentence(rng, rng.randrange(10, 120)).split(" ")
        if toxic:
            for w in rng.sample(["blorkish", "snarfle", "grumbuzz", "blorker"], 2):
                text.insert(rng.randrange(len(text)), w)
        data.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, toxic))
    df = spark.createDataFrame(data, SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (1, 0)], "doc_id long, toxic int")
    model = train_toxicity(clashing(df, "toxic").where("doc_id % 5 != 0"), marks)
    found = {r.doc_id: r.predicted for r in score_toxicity(clashing(df), model).where("doc_id % 5 = 0").collect()}
    assert sum(found[i] == labels[i][1] for i in found) >= 0.97 * len(found)
    odd = score_toxicity(frame(spark), model).collect()
    assert len(odd) == len(rows()) and all(0 <= r.score <= 1 for r in odd)
    kept = drop_toxic(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {i for i, t in labels if not t} - {-1}
    none = train_toxicity(df, marks.limit(0))
    assert {round(r.score, 6) for r in score_toxicity(df, none).collect()} == {0.001}
    assert score_toxicity(empty(spark), model).count() == drop_toxic(empty(spark), model).count() == 0


def test_language_model(spark):
    data = rows()
    train = [(d, t) for d, t, *_ in data if d is None or d % 5]
    counts = Counter()
    for _, t in train:
        counts.update(words(t))
        counts["</end>"] += 1
    n, v = sum(counts.values()), len(counts)
    df = frame(spark)
    small = {"cluster_words": 10, "history_words": 20, "lookup_words": 40, "classes": 5}
    model = train_brown(clashing(df).where("doc_id IS NULL OR doc_id % 5 != 0"), **small)
    assert (model.tokens, model.distinct) == (n, v)
    kind = {w: model.member[i + 1] for i, w in enumerate(model.lookup)}
    rest = {bytes(r["word"]): (r["class"], r["n"]) for r in model.assigned.collect()}
    coded = {w.encode(): k for w, k in counts.items() if w != "</end>"}
    assert {w: k for w, (_, k) in rest.items()} == {w: k for w, k in coded.items() if w not in model.lookup[:20]}
    assert all(kind[w] == rest[w][0] for w in model.lookup[20:])  # every counted word has one class, and none the end's
    kind |= {w: c for w, (c, _) in rest.items()}
    assert set(kind) == set(coded) and 0 < min(kind.values()) <= max(kind.values()) < 5 and len(set(kind.values())) > 2
    rare, states = 5, {w: kind[w] for w in model.lookup[:20]}
    moves = np.zeros((6, 5))
    for _, t in train:
        own = [w.encode() for w in words(t)]
        before = [0, *(states.get(w, rare) for w in own)]
        for s, c in zip(before, [*(kind[w] for w in own), 0]):
            moves[s, c] += 1
    assert (moves == model.moves).all()
    size = Counter({0: counts["</end>"] + 1})
    for w, k in coded.items():
        size[kind[w]] += k + 1
    size[model.unseen] += 1
    log_move = model.log_move
    assert np.allclose((10.0**log_move).sum(1), 1)  # all that can follow a state

    def scored(t):
        own, s, total = [w.encode() for w in words(t)], 0, 0.0
        for w in own:
            c = kind.get(w, model.unseen)
            total += log_move[s, c] + math.log10((coded.get(w, 0) + 1) / size[c])
            s = states.get(w, rare)
        return total + log_move[s, 0] + math.log10((counts["</end>"] + 1) / size[0])

    got = score_brown(clashing(df, "word", "state", "_row"), model).collect()
    want = Counter()
    for d, t, *_ in data:
        own = [*words(t), "</end>"]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        want[d, len(own), sum(counts[w] > 0 for w in own), n, round(base, 5), round(scored(t), 5)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got) == want
    assert score_brown(empty(spark), model).count() == 0
    none = train_brown(empty(spark), **small)
    assert none.tokens == 0 and all(r.score < 0 for r in score_brown(df, none).collect())


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(4)
    kind = rng.integers(0, 3, 30)
    pairs = rng.poisson(np.where((kind[:, None] + 1) % 3 == kind[None, :], 9.0, 0.5)).astype(float)

    def likelihood(member):
        table = np.zeros((4, 4))
        np.add.at(table, (member[:, None], member[None, :]), pairs)
        both = np.outer(table.sum(1), table.sum(0))
        return (table * np.log(np.where(table > 0, table, 1) / both)).sum()

    fixed = exchange_clusters(pairs, 4, 3, {0: 0, 29: 3})
    assert (fixed[1:29] != 0).all() and (fixed[:29] != 3).all() and fixed[29] == 3
    # By their counts beside known words, the others find the classes that made them.
    order = np.append(0, 1 + np.argsort(kind[1:], kind="stable"))[np.r_[0, 1:29:3, 2:29:3, 3:30:3]]
    sides = np.concatenate([np.stack([pairs[:, kind == k].sum(1) for k in range(3)], 1) + 0.0, np.stack([pairs[kind == k].sum(0) for k in range(3)], 1)], 1)
    found = exchange_sides(sides[order], 1 + kind[order], 15, 4, 5)
    assert (found[15:] == 1 + kind[order][15:]).mean() > 0.9
    steps = [likelihood(exchange_clusters(pairs, 4, n)) for n in (0, 1, 2, 10)]
    assert all(x <= y + 1e-9 for x, y in zip(steps, steps[1:])) and steps[-1] > steps[0] + 50


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    rng, data = random.Random(2), []
    item = "a quite special benchmark item of several words that must not be trained on"
    for i in range(80):
        data.append((i, sentence(rng, 60), "en", "s", 0))
    toxic = {i: f"blorkish {sentence(rng, 30)} snarfle {sentence(rng, 8)}" for i in range(100, 140)}
    near = data[10][1].split(" ")
    near[0] = "changed"
    data += [(i, t, "en", "s", 0) for i, t in toxic.items()]
    long = sentence(rng, 9000)
    data += [(300, None, None, None, None), (301, "", "en", "s", 0), (302, long, "en", "s", 0), (303, long, "en", "s", 0), data[12]]
    data += [(None, sentence(rng, 50), "en", "s", 0), (304, "two words", None, None, 0), (305, "two words ", None, None, 0)]
    data += [(200, data[5][1], "en", "s", 0), (201, " ".join(near), "en", "s", 0), (202, f"{sentence(rng, 20)} {item} {sentence(rng, 9)}", "en", "s", 0)]
    docs = clashing(spark.createDataFrame(data, SCHEMA))
    labels = [(d, int(d in toxic)) for d, *_ in data if d is not None and d % 2 and d < 200]
    tables = {"documents": docs, "labels": spark.createDataFrame(labels, "doc_id long, toxic int")}
    tables["benchmark"] = spark.createDataFrame([(1, item)], "item_id long, text string")
    for name, rows_ in tables.items():
        rows_.write.parquet(f"{tmp_path}/{name}.parquet")
        rows_.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Toxic documents, copies but the largest id, near copies but the smallest and leaks go.
    assert {r.doc_id for r in packed} == (set(range(80)) - {5}) | {200, 301, 303, 304, None}
    for doc in {r.doc_id for r in packed}:
        parts = [r for r in packed if r.doc_id == doc]
        assert sum(r.length for r in parts) == parts[0].doc_tokens
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontaminate", "packing"]
    assert zlib.crc32(b"") == 0
