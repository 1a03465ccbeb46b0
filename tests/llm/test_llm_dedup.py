import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from hypothesis import given, settings, strategies as st

from tidemark.llm import embedding_dedup, exact_dedup, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, sha string, row string, fp long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z", 7) for i, t in rows], SCHEMA)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, sha))
    return sorted(out, key=repr)


CASES = [
    [],
    [(1, None), (2, ""), (3, " ")],
    [(1, "Abc É"), (2, "aBC É"), (3, "abc é"), (4, "abc É")],
    [(5, "x"), (5, "x"), (5, "y"), (None, "x"), (None, "z"), (None, "z")],
    [(i, "hot copy" if i % 3 else f"text {i}") for i in range(300)],
    [(1, "long " * 50_000), (2, "LONG " * 50_000), (3, "long " * 49_999)],
]


@pytest.mark.parametrize("rows", CASES)
@pytest.mark.parametrize("bits", [exact_dedup.MOST_BITS, exact_dedup.BLOCK // 8])
def test_exact_dedup_matches_brute_force(spark, rows, bits):
    found = exact_dedup.exact_dedup(docs(spark, rows), most_bits=bits).collect()
    assert sorted(map(tuple, found), key=repr) == expected_exact(rows)


@pytest.mark.parametrize("rows", CASES)
def test_keep_one_of_each_keeps_all_columns(spark, rows):
    df = docs(spark, rows)
    kept = exact_dedup.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((i is None, i or 0, t or "") for i, t in dict(((lowered(t), i), (i, t)) for i, t in rows if any(e[0] == i and e[3] and e[4] == hashlib.sha256(lowered(t).encode()).hexdigest() for e in expected_exact(rows))).values())


def test_slices_of_the_filter_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BITS_EACH", 3 * exact_dedup.BLOCK)
    rows = [(i, f"text {i % 70}" if i % 2 else f"single {i}") for i in range(400)]
    df = docs(spark, rows)
    keys = exact_dedup.keyed(df, "doc_id", "text")
    bloom = exact_dedup.Filter(keys, exact_dedup.BLOCK * 30)
    assert bloom.slices == 4 and bloom.blocks % bloom.slices == 0
    tested = bloom.tested(keys.withColumn("slice", bloom.slice(exact_dedup._hash(F.col("sha"))))).collect()
    assert len(tested) == 400 and all(r.maybe for r in tested if r.doc_id % 2) and sum(r.maybe for r in tested) < 240
    assert sorted(map(tuple, exact_dedup.exact_dedup(df, most_bits=exact_dedup.BLOCK * 30).collect()), key=repr) == expected_exact(rows)
    kept = exact_dedup.keep_one_of_each(df, most_bits=exact_dedup.BLOCK * 30)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(e[0] for e in expected_exact(rows) if e[3])


def test_single_rows_pass_the_filter(spark):
    """Of rows that stand alone nearly all pass straight through, however few repeated ones there are."""
    rows = [(i, f"alone {i}") for i in range(3000)] + [(9000 + i, f"twice {i // 2}") for i in range(600)]
    keys = exact_dedup.keyed(docs(spark, rows), "doc_id", "text")
    tested = exact_dedup.Filter(keys, exact_dedup.MOST_BITS).tested(keys).collect()
    assert all(r.maybe for r in tested if r.doc_id >= 9000) and sum(r.maybe for r in tested if r.doc_id < 9000) < 60


def slow_fingerprint(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered(text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aB é\n\t\x0b\x1c\xa0", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint_matches_definition(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_links_lose_no_component(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        seed = rng.getrandbits(64)
        for _ in range(12):
            x = seed
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    pairs = [(int(np.int64(r.u).view(np.uint64)), int(np.int64(r.v).view(np.uint64))) for r in simhash.links(frame).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in pairs)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    truth = components(fps)
    assert len({(t, find(f)) for t, f in zip(truth, fps)}) == len(set(truth)) == len({find(f) for f in fps})


def test_large_group_is_split_exactly(monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT_AT", 16)
    rng = random.Random(1)
    fps = {rng.getrandbits(36) << 28 for _ in range(200)}
    for f in list(fps)[:60]:
        fps.add(f ^ 1 << rng.randrange(34, 60) ^ 1 << rng.randrange(34, 60))
    fps = np.array(sorted(fps), np.uint64)
    parent = {int(f): int(f) for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in simhash._forest(fps, 0):
        for a, b in zip(u, v):
            parent[find(int(a))] = find(int(b))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :])
    chained = near <= 3
    for i, j in zip(*np.nonzero(chained)):
        if simhash._near(fps[i], fps[j : j + 1], 0)[0]:
            assert find(int(fps[i])) == find(int(fps[j]))


def test_keys_over_many_batches_are_linked_whole():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    key = np.sort(np.concatenate([np.full(500, 7), rng.integers(0, 40, 300)]))
    fp = rng.integers(0, 1 << 62, len(key)) & ~0xFF | rng.integers(0, 4, len(key))
    fp[key == 7] = (5 << 40) + np.arange((key == 7).sum()) % 200
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(key[a:b]), pa.array(fp[a:b])], ["key", "fp"])
    links = lambda cuts: sorted((u, v) for out in simhash._links(batch(a, b) for a, b in zip(cuts, cuts[1:])) for u, v in zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
    assert links([0, len(key)]) == links([0, 1, 3, 3, 120, 130, 400, 401, len(key)]) != []


@pytest.mark.parametrize("rows", CASES)
def test_simhash_matches_brute_force(spark, rows):
    found = simhash.near_dedup(docs(spark, rows)).collect()
    fps = [slow_fingerprint(t) for _, t in rows]
    groups = components(fps)
    low = {}
    for (i, _), g in zip(rows, groups):
        if i is not None:
            low[g] = min(i, low.get(g, i))
    want = sorted((i is None, i or 0, f, low.get(g)) for (i, _), f, g in zip(rows, fps, groups))
    assert sorted((r.doc_id is None, r.doc_id or 0, int(np.int64(r.fp).view(np.uint64)), r.component_id) for r in found) == want


def test_simhash_stage_keeps_one(spark):
    base = " ".join(f"w{i}" for i in range(400))
    df = docs(spark, [(3, base), (1, base + " tail"), (2, "other text entirely here"), (None, base)])
    assert sorted(str(r.doc_id) for r in simhash.keep_one_of_each(df).collect()) == ["1", "2", "None"]


def test_embedding_dedup_recall_and_edges(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(300, 24))
    rows = []
    for c in centres:
        for _ in range(int(rng.integers(1, 5))):
            rows.append((len(rows), (c + rng.normal(size=24) * rng.choice([0, 0.05, 0.2])).astype(np.float32).tolist()))
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 24), (n + 3, [float("nan")] + [1.0] * 23), (n + 4, [None] + [1.0] * 23), (n + 5, rows[0][1][:12]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, n int, node int")
    got = {r.vec_id: r for r in embedding_dedup.near_dedup(df).collect()}
    x = np.array([v for _, v in rows[:n]], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.9
    truth = links.sum(axis=1) - 1
    mine = np.array([got[i].n_links for i in range(n)])
    assert (mine <= truth).all() and mine.sum() >= 0.97 * truth.sum()
    for i in [n, n + 1, n + 2, n + 3, n + 4, n + 5]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert embedding_dedup.near_dedup(df.limit(0)).count() == 0


def test_large_cells_are_parted_exactly(spark, monkeypatch):
    """One cell of near copies in blocks gives the links and components of one group, and of brute force."""
    rng = np.random.default_rng(6)
    x = np.concatenate([c + rng.normal(size=(150, 32)) * 0.12 for c in rng.normal(size=(2, 32))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = ((u @ u.T) >= 0.9).sum(axis=1) - 1
    whole = {r.vec_id: tuple(r) for r in embedding_dedup.near_dedup(df).collect()}
    monkeypatch.setattr(embedding_dedup, "MOST_CELL", 40)
    parted = {r.vec_id: tuple(r) for r in embedding_dedup.near_dedup(df).collect()}
    assert parted == whole
    assert sum(r[1] for r in parted.values()) >= 0.97 * truth.sum() and all(r[1] <= truth[i] for i, r in parted.items())
    assert {r[2] for r in parted.values()} == {0, 150}


def test_components_with_hubs(spark, monkeypatch):
    """Stars, chains and a hub with most edges, with every node of degree 3 or more taken for a hub."""
    from tidemark.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 3)
    monkeypatch.setattr(common, "HOT_SHARE", 10**9)
    rng = random.Random(2)
    edges = [(1000, i) for i in range(200)] + [(i, i + 1) for i in range(2000, 2060)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(300)] + [(5, 5), (1000, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "u long, v long"), "t").collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_embedding_dedup_doubles_and_cells(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(200, 16))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.15])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = ((u @ u.T) >= 0.9).sum() - len(x)
    got = sum(r.n_links for r in embedding_dedup.near_dedup(df).collect())
    assert truth > 100 and 0.93 * truth <= got <= truth
