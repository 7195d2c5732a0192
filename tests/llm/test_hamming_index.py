"""Nearest vectors against brute force: recall, ties, copies, scale, unusable rows."""

import math

import numpy as np
import pytest

from roadspark.llm import hamming_index
from roadspark.llm.hamming_index import TABLES, _within, nearest_vectors

SCHEMA = "vec_id long, embedding array<float>, score double, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0.5, 9) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k=5):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) == len(rows[0][1]) and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    out = {}
    for n, (i, _) in enumerate(good):
        if i % 50 == 0:
            s = np.round(x @ x[n], 12)
            out[i] = sorted(((-s[m], j) for m, (j, _) in enumerate(good) if m != n))[:k]
    return out


def recall(spark, rows):
    df = table(spark, rows)
    got = {}
    for r in nearest_vectors(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want, hits, total = brute(rows), 0, 0
    assert set(got) == set(want)
    vectors = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if i is not None and v is not None and None not in v}
    for q, top in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, len(top) + 1))
        assert [(-round(s, 12), i) for _, i, s in mine] == sorted((-round(s, 12), i) for _, i, s in mine)
        for _, i, s in mine:
            a, b = vectors[q], vectors[i]
            assert math.isclose(s, float(a @ b) / math.sqrt(float(a @ a)) / math.sqrt(float(b @ b)), abs_tol=1e-12)
        hits += len({i for _, i, _ in mine} & {i for _, i in top})
        total += len(top)
    return hits / total


def test_pigeonhole_finds_every_code_once():
    rng = np.random.default_rng(1)
    b = rng.integers(0, 1 << 32, (400, TABLES), dtype=np.uint64).astype(np.uint32)
    flips = np.packbits(rng.random((60, 32 * TABLES)) < rng.choice([0.02, 0.1, 0.3], 60)[:, None], axis=1).view("<u4")
    a = b[:60] ^ flips
    r = rng.integers(0, 170, 60)
    found = [pair for j in range(TABLES) for pair in zip(*(x.tolist() for x in _within(j, a, r, b)), strict=True)]
    far = np.bitwise_count(a[:, None, :] ^ b[None]).sum(axis=2)
    assert sorted(found) == sorted(zip(*(x.tolist() for x in np.nonzero(far <= r[:, None])), strict=True))


@pytest.mark.parametrize("n,d", [(3000, 64), (1200, 7), (400, 500)])
def test_recall(spark, n, d):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(n, d))
    x[n // 2 : n // 2 + 200] = x[5] + 0.1 * rng.normal(size=(200, d))
    assert recall(spark, list(enumerate(x.tolist()))) >= 0.9


def test_copies_ties_scales_and_unusable_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(160, 8)).round(2).tolist()
    rows = [(k, v) for k, v in enumerate(x)]
    rows += [(k, x[0]) for k in range(200, 300)]  # one vector in a third of all rows
    rows += [(301, [1e30 * v for v in x[50]]), (350, [0.0] * 8), (351, None), (400, [float("nan")] * 8), (450, [None] * 8), (452, [1.0, 2.0]), (None, x[3]), (500, [1e-30 * v for v in x[7]])]
    assert recall(spark, rows) >= 0.9
    df = table(spark, rows)
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in nearest_vectors(df, df.where("vec_id IN (0, 250)")).collect()}
    assert [found[0, k][0] for k in range(1, 6)] == [200, 201, 202, 203, 204] and [found[250, k][0] for k in range(1, 6)] == [0, 200, 201, 202, 203]


def test_few_rows(spark):
    df = table(spark, [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (7, [-1.0, 0.0])])
    got = sorted((r.query_id, r.rank, r.vec_id) for r in nearest_vectors(df, df.where("vec_id % 50 = 0")).collect())
    assert got == [(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)]
    assert nearest_vectors(df.where("vec_id < 0"), df.where("vec_id < 0")).count() == 0
    alone = df.where("vec_id = 0")
    assert nearest_vectors(alone, alone).count() == 0


def test_the_sample_takes_few_rows_of_each_task(spark):
    classes = spark.range(20_000).repartition(16).selectExpr("id AS class_id", "array(CAST(id AS FLOAT)) AS embedding")
    low = hamming_index.least_hashes(classes, 64)
    least = lambda df: [r["class_id"] for r in df.selectExpr("class_id", "xxhash64(class_id) AS h").orderBy("h", "class_id").limit(64).collect()]
    assert 64 <= low.count() < 512 and least(low) == least(classes)
    assert hamming_index.least_hashes(classes.limit(100), 64).count() == 100


def test_lists_and_scans_find_the_same_codes(monkeypatch):
    monkeypatch.setattr(hamming_index, "LIST", 4)
    rng = np.random.default_rng(3)
    b = rng.integers(0, 1 << 32, (900, TABLES), dtype=np.uint64).astype(np.uint32)
    r = rng.choice([0, 5, 11, 30, 150, 384], 80)
    flips = np.packbits(rng.random((80, 32 * TABLES)) < (r / 384 * 0.8)[:, None], axis=1).view("<u4")
    a = b[:80] ^ flips
    found = sorted(pair for q, p in hamming_index._near(a, r, b) for pair in zip(q.tolist(), p.tolist(), strict=True))
    far = np.bitwise_count(a[:, None, :] ^ b[None]).sum(axis=2)
    assert found == sorted(zip(*(x.tolist() for x in np.nonzero(far <= r[:, None])), strict=True))


def test_pairs_within_a_radius_are_not_rows(spark, monkeypatch):
    """They were, with both their vectors, and grew with the square of the table."""
    monkeypatch.setattr(hamming_index, "INDEX_BYTES", 1 << 15)
    monkeypatch.setattr(hamming_index, "QUERY_BYTES", 1 << 11)
    x = np.random.default_rng(4).normal(size=(900, 16)).tolist()
    classes = hamming_index.classes_of(hamming_index.usable(table(spark, list(enumerate(x)))), 5)
    found = hamming_index.search_classes(classes, classes.where("class_id % 50 = 0"), 5)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for row in found.collect():
        got.setdefault(row["query_class"], []).append(row["class_id"])
    want = brute(list(enumerate(x)))
    assert set(got) == set(want) and all(len(v) == 6 and q in v for q, v in got.items())
    assert sum(len({i for _, i in want[q]} & set(v)) for q, v in got.items()) >= 0.9 * 5 * len(want)
