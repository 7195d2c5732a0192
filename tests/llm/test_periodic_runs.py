"""Periodic runs against brute force: periodic, planted, odd, null and very long texts."""

import hashlib
import random
import re
import zlib

import numpy as np

from roadspark.llm.periodic_runs import Extensions, find_runs, periodic_runs, replanted, runs_digest


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def brute_runs(w, least=24, repeats=3):
    out, n = {}, len(w)
    for p in range(1, n // repeats + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, repeats * p):
                out.setdefault((i, j + p), p)
            i = j
    return sorted((s, e - s, p) for (s, e), p in out.items())


def brute(doc_id, text):
    w = words_of(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    dropped = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = (None,) * 4
    for s, m, p in runs:
        if best[0] is None or m * best[2] > best[1] * p:
            best = (s, m, p, 1000 * m // p)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_extensions_and_runs_of_random_words():
    rng = np.random.default_rng(3)
    for n, letters in ((1, 1), (30, 1), (200, 1), (500, 2), (2000, 3), (700, 500)):
        x = np.concatenate([rng.integers(0, letters, n), [10_000]])
        if letters == 3:
            x[400:1300] = np.resize(x[400:450], 900)
            x[1000] = 7
        e = Extensions(x)
        i, j = rng.integers(0, n + 1, 3000), rng.integers(0, n + 1, 3000)
        i, j = i[i != j], j[i != j]
        for a, b, got in zip(i.tolist(), j.tolist(), e.common(i, j).tolist(), strict=True):
            k = 0
            while a + k < len(x) and b + k < len(x) and x[a + k] == x[b + k]:
                k += 1
            assert got == k
        joined = np.concatenate([[20_000], x])
        assert [tuple(r) for r in find_runs(joined, np.array([1]), np.array([n])).tolist()] == [(s + 1, m, p) for s, m, p in brute_runs(x[:-1].tolist())]


def texts():
    rng = random.Random(11)
    out = [None, "", " \t\n ", "a", "a " * 23, "a " * 24, "a b " * 12, " x" * 5000, "a b " * 30, "a\x1cb\x0bc\x0cd " * 40, "same words here " * 9, "same words here " * 9]
    for _ in range(150):
        n, letters = rng.choice((5, 40, 200, 900)), rng.choice((1, 2, 3, 50, 1000))
        w = [f"w{rng.randrange(letters)}" for _ in range(n)]
        for _ in range(rng.randrange(4)):
            at, p = rng.randrange(n), rng.randrange(1, 40)
            m = rng.randrange(2, 7) * p + rng.randrange(p)
            w[at : at + m] = [w[at + k % max(1, min(p, n - at))] for k in range(min(m, n - at))]
        out.append(rng.choice((" ", "\n", " \t ")).join(w))
    long = [f"u{rng.randrange(20000)}" for _ in range(9000)]
    long[1000:7000] = [long[1000 + k % 1900] for k in range(6000)]
    return [*out, " ".join(long)]


def test_query_against_brute_force(spark):
    rows = [(None if k == 7 else k - 3, t, "clash", 1) for k, t in enumerate(texts())]
    rows.append(rows[11])
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed int").repartition(3)
    got = [tuple(r) for r in runs_digest(periodic_runs(replanted(docs))).collect()]
    assert sorted(got, key=str) == sorted((brute(i, t) for i, t, _, _ in rows), key=str)
    assert any(r[1] > 1 for r in got) and sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] > 0 for r in got) > 3
    assert runs_digest(periodic_runs(replanted(docs.where("doc_id > 1000000")))).count() == 0


def test_operator_returns_runs_and_texts(spark):
    docs = spark.createDataFrame([(1, "start " + "one two three " * 10 + "end"), (2, "a b c d")], "n long, body string")
    got = {r.doc_id: r for r in periodic_runs(docs, "n", "body").collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 30, 3)] and got[1].collapsed == "start one two three end"
    assert got[2].runs == [] and got[2].collapsed == "a b c d"
    short = periodic_runs(spark.createDataFrame([(1, "a b a b a")], "doc_id long, text string"), least=4, repeats=2).first()
    assert [tuple(r) for r in short.runs] == [(0, 5, 2)] and short.collapsed == "a b"
