"""Nearest vectors by multi-index hashing of learned binary codes.

A bounded sample fits rotations that bring vectors close to the corners of a cube (iterative quantisation); the signs
after rotation are a vector's code. Codes are cut into substrings and listed under each of them. A query's radius follows
from its k-th nearest vector of the sample: codes of vectors nearer than that lie within it, but for a small share. By
the pigeonhole principle a code within radius r agrees with the query in some substring j up to (r - j) // m bits, so the lists
probed there hold every code within the radius; those are reranked by the vectors themselves. A query whose radius reaches
most lists reads the codes once instead of every list of every table, with the same codes found.

Blocks of queries meet blocks of vectors in a task each, which has an index of its own and hands on the k nearest that it
finds for each query: pairs within a radius, whose number grows with the square of the vectors, are never rows.

Equal vectors are one class throughout, so a vector that very many rows share is indexed and searched for once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadspark.llm.common import stored

BITS, WIDE = 384, 32  # of a code, of a substring
TABLES = BITS // WIDE
SAMPLE, SAMPLE_BYTES = 8192, 16 << 20
ROUNDS = 10
MARGIN = 0.9  # standard deviations of the differing bits beyond their mean
LIST = 512  # codes that a list is meant to hold
PAIRS = 1 << 18  # pairs of codes compared at once
QUERY_BYTES, INDEX_BYTES = 64 << 20, 32 << 20  # of the vectors of a block, in double precision
LEAST_BLOCK = 4096  # vectors below which a block isn't split for more tasks


class Codes(NamedTuple):
    """What a sample taught: rotations (dimensions, BITS) and the sample's unit vectors."""

    rotations: np.ndarray
    sample: np.ndarray


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision, whatever their scale."""
    wide = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit_codes(vectors: np.ndarray, seed: int = 12) -> Codes:
    """Rotations for unit vectors: the signs of each are turned until they settle, starting from as many random ones as needed."""
    x, rng = vectors.astype(np.float32), np.random.default_rng(seed)
    d, parts = x.shape[1], []
    basis = np.linalg.svd(x.T @ x)[0][:, :BITS] if d > BITS else np.eye(d, dtype=np.float32)
    low = x @ basis
    for _ in range(-(-BITS // low.shape[1])):
        turn = np.linalg.qr(rng.normal(size=(low.shape[1],) * 2))[0].astype(np.float32)
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(low.T @ np.where(low @ turn > 0, np.float32(1), np.float32(-1)))
            turn = u @ v
        parts.append(basis @ turn)
    return Codes(np.concatenate(parts, axis=1)[:, :BITS].astype(np.float32), x)


def encode(vectors: np.ndarray, codes: Codes) -> np.ndarray:
    """(n, TABLES) unsigned 32-bit substrings of unit vectors."""
    return np.packbits(vectors.astype(np.float32) @ codes.rotations > 0, axis=1).view("<u4")


def radii(vectors: np.ndarray, codes: Codes, k: int) -> np.ndarray:
    """Differing bits within which the k nearest of each vector are looked for; all, where the sample is too small."""
    out = np.full(len(vectors), BITS, dtype=np.int64)
    for at in range(0, len(vectors), 256):
        near = vectors[at : at + 256].astype(np.float32) @ codes.sample.T
        if near.shape[1] <= k:
            continue
        top = -np.sort(np.partition(-near, k, axis=1)[:, : k + 1], axis=1)
        kth = np.where(top[:, 0] > 1 - 1e-6, top[:, k], top[:, k - 1])  # the vector itself may be in the sample
        p = np.arccos(np.clip(kth, -1, 1)) / np.pi
        out[at : at + 256] = np.minimum(BITS, BITS * p + MARGIN * np.sqrt(BITS * p * (1 - p)) + 1)
    return out


def _prefix(words: np.ndarray, j: int, bits: int) -> np.ndarray:
    return (words[:, j] >> np.uint32(WIDE - bits)).astype(np.int64) if bits else np.zeros(len(words), dtype=np.int64)


def _within(j: int, a: np.ndarray, r: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of codes within the radii r, that substring j finds and none before it."""
    near, out = ((r - j) // TABLES).astype(np.int64), []
    step = max(1, PAIRS // len(b))
    for at in range(0, len(a), step):
        q, p = np.nonzero(np.bitwise_count(a[at : at + step, j][:, None] ^ b[:, j][None, :]) <= near[at : at + step, None])
        q += at
        far = np.zeros(len(q), dtype=np.int64)
        for t in range(TABLES):
            far += np.bitwise_count(a[q, t] ^ b[p, t])
        q, p = q[far <= r[q]], p[far <= r[q]]
        first = np.ones(len(q), dtype=bool)
        for t in range(j):
            first &= np.bitwise_count(a[q, t] ^ b[p, t]) > (r[q] - t) // TABLES
        out.append((q[first], p[first]))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _scanned(a: np.ndarray, r: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of codes within the radii r, some queries at a time."""
    a, b = np.ascontiguousarray(a).view("<u8"), np.ascontiguousarray(np.ascontiguousarray(b).view("<u8").T)
    step = max(1, PAIRS // b.shape[1])
    for at in range(0, len(a), step):
        far = np.zeros((len(a[at : at + step]), b.shape[1]), np.uint16)
        for t in range(len(b)):
            far += np.bitwise_count(a[at : at + step, t, None] ^ b[t])
        q, p = np.nonzero(far <= r[at : at + step, None])
        yield q + at, p


def _probed(a: np.ndarray, r: np.ndarray, b: np.ndarray, bits: int, masks: np.ndarray, upto: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same by the lists that the radii reach in each table."""
    for j in range(TABLES):
        near = (r - j) // TABLES
        asked = np.flatnonzero(near >= 0)
        n = upto[np.minimum(near[asked], bits)]
        query, place = np.repeat(asked, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        bucket = _prefix(a, j, bits)[query] ^ masks[place]
        order, listed = np.argsort(bucket, kind="stable"), np.argsort(_prefix(b, j, bits), kind="stable")
        ends = [np.searchsorted(x, np.arange((1 << bits) + 1)) for x in (bucket[order], _prefix(b, j, bits)[listed])]
        for k in np.unique(bucket).tolist():
            own, there = query[order[ends[0][k] : ends[0][k + 1]]], listed[ends[1][k] : ends[1][k + 1]]
            if len(there):
                q, p = _within(j, a[own], r[own], b[there])
                yield own[q], there[p]


def _near(a: np.ndarray, r: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of codes within the radii r, each once: by the lists where the radius reaches few, else by all codes."""
    bits = min(16, ((len(b) - 1) // LIST).bit_length())
    masks = np.arange(1 << bits)
    flips = np.bitwise_count(masks)
    masks, upto = masks[np.argsort(flips, kind="stable")], np.cumsum(np.bincount(flips, minlength=bits + 1))
    few = TABLES * upto[np.clip(r // TABLES, 0, bits)] * 4 <= 1 << bits
    for part, search in ((np.flatnonzero(few), lambda x, y: _probed(x, y, b, bits, masks, upto)), (np.flatnonzero(~few), lambda x, y: _scanned(x, y, b))):
        if len(part):
            for q, p in search(a[part], r[part]):
                yield part[q], p


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def _best(q: np.ndarray, p: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `most` best of each q, ties to the smaller p."""
    order = np.lexsort((p, -score, q))
    q, p, score = q[order], p[order], score[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < most
    return q[kept], p[kept], score[kept]


FOUND = pa.schema([("query_class", pa.int64()), ("class_id", pa.int64()), ("score", pa.float64())])


def _searched(codes: Broadcast, k: int):
    """Queries (class_id, embedding, radius) and vectors (class_id, embedding) of a block each -> the k + 1 nearest found for each query."""

    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        if not queries.num_rows or not index.num_rows:
            return FOUND.empty_table()
        index = index.sort_by("class_id")
        x, y = (_matrix(t["embedding"].combine_chunks()) for t in (queries, index))
        a, b = (encode(unit(v), codes.value) for v in (x, y))
        best, held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)], []
        rows = max(1, PAIRS // x.shape[1])
        for q, p in _near(a, queries["radius"].to_numpy().astype(np.int64), b):
            for at in range(0, len(q), rows):
                held.append((q[at : at + rows], p[at : at + rows], _scores(x[q[at : at + rows]], y[p[at : at + rows]])))
            if sum(len(h[0]) for h in held) >= PAIRS:
                best, held = list(_best(*(np.concatenate(c) for c in zip(best, *held, strict=True)), k + 1)), []
        q, p, score = _best(*(np.concatenate(c) for c in zip(best, *held, strict=True)), k + 1)
        return pa.table([pa.array(queries["class_id"].to_numpy()[q]), pa.array(index["class_id"].to_numpy()[p]), pa.array(score)], schema=FOUND)

    return run


def _with_radii(codes: Broadcast, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = radii(unit(_matrix(batch.column(1))), codes.value, k) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(r.astype(np.int32))], names=["class_id", "embedding", "radius"])

    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, embedding of the rows that take part: no null id, of the commonest length, finite and not zero."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    whole = rows.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    lengths = whole.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return whole.where(F.size("embedding") == (lengths["n"] if lengths else 0))


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """class_id, embedding, members, h1, h2: a row for each distinct vector, with its k + 1 smallest ids. Stored."""
    keyed = rows.select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    least = keyed.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    return stored(least.groupBy("h1", "h2").agg(F.min("vec_id").alias("class_id"), F.min_by("embedding", "vec_id").alias("embedding"), F.array_sort(F.collect_list("vec_id")).alias("members")), "classes")


def least_hashes(classes: DataFrame, most: int) -> DataFrame:
    """h, class_id, embedding of some 2 * most classes, the `most` least hashes of ids among them: what may be sorted for a limit of `most`.

    Each task of such a sort sends the driver as many rows as the limit, so without this the driver would get most rows of every task.
    """
    hashed, n = classes.select(F.xxhash64("class_id").alias("h"), "class_id", "embedding"), classes.count()
    share = 2 * most
    while share < n:
        low = hashed.where(F.col("h") < int(share / n * 2**64) - 2**63)
        if low.count() >= most:
            return low
        share *= 2
    return hashed


def sampled(classes: DataFrame) -> np.ndarray:
    """Unit vectors of at most SAMPLE classes and SAMPLE_BYTES, picked by the hash of their ids; goes to the driver and every worker."""
    width = classes.select(F.size("embedding")).first()
    most = min(SAMPLE, max(64, SAMPLE_BYTES // (4 * max(1, width[0] if width else 1))))
    picked = least_hashes(classes, most).orderBy("h", "class_id").limit(most).toArrow()
    return unit(_matrix(picked["embedding"].combine_chunks())) if picked.num_rows else np.zeros((0, 1))


def search_classes(classes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_class, class_id, score: the k + 1 nearest classes found for each class of asked (class_id), itself included."""
    n, sample = classes.count(), sampled(classes)
    spark = classes.sparkSession
    if not n:
        return spark.createDataFrame([], "query_class long, class_id long, score double")
    codes = spark.sparkContext.broadcast(fit_codes(sample))
    own, kind = classes.select("class_id", "embedding").join(asked.select("class_id"), "class_id", "left_semi"), classes.schema["embedding"].dataType.simpleString()
    queries = stored(own.mapInArrow(_with_radii(codes, k), f"class_id long, embedding {kind}, radius int"), "queries")
    wide = 8 * sample.shape[1]
    parts, blocks = 1 + queries.count() * wide // QUERY_BYTES, max(1 + n * wide // INDEX_BYTES, min(2 * spark.sparkContext.defaultParallelism, 1 + n // LEAST_BLOCK))
    block = lambda m: F.pmod(F.xxhash64("class_id"), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    q = queries.select(block(parts).alias("asked"), every(blocks).alias("held"), "class_id", "embedding", "radius")
    c = classes.select(every(parts).alias("asked"), block(blocks).alias("held"), "class_id", "embedding")
    # by number, as few tasks of a size are dealt to more of them than there are, and Spark would merge some
    q, c = (t.repartition(4 * parts * blocks, "asked", "held") for t in (q, c))
    scored = q.groupBy("asked", "held").cogroup(c.groupBy("asked", "held")).applyInArrow(_searched(codes, k), "query_class long, class_id long, score double")
    nearest = Window.partitionBy("query_class").orderBy(F.desc("score"), "class_id")
    return scored.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1).drop("n")


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (a part of vectors) its k nearest rows found, by largest cosine.

    The row itself is no candidate; all others are, so fewer than k rows come only where fewer are there. Ties go to the
    smaller id. Rows with a null id, and vectors that are null, zero, of another than the commonest length, or hold null or
    non-finite components take no part. Equal rows of queries count once; rows of vectors that share an id stay apart.
    Other columns are not read; empty tables give empty tables. The index covers every row; its rotations come from at most
    SAMPLE vectors. Recall isn't 1: see the tests.
    """
    rows = usable(vectors, id_col, vector_col)
    classes = classes_of(rows, k)
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("embedding")).where("query_id IS NOT NULL AND embedding IS NOT NULL")
    keyed = asked.select("query_id", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")).distinct()
    own = stored(keyed.join(classes.select("h1", "h2", F.col("class_id").alias("query_class")), ["h1", "h2"]).select("query_id", "query_class"), "asked")
    found = search_classes(classes, own.select(F.col("query_class").alias("class_id")).distinct(), k)
    found = stored(found.join(classes.select("class_id", "members"), "class_id"), "found")
    at = F.when(F.col("class_id") == F.col("query_class"), F.array_position("members", F.col("query_id"))).otherwise(0).cast("int")
    others = F.when(F.col("at") > 0, F.concat(F.slice("members", F.lit(1), F.col("at") - 1), F.slice("members", F.col("at") + 1, F.size("members")))).otherwise(F.col("members"))
    each = own.join(found, "query_class").withColumn("at", at).select("query_id", "query_class", "score", F.explode(others).alias("vec_id"))
    order = Window.partitionBy("query_id", "query_class").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
