"""Lempel-Ziv phrase fingerprints: a text's set of dictionary phrases, hashed to a minimum-hash signature.

A text is parsed from left to right into the shortest phrases not seen before (so every phrase's beginnings are
phrases too). The phrases' hashes go into 128 bins by their leading bits; each bin keeps 16 bits of its least hash.
Two signatures agree in about the share of phrases that two texts have in common, as their compressed sizes would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 128
EMPTY = np.uint32(1 << 16)
LOWEST = -(1 << 63)

_R = 0x9E3779B97F4A7C15 | 1
_RI = pow(_R, -1, 1 << 64)
_power = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        n = max(n, 2 * len(_power), 1 << 14)
        base = np.full(n, _R, dtype=np.uint64)
        base[0] = 1
        _power = np.multiply.accumulate(base)
        base[1:] = np.uint64(_RI)
        _inverse = np.multiply.accumulate(base)
    return _power, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result hangs on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _parse(text: str, at: int, upto: int, seen: set[str], ends: list[int]) -> int:
    """Appends the ends of the phrases from `at` that end at or before `upto`; returns where the next one starts.

    seen is closed under beginnings, so the length of the next phrase is found by walking from the last one's.
    """
    add, push, size, n = seen.add, ends.append, 1, len(text)
    while at < upto:
        phrase = text[at : at + size]
        if phrase in seen:
            size += 1
            while (phrase := text[at : at + size]) in seen:
                if at + size >= n:
                    return at
                size += 1
        else:
            while size > 1 and (shorter := text[at : at + size - 1]) not in seen:
                phrase = shorter
                size -= 1
        size = len(phrase)
        if at + size > upto:
            return at
        add(phrase)
        at += size
        push(at)
    return at


def _hashes(text: str, start: int, ends: list[int]) -> np.ndarray:
    """One hash for each phrase of text, the first beginning at `start`."""
    if not ends:
        return np.empty(0, dtype=np.uint64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    power, inverse = _powers(len(points) + 1)
    total = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(points * power[: len(points)], out=total[1:])
    e = np.array(ends, dtype=np.int64)
    s = np.append(start, e[:-1])
    return mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def signature(hashes: np.ndarray) -> np.ndarray:
    """16 bits of the least hash in each bin; EMPTY where a bin has none."""
    out = np.full(BINS, EMPTY, dtype=np.uint32)
    if len(hashes):
        h = np.sort(hashes)
        bins = (h >> np.uint64(57)).astype(np.int64)
        first = np.append(True, bins[1:] != bins[:-1])
        out[bins[first]] = (h[first] & np.uint64(0xFFFF)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of agreeing bins among those that either has; 1 for two empty ones."""
    either = (a != EMPTY) | (b != EMPTY)
    n = int(either.sum())
    return float(((a == b) & either).sum()) / n if n else 1.0


def fingerprint_text(sig: np.ndarray) -> str:
    if sig.max(initial=0) < EMPTY:
        return sig.astype(">u2").tobytes().hex()
    return "".join("----" if x == EMPTY else f"{x:04x}" for x in sig.tolist())


def fingerprint_pair(text: str, other: str) -> tuple[np.ndarray, str, np.ndarray]:
    """The signature of text, its edited text (its last half replaced by other's beginning) and that one's signature."""
    half = len(text) // 2
    kept = len(text) - half
    edited = text[:kept] + other[:half]
    seen: set[str] = set()
    ends: list[int] = []
    at = _parse(text, 0, kept, seen, ends)
    both = _hashes(text, 0, ends)
    again: list[int] = []
    branch = set(seen)
    _parse(text, at, len(text), seen, again)
    own = signature(np.concatenate([both, _hashes(text, at, again)]))
    again = []
    _parse(edited, at, len(edited), branch, again)
    return own, edited, signature(np.concatenate([both, _hashes(edited, at, again)]))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
SCHEMA = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
HELD = 256


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, then in order; a bucket ends with the row that follows it (tail 1)."""
    out: list[tuple] = []
    last: tuple | None = None  # bucket, tail, doc_id, text
    held: tuple | None = None  # the row before, waiting for this one's signature

    def emit(before: tuple, sig: np.ndarray) -> None:
        doc_id, text, own, edited, edited_sig = before
        out.append((doc_id, len(text), edited, fingerprint_text(own), fingerprint_text(edited_sig), likeness(own, edited_sig), likeness(own, sig)))

    def flush() -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)
        out.clear()
        return batch

    for batch in batches:
        for bucket, tail, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if last is not None and last[0] == bucket and not last[1]:
                own, edited, edited_sig = fingerprint_pair(last[3], text)
                if held is not None:
                    emit(held, own)
                held = (last[2], last[3], own, edited, edited_sig)
                if tail:
                    emit(held, fingerprint_pair(text, "")[0])
                    held = None
            last = (bucket, tail, doc_id, text)
            if len(out) >= HELD:
                yield flush()
    if out:
        yield flush()


def _bucket(order: Column, splits: list[int]) -> Column:
    """How many of the ascending splits are <= order, by binary search."""
    if not splits:
        return F.lit(0)
    steps = [1 << k for k in range(len(splits).bit_length() - 1, -1, -1)]
    at = F.array(*map(F.lit, steps))
    table = F.lit(splits).cast("array<bigint>")
    return F.aggregate(at, F.lit(0), lambda lo, s: F.when((lo + s <= len(splits)) & (F.get(table, lo + s - 1) <= order), lo + s).otherwise(lo))


def fingerprint_with_next(docs: DataFrame, bucket_rows: int = 2000, most_buckets: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next: one row per row of docs.

    "Next" is by ascending id (null ids first; equal ids by text), and the first follows the last. Rows are dealt into
    ranges of ids, with the first row of each range also sent to the range before it, so texts shuffle once. The driver
    sees two numbers per range, at most most_buckets of them. Null texts are empty; empty texts have no phrases and are
    wholly alike; an empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("order", F.coalesce("doc_id", F.lit(LOWEST)))
    spark = docs.sparkSession
    n = rows.count()
    wanted = max(1, min(most_buckets, max(n // bucket_rows, min(n // 50, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    splits: list[int] = []
    if wanted > 1:
        cuts = F.percentile_approx("order", [k / wanted for k in range(1, wanted)], F.lit(max(10_000, 4 * wanted)))
        splits = sorted(set(rows.agg(cuts.alias("cuts")).first()["cuts"]))
    bucket = _bucket(F.col("order"), splits)
    firsts = sorted(rows.groupBy(bucket.alias("bucket")).agg(F.min("order")).collect())
    if firsts:
        size = firsts[-1][0] + 1
        first, before = [None] * size, [0] * size
        for k, (b, low) in enumerate(firsts):
            first[b], before[b] = low, firsts[k - 1][0]
        is_first = F.col("order") == F.get(F.lit([LOWEST if x is None else x for x in first]).cast("array<bigint>"), F.col("bucket"))
        own = F.struct(F.col("bucket").alias("to"), F.lit(0).alias("tail"))
        tail = F.struct(F.get(F.lit(before).cast("array<int>"), F.col("bucket")).alias("to"), F.lit(1).alias("tail"))
        rows = rows.withColumn("bucket", bucket).select("doc_id", "text", "order", F.explode(F.when(is_first, F.array(own, tail)).otherwise(F.array(own))).alias("at"))
    else:
        rows = rows.withColumn("at", F.struct(F.lit(0).alias("to"), F.lit(0).alias("tail")))
    dealt = rows.select(F.col("at.to").alias("bucket"), F.col("at.tail").alias("tail"), "doc_id", "text", "order").repartition("bucket").sortWithinPartitions("bucket", "tail", "order", "text")
    return dealt.select("bucket", "tail", "doc_id", "text").mapInArrow(_run, SCHEMA)


def fingerprint_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
