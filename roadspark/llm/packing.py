"""Best-fit packing with exact complements.

Documents become token pieces (one pass, in Python workers). How many pieces of each length there are - at most
`capacity` numbers, whatever the input - decides the plan: for the longest piece left, an index of single, pair and
triple length sums looks for pieces that fill the gap exactly, and the pattern is used as often as the counts allow;
where none fits exactly, best fit fills the gap. Pieces then take the plan's places by their rank within their length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadspark.llm.common import stored

# The pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SALT_ROWS = 200_000
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


class Encoder:
    """Whole texts to ids for a byte-level BPE file of the tokenizers library, its special strings included."""

    def __init__(self, path: str):
        import tiktoken

        from roadspark.llm.token_counts import byte_symbols

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = byte_symbols()
        self.special = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in spec["added_tokens"]}
        ranks = {bytes(symbol[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.plain = tiktoken.Encoding("words", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _part(self, text: str) -> bytes:
        # whole texts at once: 24 % of all words at sf0.1 were not in a memory of words, and a call for each costs more than the memory saves
        return np.array(self.plain(text), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.cut is not None and any(s in text for s in self.special):
            return b"".join(self.special.get(p) or self._part(p) for p in self.cut.split(text))
        return self._part(text)


_encoders: dict[str, Encoder] = {}


def _pieces(path: str, capacity: int, end_id: int, keep_ids: bool):
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encode, end = _encoders[path].encode, np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = ids[4 * a : 4 * b]
                    row = [doc_id, k, a, b - a, zlib.crc32(own), *[np.frombuffer(own, dtype="<i4")] * keep_ids]
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's ids, then end_id; longer ones cut, the rest first.

    Null and empty texts are the end id alone. Null and repeated ids stay as they are; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer_path, capacity, end_id, keep_ids), PIECES + ", ids array<int>" * keep_ids)


class _Sums:
    """Which gaps single lengths, pairs and triples fill exactly. Counts only fall, so a pair sum once gone stays gone."""

    def __init__(self, counts: np.ndarray):
        there = (counts > 0).astype(np.float64)
        self.pairs = np.convolve(there, there)[: len(counts)] > 0.5

    def pair(self, gap: int, left: np.ndarray, most: int) -> tuple[int, ...]:
        a = left[1:gap] > 0
        both = a & a[::-1]
        if gap % 2 == 0 and left[gap // 2] < 2:
            both[gap // 2 - 1] = False
        at = np.flatnonzero(both)
        at = at[at < most]
        return (int(at[-1]) + 1, gap - int(at[-1]) - 1) if len(at) else ()

    def fill(self, gap: int, left: np.ndarray) -> tuple[int, ...]:
        if left[gap] > 0:
            return (gap,)
        if self.pairs[gap]:
            if found := self.pair(gap, left, gap):
                return found
        first = np.arange(1, gap - 1)
        for a in first[(left[1 : gap - 1] > 0) & self.pairs[gap - first]][::-1].tolist():
            left[a] -= 1
            found = self.pair(gap - a, left, gap)
            left[a] += 1
            if found:
                return (a, *found)
            if not self.pair(gap - a, left, gap):
                self.pairs[gap - a] = False
        return ()


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """counts[l]: pieces of length l. Returns (how many sequences, {length: pieces of it in each}), covering all counts."""
    left, out = counts.astype(np.int64).copy(), []
    sums = _Sums(left)
    while len(there := np.flatnonzero(left)):
        use: dict[int, int] = {}
        spare, gap = left.copy(), capacity

        def take(*lengths: int) -> int:
            for l in lengths:  # noqa: B023, E741
                use[l] = use.get(l, 0) + 1  # noqa: B023
                spare[l] -= 1  # noqa: B023
            return sum(lengths)

        gap -= take(int(there[-1]))
        while gap > 0:
            if found := sums.fill(gap, spare):
                gap -= take(*found)
                break
            fits = np.flatnonzero(spare[: gap + 1])
            if not len(fits):
                break
            # best fit: the fullest of a greedy step and of up to three pieces that fill a little less
            near = next((f for s in range(gap - 1, max(gap - 33, 0), -1) if (f := sums.fill(s, spare))), ())
            if near and len(fits) < 64:
                gap -= take(*near)
                continue
            gap -= take(int(fits[-1]))
        times = min(int(left[l]) // k for l, k in use.items())  # noqa: E741
        for l, k in use.items():  # noqa: E741
            left[l] -= times * k
        out.append((times, use))
    return out


def _places(patterns: list[tuple[int, dict[int, int]]], capacity: int) -> dict[str, np.ndarray]:
    """For each length and stretch of ranks: the first sequence, the place in it and how many of the length it holds."""
    rows, used, sequence = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for times, use in patterns:
        offset = 0
        for l, k in sorted(use.items(), reverse=True):  # noqa: E741
            rows.append((l, used[l], k, sequence, offset))
            used[l] += times * k
            offset += l * k
        sequence += times
    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"key": (a[:, 0] << 44) | a[:, 1], "rank": a[:, 1], "k": a[:, 2], "sequence": a[:, 3], "offset": a[:, 4]}


def _place(places: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "rank"))
            at = np.searchsorted(places["key"], (length << 44) | rank, side="right") - 1
            on = rank - places["rank"][at]
            k = places["k"][at]
            kept = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "rank"]
            names = [f.name for f in batch.schema if f.name != "rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(places["sequence"][at] + on // k), pa.array(places["offset"][at] + on % k * length)], names=[*names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset added: gapless from 0 in each sequence.

    pieces is read three times: pass a stored table. Lengths are 1 to capacity. Equal rows get places of their own; an
    empty table gives an empty table. What reaches the driver is one number per length.
    """
    counted = pieces.groupBy("length").count().collect()
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counted:
        counts[length] = n
    salts = max(1, int(counts.max()) // SALT_ROWS)
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")
    salted = pieces.withColumn("salt", salt)
    before = salted.groupBy("length", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    ranked = salted.withColumn("n", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    if salts > 1:
        ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("n") - 1)
    else:
        ranked = ranked.withColumn("rank", F.col("n").cast("long") - 1)
    ranked = ranked.select(*pieces.columns, "rank")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_place(_places(plan(counts, capacity), capacity)), out)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset."""
    return pack(stored(token_pieces(docs, tokenizer_path, capacity, end_id, keep_ids), "pieces"), capacity)
