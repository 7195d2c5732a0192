"""Periodic runs of words: stretches that repeat at least three times, found by longest common extensions.

A worker takes a group of texts as one array of word numbers, a separator of its own after each text. Extensions are
answered by a difference cover: of 31 residues six are sampled such that any two positions reach sampled ones at the same
distance of under 31 words. Only sampled suffixes are sorted (by blocks of 31 words, doubling), and the common blocks of two of
them are a range minimum over neighbours. Runs are looked for on a harmonic grid: a run of period p and at least 3 p words
holds a multiple i of 2 p together with i + p, so those pairs are extended to both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Every difference modulo 31 is the difference of two of these.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
GRAM = 16  # a run of 24 words or more, and of three periods or more, repeats so many words
GROUP_BYTES = 4 << 20  # texts are taken in groups of about this size
MOST_PAIRS = 1 << 21  # grid pairs at once
RUN = "struct<start:bigint,length:bigint,period:bigint>"
OUT = f"doc_id long, runs array<{RUN}>, collapsed string"

_PLACE = np.full(PERIOD, -1)
_PLACE[list(COVER)] = np.arange(len(COVER))


def _steps() -> np.ndarray:
    """[a, b]: the least distance after which positions of residues a and b are both sampled."""
    res, hit = np.arange(PERIOD), _PLACE >= 0
    both = hit[(res[:, None, None] + res) % PERIOD] & hit[(res[None, :, None] + res) % PERIOD]
    return both.argmax(axis=2)


_STEP = _steps()
_MIX = (np.random.default_rng(31).integers(1, 1 << 62, PERIOD, dtype=np.int64) * 2 + 1).astype(np.uint64)


def _named(rows: np.ndarray) -> np.ndarray:
    """A number from 1 for each distinct row: by hash, and exactly where two rows share one."""
    _, first, name = np.unique((rows.astype(np.uint64) * _MIX).sum(axis=1), return_index=True, return_inverse=True)
    if (rows != rows[first[name]]).any():
        _, name = np.unique(rows, axis=0, return_inverse=True)
    return name.reshape(-1) + 1


class Extensions:
    """Longest common extensions to the right in x, whose last number must occur once."""

    def __init__(self, x: np.ndarray):
        self.x = np.concatenate([x, -1 - np.arange(2 * PERIOD)])
        at = np.arange(len(x)).reshape(-1)
        at = at[_PLACE[at % PERIOD] >= 0]
        self.n = len(at)
        if not self.n:
            return
        levels = [_named(np.lib.stride_tricks.sliding_window_view(self.x, PERIOD)[at])]
        slots, step = np.arange(self.n), len(COVER)
        while (top := levels[-1]).max() < self.n:
            later = np.zeros(self.n, dtype=np.int64)
            later[: max(0, self.n - step)] = top[step:]
            levels.append(np.unique(top * (self.n + 1) + later, return_inverse=True)[1].reshape(-1) + 1)
            step *= 2
        self.rank = levels[-1] - 1
        order = np.empty(self.n, dtype=np.int64)
        order[self.rank] = slots
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, self.n - 1), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.flatnonzero((a < self.n) & (b < self.n))
            same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
            common[same] += 1 << k
            a[same] += len(COVER) << k
            b[same] += len(COVER) << k
        self.least = [common]
        while (h := 1 << (len(self.least) - 1)) * 2 <= len(common):
            last = self.least[-1]
            self.least.append(np.minimum(last[:-h], last[h:]))

    def _slot(self, at: np.ndarray) -> np.ndarray:
        return at // PERIOD * len(COVER) + _PLACE[at % PERIOD]

    def _words(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words agree from i and j on, counted up to most."""
        out, live = most.copy(), np.arange(len(i))
        for t in range(int(most.max(initial=0))):
            live = live[most[live] > t]
            same = self.x[i[live] + t] == self.x[j[live] + t]
            out[live[~same]] = t
            live = live[same]
            if not len(live):
                break
        return out

    def _blocks(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common blocks of the sampled suffixes at i and j."""
        a, b = self.rank[self._slot(i)], self.rank[self._slot(j)]
        low, high = np.minimum(a, b), np.maximum(a, b)
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), dtype=np.int64)
        for level in np.unique(k).tolist():
            own = k == level
            out[own] = np.minimum(self.least[level][low[own]], self.least[level][high[own] - (1 << level)])
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places i <> j: the number of words that agree from there on."""
        step = _STEP[i % PERIOD, j % PERIOD]
        out = self._words(i, j, step)
        met = np.flatnonzero(out == step)
        met = met[self.x[i[met] + step[met]] == self.x[j[met] + step[met]]]
        if len(met):
            done = step[met] + PERIOD * self._blocks(i[met] + step[met], j[met] + step[met])
            out[met] = done + self._words(i[met] + done, j[met] + done, np.full(len(met), PERIOD))
        return out


def _grid(sizes: np.ndarray, begins: np.ndarray, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, p) of all texts: i runs over the multiples of (repeats - 1) p with i + p inside the text."""
    top = sizes // repeats
    text = np.repeat(np.arange(len(sizes)), top)
    p = np.arange(len(text)) - np.repeat(np.cumsum(top) - top, top) + 1
    n = -(-(sizes[text] - p) // ((repeats - 1) * p))
    upto, at = np.cumsum(n), 0
    while at < len(p):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + MOST_PAIRS, side="right")))
        own, many = slice(at, end), int(n[at:end].sum())
        k = np.arange(many) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
        period = np.repeat(p[own], n[own])
        yield np.repeat(begins[text[own]], n[own]) + (repeats - 1) * k * period, period
        at = end


def find_runs(x: np.ndarray, begins: np.ndarray, sizes: np.ndarray, least: int = 24, repeats: int = 3) -> np.ndarray:
    """Rows (start, length, period) by start and period, in places of x. x: texts, each behind and before a number of its own."""
    ahead, back = Extensions(x), Extensions(x[::-1])
    found = [np.empty((0, 3), dtype=np.int64)]
    for i, p in _grid(sizes, begins, repeats):
        same = x[i] == x[i + p]
        i, p = i[same], p[same]
        right = ahead.common(i, i + p)
        left = back.common(len(x) - i, len(x) - i - p)
        length = left + right + p
        long = length >= np.maximum(least, repeats * p)
        found.append(np.unique(np.stack([(i - left)[long], length[long], p[long]], axis=1), axis=0))
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), dtype=bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)  # a multiple of the least period has the same ends
    runs = runs[fresh]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _repeating(x: np.ndarray, text: np.ndarray, sizes: np.ndarray, gram: int) -> np.ndarray:
    """Texts that may hold the same gram words twice: all others have no run."""
    h = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    width = 1
    while width < gram:
        more = min(width, gram - width)
        h[: len(h) - more] = (h[: len(h) - more] ^ (h[: len(h) - more] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[more:]
        width += more
    ends = np.cumsum(sizes)
    inside = np.flatnonzero(np.arange(len(x)) + gram <= ends[text])
    h = h[inside] ^ (text[inside].astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB)
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    return np.unique(text[inside[np.isin(h, twice)]]) if len(twice) else np.empty(0, dtype=np.int64)


def _group(texts: pa.Array, least: int, repeats: int) -> tuple[list[list[dict]], pa.Array]:
    """The runs of each text, and the texts without repeats."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, text = split.flatten(), pc.list_parent_indices(split).to_numpy()
    there = pc.greater(pc.binary_length(words), 0)
    words, text = words.filter(there), text[there.to_numpy(zero_copy_only=False)].astype(np.int64)
    sizes = np.bincount(text, minlength=len(texts)).astype(np.int64)
    firsts = np.cumsum(sizes) - sizes
    x = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    # periods q repeat least - q words at least, and (repeats - 1) q
    gram = min(max(least - q, (repeats - 1) * q) for q in range(1, least + 1))
    todo = _repeating(x, text, sizes, min(gram, GRAM))
    todo = todo[sizes[todo] >= least]
    runs: list[list[dict]] = [[] for _ in range(len(texts))]
    dropped = np.zeros(len(x) + 1, dtype=np.int64)
    if len(todo):
        own = sizes[todo]
        begins = np.cumsum(own + 1) - own
        joined, alone = np.empty(int(own.sum()) + len(todo) + 1, dtype=np.int64), len(x)
        joined[0] = alone
        joined[begins + own] = alone + 1 + np.arange(len(todo))
        source = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        joined[np.repeat(begins, own) + source] = x[np.repeat(firsts[todo], own) + source]
        found = find_runs(joined, begins, own, least, repeats)
        owner = np.searchsorted(begins, found[:, 0], side="right") - 1
        start = found[:, 0] - begins[owner]
        for d, s, n, p in zip(todo[owner].tolist(), start.tolist(), found[:, 1].tolist(), found[:, 2].tolist(), strict=True):
            runs[d].append({"start": s, "length": n, "period": p})
        at = firsts[todo[owner]] + start
        np.add.at(dropped, at + found[:, 2], 1)
        np.add.at(dropped, at + found[:, 1], -1)
    keep = np.cumsum(dropped[:-1]) == 0
    left = np.bincount(text[keep], minlength=len(texts))
    offsets = pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32())
    return runs, pc.binary_join(pa.ListArray.from_arrays(offsets, words.filter(pa.array(keep))), " ")


def _run(least: int, repeats: int):
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + GROUP_BYTES, side="right")))
                part = batch.slice(at, end - at)
                runs, collapsed = _group(part.column(1), least, repeats)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(runs, schema.field(1).type), collapsed], schema=schema)
                at = end

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, repeats: int = 3) -> DataFrame:
    """doc_id, runs(start, length, period), collapsed: one row per row of docs.

    Words are what lies between spaces, tabs and line ends. A run is a stretch of words with least period q, no shorter
    than `least` and `repeats` * q words, that no neighbouring word extends; runs go by start, then period. collapsed is
    the text without the words of any run that come after its first q, joined by single spaces. Null, empty and blank texts
    have no run and collapse to the empty text. Null and repeated ids stay as they are; other columns are not read. One
    narrow pass: a text is worked on whole by one task, in memory that is in proportion to its words.
    """
    if repeats < 2 or least < 2:
        raise ValueError("least and repeats start at 2")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_run(least, repeats), OUT)


def replanted(docs: DataFrame) -> DataFrame:
    """doc_id, text of docs, where a tenth of the texts (by the CRC of the id) turn periodic from some word on; the others as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    split = F.array(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))

    def turned(words):
        n = F.size(words)
        a = F.col("__g") % n
        p = 1 + F.floor((n - a) / (3 + F.col("__g") % 8))
        place = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " ")).otherwise("")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("__g", g)
    return rows.select("doc_id", F.when(h % 10 == 0, F.get(F.transform(split, turned), F.lit(0))).otherwise(F.col("text")).alias("text"))


def runs_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the greatest exponent, digests of all runs and of the collapsed text."""
    start = F.lit(None).cast(RUN)
    greater = lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b)
    best = found.withColumn("best", F.aggregate("runs", start, greater))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
