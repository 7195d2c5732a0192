"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text: one on ordinary text, one on the same and on the segments that
toxic texts repeat in many contexts and ordinary ones lack. A text is cut into windows of a word each, framed by bytes
that both dictionaries know; each window is compressed with either dictionary, and the bytes that the toxic one saves
are its distance. The numbers of windows at and above a calibrated saving and their share give a text's score through a
logistic curve fitted to the labelled sample. (Windows of many words were tried first: chance matches in either
dictionary drown the few bytes that one word saves, and a quarter of the toxic texts was missed.)
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
WORD_CHARS = 80
ORDINARY_BYTES = 300
TOXIC_BYTES = 2_000
GRAM = range(4, 13)
#: The frame: its matching beginning makes zstandard write a compressed block; it doesn't search a block's last 8 bytes.
FRAME_START, FRAME_END = bytes(range(1, 9)) + bytes(range(14, 22)), bytes(range(8, 0, -1))
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
KEPT_WORDS = 150_000


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    least: int  # bytes saved from which a window counts
    weights: tuple[float, ...]


def words_of(text: str) -> list[str]:
    """The windows of a text: its words, longer ones in parts."""
    found = WORD.findall(text.lower())
    if max(map(len, found), default=0) <= WORD_CHARS:
        return found
    return [w[k : k + WORD_CHARS] for w in found for k in range(0, len(w), WORD_CHARS)]


def _grams(word: str, sizes: Iterable[int] = GRAM) -> set[str]:
    """Beginnings and ends of a word, with the space before or after it."""
    padded = f" {word} "
    sizes = [n for n in sizes if n <= len(padded)]
    return {padded[:n] for n in sizes} | {padded[-n:] for n in sizes} | {padded[1 : n + 1] for n in sizes if n < len(padded)}


def _segments(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Segments of words that many toxic texts have and ordinary ones lack, by the bytes they cover, most first."""
    import ahocorasick

    common: Counter = Counter()
    for t in ordinary:
        common.update(set(WORD.findall(t.lower())))
    often = 0.02 * len(ordinary)
    # Copies of a text repeat whatever it holds: what counts is in how many contexts (words before it) a word stands.
    # A context is a number, one for each pair of words.
    frequently = {w for w, n in common.items() if n > often}
    del common
    pairs: dict[tuple[str, str], int] = {}
    contexts: dict[str, set[int]] = defaultdict(set)
    holders: dict[str, set[int]] = defaultdict(set)
    for k, t in enumerate(toxic):
        last = ""
        for w in WORD.findall(t.lower()):
            if w not in frequently:
                contexts[w].add(pairs.setdefault((last, w), len(pairs)))
                holders[w].add(k)
            last = w
    del pairs
    least = max(4, len(toxic) // 100)
    texts: dict[str, set[int]] = {}
    where: dict[str, set[int]] = {}
    for n in GRAM:  # one size after the other, for memory
        count: Counter = Counter()
        for w, cs in contexts.items():
            for g in _grams(w, (n,)):
                count[g] += len(cs)
        frequent = {g for g, times in count.items() if times >= least}
        del count
        held: dict[str, set[int]] = defaultdict(set)
        for w, ks in holders.items():
            for g in _grams(w, (n,)) & frequent:
                held[g] |= ks
        texts |= {g: ks for g, ks in held.items() if len(ks) >= least}
    if not texts:
        return []
    seen: Counter = Counter()
    automaton = ahocorasick.Automaton()
    for g in texts:
        automaton.add_word(g, g)
    automaton.make_automaton()
    for t in ordinary:
        plain = " " + " ".join(WORD.findall(t.lower())) + " "
        seen.update({g for _, g in automaton.iter(plain)})
    ratio = lambda g: math.log((len(texts[g]) + 0.5) / (len(toxic) + 1) * (len(ordinary) + 1) / (seen[g] + 0.5))
    # A segment has to be odds of e^3 likelier in toxic texts, by more than its own count could bring about by chance.
    good = {g for g in texts if ratio(g) > 3 and len(texts[g]) * ratio(g) > 40}
    for w, cs in contexts.items():
        for g in _grams(w) & good:
            where.setdefault(g, set()).update(cs)
    good = {g for g in good if len(where[g]) * ratio(g) > 40}
    chosen, size = [], 0
    while good and size < TOXIC_BYTES:
        best = max(good, key=lambda g: (len(where[g]) * min(len(g), 10), len(g), g))
        if len(where[best]) < least:
            break
        chosen.append(best)
        size += len(best.encode())
        covered = where[best].copy()
        good.discard(best)
        for g in list(good):
            where[g] -= covered
            if not where[g] or g in best or best in g:
                good.discard(g)
    return chosen


def _compressor(content: bytes):
    import zstandard as zs

    params = zs.ZstdCompressionParameters(window_log=15, hash_log=13, chain_log=13, search_log=3, min_match=4, target_length=8, strategy=zs.STRATEGY_BTULTRA, write_content_size=False, write_checksum=False, write_dict_id=False)
    trained = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=params)
    return zs.ZstdCompressor(dict_data=trained, compression_params=params)


class _Savings(dict):
    """Word -> the bytes that the toxic dictionary saves; filled on demand, bounded."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.a, self.b = _compressor(ordinary).compress, _compressor(toxic).compress

    def __missing__(self, word: str) -> int:
        window = FRAME_START + f" {word} ".encode() + FRAME_END
        saved = len(self.a(window)) - len(self.b(window))
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = saved
        return saved


_savings: dict[tuple[bytes, bytes], _Savings] = {}


def savings(texts: list[str], ordinary: bytes, toxic: bytes) -> list[np.ndarray]:
    """For each text, the bytes that the toxic dictionary saves in each window."""
    if (ordinary, toxic) not in _savings:
        _savings[ordinary, toxic] = _Savings(ordinary, toxic)
    saved = _savings[ordinary, toxic]
    return [np.array([saved[w] for w in words_of(t)], dtype=np.int32) for t in texts]


def features(saved: list[np.ndarray], least: int) -> np.ndarray:
    rows = []
    for s in saved:
        hits, more = int((s >= least).sum()), int((s > least).sum())
        rows.append((1.0, math.log1p(hits), math.log1p(more), float(hits > 0), float(more > 0), min(5.0, 100 * hits / max(1, len(s)))))
    return np.array(rows, dtype=np.float64).reshape(-1, 6)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton steps with a small ridge, both classes weighing as they come."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + 0.01 * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w)), gradient)
    return w


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """The dictionaries, the window threshold and the curve. Without both sorts of text, every score is the share of toxic ones."""
    if not toxic or not ordinary:
        return Model(FRAME_START, FRAME_START, 1, (20.0 if toxic else -20.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    content, step = FRAME_START, max(1, len(ordinary) // 200)
    for t in ordinary[::step]:
        if len(content) > ORDINARY_BYTES:
            break
        content += t.lower().encode()[:60].rpartition(b" ")[0] + b" "
    # the toxic segments stand first, so that ordinary matches lie as far from the text, and cost as much, in either
    both = "\n".join(reversed(_segments(toxic, ordinary))).encode() + b"\n" + content
    saved_t, saved_o = savings(toxic, content, both), savings(ordinary, content, both)
    y = np.append(np.ones(len(toxic)), np.zeros(len(ordinary)))
    # the threshold at which "some window reaches it" tells the sample's classes apart best
    most_t, most_o = (np.array([s.max(initial=0) for s in x]) for x in (saved_t, saved_o))
    least = max(range(1, 8), key=lambda k: ((most_t >= k).mean() - (most_o >= k).mean(), -k))
    w = _logistic(features(saved_t + saved_o, least), y)
    _savings.clear()
    return Model(content, both, least, tuple(float(v) for v in w))


def score_texts(texts: list[str], model: Model) -> np.ndarray:
    x = features(savings(texts, model.ordinary, model.toxic), model.least)
    return 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))


def _run(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for k in range(0, len(texts), 256):
                part = texts[k : k + 256]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, len(part)), pa.array(score_texts(part, model))], schema=schema)

    return run


def held_out(doc_id: Column) -> Column:
    """Whether the labels of a row may not be learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = 1000, most_ordinary: int = 4000, most_chars: int = 8_000) -> Model:
    """Learns from a bounded sample: at most so many labelled texts of each sort, none longer than most_chars.

    Rows of the held-out fold, null ids, null labels and null texts are left out. Ids with several labels count as toxic
    if any label says so.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = docs.where(F.col("text").isNotNull() & (F.length("text") <= most_chars)).select("doc_id", "text")
    by_hash = F.xxhash64("doc_id")
    # a little more than needed, for ids whose text is too long or missing; at most twice the bound of ids is broadcast
    some = known.where(F.col("toxic") > 0).orderBy(by_hash).limit(2 * most_toxic).unionAll(known.where(F.col("toxic") == 0).orderBy(by_hash).limit(2 * most_ordinary))
    found = short.join(F.broadcast(some), "doc_id").select("toxic", by_hash.alias("h"), "text")
    picked = found.where("toxic > 0").orderBy("h").limit(most_toxic).unionAll(found.where("toxic = 0").orderBy("h").limit(most_ordinary))
    rows = sorted(((r.toxic, r.h, r.text) for r in picked.collect()), key=lambda r: r[1:])
    return train([t for x, _, t in rows if x > 0], [t for x, _, t in rows if x == 0])


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), one row per row of docs, from the text alone.

    Null and empty texts have no windows and get the score of a text without hits. Texts are scored whole; equal texts
    have equal scores; other columns are not read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_run(model), "doc_id long, score double")


def reject_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text scores threshold or more; all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield batch.filter(pa.array(score_texts(texts, model) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity_digest(scored: DataFrame) -> DataFrame:
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", predicted.alias("predicted"))
