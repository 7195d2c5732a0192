"""Token counts for byte-level BPE with the whole-token shortcut.

Offline, every vocabulary string is run through the merges: those that come out as one token are proven to count 1
whenever a pre-token equals them. Only the other pre-tokens are merged. Words between single spaces are counted once
per Python worker (a bounded table) and then looked up.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspark.llm.bpe import MergeTable, merge_words

# The pre-token pattern of byte-level BPE.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A space inside a longer run of white space: such texts aren't split at single spaces.
WIDE = re.compile(r"\s \s|  ")
KEPT_WORDS = 150_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies -> the byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Counter:
    """A byte-level BPE file of the tokenizers library (no normaliser, no prefix space)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec.get("normalizer") or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path} is no plain byte-level BPE")
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if not (t["lstrip"] or t["rstrip"] or t["single_word"])}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.table = MergeTable(
            *(np.array(x, dtype=np.int64) for x in ([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], range(len(pairs)), [vocab[a + b] for a, b in pairs]))
        )
        symbol = byte_symbols()
        self.byte_id = np.zeros(256, dtype=np.int64)
        for c, b in symbol.items():
            self.byte_id[b] = vocab[c]
        self.bytes_of = {i: bytes(symbol[c] for c in s) for s, i in vocab.items()}
        self.whole = self._prove()
        self.kept: dict[str, int] = {}

    def _prove(self) -> set[str]:
        """The vocabulary strings that are one pre-token and come out of the merges as one token."""
        texts = []
        for b in self.bytes_of.values():
            try:
                t = b.decode()
            except UnicodeDecodeError:
                continue
            if (m := PRE_TOKEN.match(t)) and m.end() == len(t):
                texts.append(t)
        return {t for t, n in zip(texts, self.merge(texts), strict=True) if n == 1}

    def merge(self, pre_tokens: list[str]) -> list[int]:
        """How many tokens each pre-token is, by merge rounds over all of them."""
        if not pre_tokens:
            return []
        raw = [t.encode() for t in pre_tokens]
        starts = np.append(0, np.cumsum([len(b) for b in raw]))
        out, first = merge_words(self.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)], starts[:-1], self.table)
        return np.diff(np.append(first, len(out))).tolist()

    def count_words(self, words: list[str]) -> list[int]:
        """Tokens of each word on its own."""
        split = [PRE_TOKEN.findall(w) for w in words]
        rest = sorted({p for ps in split for p in ps}.difference(self.whole))
        merged = dict(zip(rest, self.merge(rest), strict=True))
        return [sum(merged.get(p, 1) for p in ps) for ps in split]

    def parts(self, text: str) -> list[str]:
        """text cut where no pre-token goes across: before single spaces; whole where white space is wider."""
        if WIDE.search(text):
            return [text]
        head, *rest = text.split(" ")
        return [head, *[" " + w for w in rest]]

    def count_all(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a special string counts as one token, as the library has it by default."""
        pieces, extra = [], []
        for t in texts:
            between = self.cut.split(t) if self.special else [t]
            extra.append(len(between) - 1)
            pieces.append([p for x in between for p in self.parts(x)])
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        new = sorted(set().union(*pieces).difference(self.kept))
        long = {w: n for w, n in zip(new, self.count_words(new), strict=True)} if new else {}
        self.kept.update((w, n) for w, n in long.items() if len(w) <= 64)
        kept = self.kept
        return [e + sum([kept[w] if w in kept else long[w] for w in ws]) for e, ws in zip(extra, pieces, strict=True)]


_counters: dict[str, Counter] = {}
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
CHUNK_CHARS = 4_000_000


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts, out, at, size = [t or "" for t in batch.column(1).to_pylist()], [], 0, 0
            for k, t in enumerate(texts):
                size += len(t)
                if size > CHUNK_CHARS or k == len(texts) - 1:
                    out += c.count_all(texts[at : k + 1])
                    at, size = k + 1, 0
            n_bytes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(out, pa.int64())], schema=_OUT)

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, one row per row of docs.

    Null and empty texts count 0; texts of any length count whole; other columns are not read; null and repeated ids
    stay as they are.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_run(tokenizer_path), SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)
