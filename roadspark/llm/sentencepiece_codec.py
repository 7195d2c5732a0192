"""SentencePiece BPE: encoding by vectorised merge rounds, and decoding.

A piece holds the space mark only at its start (or holds nothing but marks), so a text falls apart, before each run
of marks that follows another character, into words that encode on their own. Each batch encodes its new distinct
words together (bpe.merge_words); a bounded table per Python worker keeps the words seen before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspark.llm.bpe import MergeTable, merge_words

MARK = "▁"
WORD = re.compile(r" *[^ ]+| +")
KEPT_WORDS = 150_000
CHUNK_CHARS = 4_000_000
SCHEMA = "doc_id long, ids array<int>, decoded string"


class Codec:
    """A BPE model of the sentencepiece library with byte fallback, a dummy prefix and no other normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.unk = model.unk_id()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        piece = {model.id_to_piece(i): i for i in normal}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.fallback = len(self.byte) == 256
        if any(MARK in p.lstrip(MARK) for p in piece):
            raise ValueError("a piece holds a space mark inside: words can't be encoded on their own")
        # Symbols are numbered: single characters first known by their piece id; longer pieces by theirs.
        self.char = {p: i for p, i in piece.items() if len(p) == 1}
        score = {i: model.get_score(i) for i in normal}
        order = {i: r for r, i in enumerate(sorted((i for p, i in piece.items() if len(p) > 1), key=lambda i: (-score[i], i)))}
        left, right, rank, merged = [], [], [], []
        for p, i in piece.items():
            for k in range(1, len(p)):
                a, b = piece.get(p[:k]), piece.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(order[i]), merged.append(i)
        self.table = MergeTable(*(np.array(x, dtype=np.int64) for x in (left, right, rank, merged)))
        # Decoding: the bytes of every id.
        self.bytes = [b""] * n
        for p, i in piece.items():
            self.bytes[i] = p.replace(MARK, " ").encode()
        for value, i in self.byte.items():
            self.bytes[i] = bytes([value])
        self.bytes[self.unk] = " ⁇ ".encode()
        self.kept: dict[str, np.ndarray] = {}

    def _code_words(self, words: list[str]) -> None:
        """Encodes words (with marks as spaces) and keeps their ids."""
        symbols, starts, missing, at = [], [], {}, 0
        for w in words:
            starts.append(at)
            for c in w.replace(" ", MARK):
                i = self.char.get(c)
                if i is None:
                    i = missing.setdefault(c, -2 - len(missing))
                symbols.append(i)
            at = len(symbols)
        # a character outside the vocabulary takes part in no pair: any id without pairs will do
        spare = len(self.bytes)
        array = np.array(symbols, dtype=np.int64)
        absent = array < 0
        array[absent] = spare - 2 - array[absent]
        out, first = merge_words(array, np.array(starts, dtype=np.int64), self.table)
        ends = np.append(first[1:], len(out))
        names = {spare + k: c for k, c in enumerate(missing)}
        odd = np.add.reduceat(np.append(out >= spare, False), first) > 0 if names else None
        small = out.astype(np.int32)
        for k, w in enumerate(words):
            ids = small[first[k] : ends[k]]
            if odd is not None and odd[k]:
                flat: list[int] = []
                for i in ids.tolist():
                    if i < spare:
                        flat.append(i)
                    elif self.fallback:
                        flat.extend(self.byte[b] for b in names[i].encode())
                    elif not flat or flat[-1] != self.unk:
                        flat.append(self.unk)
                ids = np.array(flat, dtype=np.int32)
            self.kept[w] = ids.tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        split = []
        for t in texts:
            t = " " + t.replace(MARK, " ") if t else ""
            split.append(WORD.findall(t) if "  " in t or t.endswith(" ") else [" " + w for w in t.split(" ")[1:]] if t else [])
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        new = set().union(*split).difference(self.kept)
        if new:
            self._code_words(sorted(new))
        get = self.kept.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes in a row are read as UTF-8 and the dummy prefix goes."""
        text = b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") and ids and self.bytes[ids[0]][:1] == b" " and ids[0] not in self.byte.values() else text


_codecs: dict[str, Codec] = {}
_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size > CHUNK_CHARS:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _chunks(texts):
                coded = c.encode_all(texts[a:b])
                ids = np.frombuffer(b"".join(coded), dtype=np.int32)
                offsets = np.append(0, np.cumsum([len(x) // 4 for x in coded])).astype(np.int32)
                decoded = [c.decode(x) for x in (ids[offsets[k] : offsets[k + 1]].tolist() for k in range(b - a))]
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), column, pa.array(decoded, pa.string())], schema=_OUT)

    return run


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and the text that the ids decode to, one row per row of docs.

    Null and empty texts have no ids and decode to the empty text. Texts of any length are coded whole; characters
    outside the vocabulary become byte pieces. Other columns are not read; ids may be null or repeat.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_run(model_path), SCHEMA)


def codec_digest(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
