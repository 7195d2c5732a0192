"""Jaccard join of word n-gram sets, size-aware.

Small (light) sets enumerate their subsets of fixed size: within the boundary two different sets can only link when one
is the other less one member, so a set and its subsets without one member are looked up by hash, with nothing left to
verify. Large (heavy) sets scan inverted lists of their rarest members, as many as any partner has to share one of. The
boundary is where, over the sizes at hand, enumerating costs less than scanning and verifying. Equal sets are one class
throughout.

List members are first tested against the one most typical of their list; what stays in different components is then
tested pair by pair, so a group of copies costs no pairs within itself and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadspark.llm.common import Bits, bitmap, discard, marked, stored
from roadspark.llm.components import components
from roadspark.llm.lz_fingerprint import _powers, mix

CHUNK_BYTES = 1 << 18
SLICE = 500  # rows worked on together
ENTRIES = 400_000  # list entries packed together
PART_ENTRIES = 250_000  # list entries that are looked through together, about
CELL_BITS, CHUNK_BITS = 24, 12  # members are counted in 2^24 cells by the first bits of their hash, 2^12 cells to a row
LIST_BITS = 48  # bits of a member's hash that name its list; lists that share a name only bring in pairs that then fail
SALTS = 32
SHORT = 8  # lists of up to so many entries are paired off where they are gathered
FEW = 1_000_000  # up to so many rows of keys are broadcast, some 60 MB
LIST_WEIGHT = 9  # a list entry's cost against a subset's: it may have to be verified
LOWEST = -(1 << 63)

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Rule(NamedTuple):
    """Sets of shingles of so many words link at a Jaccard similarity of p / q."""

    words: int = 3
    p: int = 9
    q: int = 10

    def required(self, n: int) -> int:
        """Members that a set of size n shares with any partner, at least."""
        return -(-self.p * n // self.q)

    @property
    def least(self) -> int:
        """Smaller sets link only with equal ones: the least i with i / (i + 1) >= p / q."""
        return -(-self.p // (self.q - self.p))

    @property
    def subset_limit(self) -> int:
        """Up to this size one member is all that linked sets can differ by: the least i with i / (i + 2) >= p / q."""
        return -(-2 * self.p // (self.q - self.p))


def rule_of(words: int, similarity: float) -> Rule:
    share = Fraction(str(similarity))
    if words < 1 or not 0 < share < 1:
        raise ValueError("shingles have at least one word, similarities lie between 0 and 1")
    return Rule(words, share.numerator, share.denominator)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces, so that what is held for a piece stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Works on bytes: only A-Z are lowered, words end at the six ASCII blanks."""
    texts = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None and len(texts.buffers()[2]) else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        yield from _chunk(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], words)
        at = to


def _chain(word: np.ndarray, words: int) -> np.ndarray:
    """The hash of each run of so many words."""
    count = len(word) - words + 1
    out = mix(word[words - 1 :] * (_A, _B, _C)[(words - 1) % 3])
    for j in range(words - 2, -1, -1):
        out = mix(word[j : j + count] * (_A, _B, _C)[j % 3] + out)
    return out


def _chunk(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    empty = np.empty(0, dtype=np.uint64)
    if not len(data):
        yield from (empty for _ in range(len(offsets) - 1))
        return
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    left = solid.copy()
    left[1:] &= ~solid[:-1] | edge[1:-1]
    right = solid.copy()
    right[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(left), np.flatnonzero(right) + 1
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[low] * power[: len(data)], out=total[1:])
    word = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _C)
    first = np.searchsorted(start, offsets)
    runs = _chain(word, words) if len(word) >= words else empty
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= words:
            h = np.sort(runs[a : b - words + 1])
            yield h[np.append(True, h[1:] != h[:-1])]
        elif b > a:
            yield mix(_chain(word[a:b], int(b - a)) + np.uint64(b - a))
        else:
            yield empty


def _key(members: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set; the first is a sum over its members, so that of a subset follows by taking away."""
    a, b = mix(members ^ _A), mix(members ^ _B)
    return int(np.add.reduce(a, dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(b).view(np.int64)) if len(b) else 0

def _parity(members: np.ndarray) -> int:
    """Which of 64 classes of hashes hold an odd number of members."""
    return int(np.bitwise_xor.reduce(np.uint64(1) << (members & np.uint64(63))).view(np.int64)) if len(members) else 0


_ONE_SQL = "doc_id long, row long, n long, key long, check long, parity long, sketch binary, chunk long, cells binary"
_ONE = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in _ONE_SQL.split(", ")])


def _sketch(members: np.ndarray) -> bytes:
    """Counts of members, modulo 16 and two to a byte, in cells by the first bits of their hash: a cell for about four."""
    bits = min(13, max(6, (len(members) // 4).bit_length()))
    cells = np.bincount((members >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 15
    return (cells[::2] | cells[1::2] << 4).astype(np.uint8).tobytes()


def _cells(sketch: bytes) -> np.ndarray:
    packed = np.frombuffer(sketch, dtype=np.uint8).astype(np.int32)
    return np.stack([packed & 15, packed >> 4], axis=1).reshape(-1)


def _may_link(sketch_a: bytes, sketch_b: bytes, n: int, rule: Rule) -> bool:
    """False only if the cells' differences, at most the symmetric difference, rule a link out. n: both sizes together."""
    a, b = sorted((_cells(sketch_a), _cells(sketch_b)), key=len)
    differ = (a - b.reshape(len(a), -1).sum(axis=1)) & 15
    return (rule.p + rule.q) * int(np.minimum(differ, 16 - differ).sum()) <= (rule.q - rule.p) * n


def _describe(words: int):
    """A row per document; then rows with the cell counts of the members of all distinct sets, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: np.ndarray | None = None
        seen: set[tuple[int, int]] = set()
        for batch in _slices(batches):
            rows, new = [], []
            for members in shingle_sets(batch.column(1), words):
                key = _key(members)
                rows.append((len(members), *key, _parity(members), _sketch(members)))
                if key not in seen and len(members):
                    seen.add(key)
                    new.append(members >> np.uint64(64 - CELL_BITS))
            if new:
                if counts is None:
                    counts = np.zeros(1 << CELL_BITS, dtype=np.uint16)
                cell, n = np.unique(np.concatenate(new).astype(np.int32), return_counts=True)
                counts[cell] = np.minimum(counts[cell] + n, 65_535)
            if len(seen) > 1_000_000:
                seen.clear()
            own = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(list(_ONE)[2:7])]
            none = pa.nulls(len(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *own, none.cast(pa.int64()), none.cast(pa.binary())], schema=_ONE)
        if counts is not None:
            pack = zstandard.ZstdCompressor(level=3).compress
            chunks = counts.reshape(-1, 1 << CHUNK_BITS)
            for at in range(0, len(chunks), 256):
                packed = [pack((c & 255).astype(np.uint8).tobytes() + (c >> 8).astype(np.uint8).tobytes()) for c in chunks[at : at + 256]]
                none = pa.nulls(len(packed))
                yield pa.RecordBatch.from_arrays([none.cast(f.type) for f in list(_ONE)[:7]] + [pa.array(np.arange(at, at + len(packed))), pa.array(packed, pa.binary())], schema=_ONE)

    return run


def _add_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk -> one row a chunk, its summed counts on a logarithmic scale of one byte."""
    at, total = None, None
    unpack = zstandard.ZstdDecompressor().decompress

    def row() -> pa.RecordBatch:
        scale = np.minimum(np.round(11.5 * np.log2(1.0 + total)), 255).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([scale.tobytes()], pa.binary())], names=["chunk", "scale"])

    for batch in batches:
        for chunk, cells in zip(*(batch.column(c).to_pylist() for c in ("chunk", "cells")), strict=True):
            if chunk != at:
                if at is not None:
                    yield row()
                at, total = chunk, np.zeros(1 << CHUNK_BITS, dtype=np.int64)
            low, high = np.frombuffer(unpack(cells), dtype=np.uint8).reshape(2, -1)
            total += low + (high.astype(np.int64) << 8)
    if at is not None:
        yield row()


def _rareness(told: DataFrame) -> np.ndarray:
    """A byte for each of the 2^24 cells, higher where more members fall: 16 MB, whatever the input."""
    chunks = told.where("chunk is not null").select("chunk", "cells").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_add_cells, "chunk long, scale binary")
    scale = np.zeros((1 << (CELL_BITS - CHUNK_BITS), 1 << CHUNK_BITS), dtype=np.uint8)
    for r in chunks.collect():
        scale[r["chunk"]] = np.frombuffer(r["scale"], dtype=np.uint8)
    return scale.reshape(-1)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, the first ascending and kept as differences; byte plane by byte plane, compressed."""
    steps = np.diff(columns[0], prepend=np.uint64(0))
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in (steps, *columns[1:])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes, types: tuple[str, ...]) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    sizes = [np.dtype(t).itemsize for t in types]
    n, out, at = len(data) // sum(sizes), [], 0
    for t, size in zip(types, sizes, strict=True):
        out.append(np.ascontiguousarray(data[at : at + n * size].reshape(size, n).T).view(t).reshape(-1))
        at += n * size
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


ASKED, LONG, SUBSETS = 0, 1, 2  # kinds of blobs
_ENTRY, _SUBSET = ("<u8", "<u8", "<u4", "<u4"), ("<u8", "<i8", "<u4")
_PART = pa.schema([("part", pa.int64()), ("kind", pa.int64()), ("blob", pa.binary())])


def _runs(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start, and their lengths."""
    first = np.flatnonzero(np.append(True, ascending[1:] != ascending[:-1]))
    return first, np.diff(np.append(first, len(ascending)))


class _Block:
    """List entries (list, short set name, position, size) and subset rows of many sets, packed for the parts of the lists' range.

    Entries of lists that more than SHORT sets of the block share go on as they are, dealt evenly, and of such a list only
    its name goes to its part. So a list of very many sets meets no task as a whole here.
    """

    def __init__(self, parts: int, short_bits: int):
        self.parts, self.short_bits, self.size = parts, short_bits, 0
        self.entries: list[tuple[np.ndarray, int, int]] = []
        self.subsets: list[tuple[np.ndarray, int, int]] = []

    def prefix(self, members: np.ndarray, node: int, n: int) -> None:
        self.entries.append((members >> np.uint64(64 - LIST_BITS), (node & 0xFFFFFFFFFFFFFFFF) >> (64 - self.short_bits), n))
        self.size += len(members)

    def subset(self, hashes: np.ndarray, node: int, n: int) -> None:
        """hashes: of the set itself, then of its subsets."""
        self.subsets.append((hashes, node, n))
        self.size += len(hashes)

    def _part(self, lists: np.ndarray) -> np.ndarray:
        return (lists * np.uint64(self.parts)) >> np.uint64(LIST_BITS)

    def flush(self) -> pa.RecordBatch:
        rows: list[tuple[int, int, bytes]] = []

        def by_part(kind: int, lists: np.ndarray, *columns: np.ndarray) -> None:
            part = self._part(lists)
            cuts = np.append(np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1))), len(part)) if len(part) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                rows.append((int(part[a]), kind, _pack(*(c[a:b] for c in columns))))

        if self.entries:
            lists = np.concatenate([m for m, _, _ in self.entries])
            held = [len(m) for m, _, _ in self.entries]
            short = np.repeat(np.array([s for _, s, _ in self.entries], dtype=np.uint64), held)
            size = np.repeat(np.array([n for _, _, n in self.entries], dtype=np.uint32), held)
            pos = np.concatenate([np.arange(n, dtype=np.uint32) for n in held])
            order = np.argsort(lists, kind="stable")
            lists, short, pos, size = lists[order], short[order], pos[order], size[order]
            first, length = _runs(lists)
            long = np.repeat(length > SHORT, length)
            asked = ~long
            asked[first] = True  # every long list once, with size 0
            by_part(ASKED, lists[asked], lists[asked], short[asked], pos[asked], np.where(long, np.uint32(0), size)[asked])
            own = lists[long], short[long], pos[long], size[long]
            for a in range(0, len(own[0]), 1 << 14):
                piece = [c[a : a + (1 << 14)] for c in own]
                rows.append((self.parts + int(piece[0][0] ^ piece[1][0]) % self.parts, LONG, _pack(*piece)))
        if self.subsets:
            hashes = np.concatenate([h for h, _, _ in self.subsets])
            node = np.concatenate([np.full(len(h), k, dtype=np.int64) for h, k, _ in self.subsets])
            full = np.concatenate([np.append(np.uint32(1), np.zeros(len(h) - 1, np.uint32)) for h, _, _ in self.subsets])
            order = np.argsort(hashes, kind="stable")
            by_part(SUBSETS, hashes[order] >> np.uint64(64 - LIST_BITS), hashes[order], node[order], full[order])
        self.entries, self.subsets, self.size = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PART)], schema=_PART)


def _lists(shared, light: int, rule: Rule, parts: int, short_bits: int):
    """Packed list entries of heavy sets (and of light ones that a heavy one may link to), and subset rows of light sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, clashes = shared.value
        block = _Block(parts, short_bits)
        seen: set[tuple[int, int]] = set()
        for batch in _slices(batches):
            for s in shingle_sets(batch.column(1), rule.words):
                n = len(s)
                if n < rule.least:
                    continue
                key = _key(s)
                if key in seen:
                    continue
                seen.add(key)
                if len(seen) > 1_000_000:
                    seen.clear()
                node = clashes.get(key, key[0])
                if n <= light:
                    less = np.uint64(key[0] & 0xFFFFFFFFFFFFFFFF) - mix(s ^ _A)
                    block.subset(mix(np.append(np.array(key[:1], dtype=np.int64).view(np.uint64), less) + _C * np.append(n, np.full(n, n - 1)).astype(np.uint64)), node, n)
                if n > light or rule.q * n >= rule.p * (light + 1):
                    # s is in order of hashes, so a stable sort orders by rareness, then hash
                    k = n - rule.required(n) + 1
                    block.prefix(s[np.argsort(scale[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)], kind="stable")[:k]], node, n)
                if block.size >= ENTRIES:
                    yield block.flush()
        if block.size:
            yield block.flush()

    return run


_FOUND_SQL = "list long, short long, pos long, other long, key long, full long"
_FOUND = pa.schema([(x.split()[0], pa.int64()) for x in _FOUND_SQL.split(", ")])


def _found(n: int, **columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name].astype(np.int64)) if f.name in columns else pa.nulls(n, pa.int64()) for f in _FOUND], schema=_FOUND)


def _shared(rule: Rule):
    """Blobs by part and kind -> candidate pairs of short lists, entries of long ones, and subset rows that several sets have."""

    def asked(lists: np.ndarray, short: np.ndarray, pos: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        first, length = _runs(lists)
        is_long = (length > SHORT) | (np.minimum.reduceat(size, first) == 0)
        entry = np.repeat(is_long & (length > 1), length) & (size > 0)
        for at in range(0, len(lists), 100_000):
            keep = entry[at : at + 100_000]
            if keep.any():
                yield _found(int(keep.sum()), **{k: c[at : at + 100_000][keep] for k, c in (("list", lists), ("short", short), ("pos", pos))})
        keep = np.repeat(~is_long & (length > 1), length)
        lists, short, pos, size = lists[keep], short[keep], pos[keep].astype(np.int64), size[keep].astype(np.int64)
        pairs = [np.empty((0, 2), np.uint64)]
        for d in range(1, SHORT):
            a, b = slice(None, -d), slice(d, None)
            n, m = size[a], size[b]
            near = (lists[a] == lists[b]) & (short[a] != short[b]) & (rule.q * np.minimum(n, m) >= rule.p * np.maximum(n, m))
            near &= (rule.p + rule.q) * np.minimum(n - pos[a], m - pos[b]) >= rule.p * (n + m)
            pairs.append(np.sort(np.stack([short[a][near], short[b][near]], axis=1), axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        if len(pairs):
            yield _found(len(pairs), short=pairs[:, 0], other=pairs[:, 1])

    def subsets(hashes: np.ndarray, node: np.ndarray, full: np.ndarray) -> Iterator[pa.RecordBatch]:
        first, length = _runs(hashes)
        keep = np.repeat(length > 1, length)
        yield _found(int(keep.sum()), list=hashes[keep].view(np.int64), key=node[keep], full=full[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        held: list[bytes] = []

        def gathered() -> Iterator[pa.RecordBatch]:
            types, done = (_SUBSET, subsets) if at[1] == SUBSETS else (_ENTRY, asked)
            columns = [np.concatenate(c) for c in zip(*(_unpack(b, types) for b in held), strict=True)]
            order = np.argsort(columns[0], kind="stable")
            yield from done(*(c[order] for c in columns))

        for batch in batches:
            for part, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "blob")), strict=True):
                if kind == LONG:
                    lists, short, pos, _ = _unpack(blob, _ENTRY)
                    yield _found(len(lists), list=lists, short=short, pos=pos)
                    continue
                if (part, kind) != at:
                    if held:
                        yield from gathered()
                    at, held = (part, kind), []
                held.append(blob)
        if held:
            yield from gathered()

    return run


def _members_of(words: int, bits: Bits):
    """(key, check, members) of the sets of the rows that the bitmap marks. Rows: id, text, place in the bitmap."""
    schema = pa.schema([("key", pa.int64()), ("check", pa.int64()), ("members", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in _slices(batches):
            batch = batch.filter(pa.array(bits.marks(batch.column(2).to_numpy(zero_copy_only=False))))
            sets = [(*_key(s), s.tobytes()) for s in shingle_sets(batch.column(1), words)]
            sets = [x for x in sets if x[:2] not in seen and not seen.add(x[:2])]
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in sets], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def _sketch_filter(rule: Rule):
    """Drops the pairs whose sketches rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            columns = (batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "n_a", "n_b"))
            keep = pa.array([_may_link(a, b, n + m, rule) for a, b, n, m in zip(*columns, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b", "rep_a", "rep_b")], names=["a", "b", "rep_a", "rep_b"])

    return run


def _verify(rule: Rule):
    """Rows by (a, salt), the set a itself first (b null): (a, b) of the pairs that link."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, of = np.empty(0, np.uint64), None
        for batch in _slices(batches):
            u, v = [], []
            for a, b, members in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "members")), strict=True):
                s = np.frombuffer(members, dtype=np.uint64)
                if b is None:
                    centre, of = s, a
                elif a == of and len(s) and len(centre):
                    at = np.minimum(np.searchsorted(centre, s), len(centre) - 1)
                    if (rule.p + rule.q) * int((centre[at] == s).sum()) >= rule.p * (len(s) + len(centre)):
                        u.append(a)
                        v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)

    return run


def _renamed(df: DataFrame, clashes: dict[tuple[int, int], int]) -> DataFrame:
    """df (key, check, ...) with the key replaced where two different sets share it: one row for 2^64 pairs of sets, about."""
    if not clashes:
        return df
    table = F.create_map(*(x for (k, c), node in clashes.items() for x in (F.lit(f"{k}/{c}"), F.lit(node))))
    return df.withColumn("key", F.coalesce(F.try_element_at(table, F.concat_ws("/", "key", "check")), F.col("key")))


def _few(df: DataFrame) -> DataFrame:
    """A stored or small table of keys, marked for broadcast if its size allows it; joined by a shuffle beyond that."""
    return F.broadcast(df) if df.count() <= FEW else df


def _linked(rows: DataFrame, told: DataFrame, classes: DataFrame, pairs: DataFrame, rule: Rule, clashes: dict) -> DataFrame:
    """(u, v) of the pairs (a, b) of class keys whose sets are similar enough. Sketches first, then whole sets."""
    a, b = (classes.select(F.col("key").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}")) for x in "ab")
    near = f"{rule.p + rule.q} * bit_count(parity_a ^ parity_b) <= {rule.q - rule.p} * (n_a + n_b)"
    sized = stored(pairs.join(a, "a").join(b, "b").where(near).drop("parity_a", "parity_b"), "sized")
    ends = sized.select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("rep_a").alias("doc_id")), F.struct(F.col("b").alias("key"), F.col("rep_b").alias("doc_id")))).alias("e")).select("e.*").distinct()
    sketches = stored(told.select("key", "doc_id", "sketch").join(ends, ["key", "doc_id"]).select("key", "sketch").dropDuplicates(["key"]), "sketches")
    for x in "ab":
        sized = sized.join(sketches.select(F.col("key").alias(x), F.col("sketch").alias(f"sketch_{x}")), x)
    near = stored(sized.mapInArrow(_sketch_filter(rule), "a long, b long, rep_a long, rep_b long"), "pairs")
    bits = bitmap(near.select(F.explode(F.array("rep_a", "rep_b")).alias("key")))
    sets = _renamed(rows.withColumn("place", bits.place(F.col("doc_id"))).mapInArrow(_members_of(rule.words, bits), "key long, check long, members binary"), clashes).select("key", "members")
    dealt = near.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"))
    centres = dealt.select("a", "salt").distinct().withColumn("b", F.lit(None).cast("long"))
    both = dealt.select("a", "b", "salt", F.col("b").alias("key")).unionByName(centres.select("a", "b", "salt", F.col("a").alias("key")))
    shipped = sets.join(_few(both), "key").select("a", "salt", "b", "members").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return shipped.select("a", "b", "members").mapInArrow(_verify(rule), "u long, v long")


def _boundary(sizes: dict[int, int], rule: Rule) -> int:
    """The largest light size, by cost: n + 1 subset rows against list entries that may need verifying."""
    cost = lambda x: sum(c * (n + 1 if n <= x else LIST_WEIGHT * (n - rule.required(n) + 1)) for n, c in sizes.items())
    return min(range(rule.least, rule.subset_limit + 1), key=lambda x: (cost(x), x))


def _clashes(classes: DataFrame) -> dict[tuple[int, int], int]:
    """(key, check) -> another key, for all but the first of different sets that share a key. With n sets about n^2 / 2^65 rows."""
    keys = [r["key"] for r in classes.groupBy("key").count().where("count > 1").collect()]
    first: set[int] = set()
    again = [tuple(r) for r in classes.where(F.col("key").isin(keys)).select("key", "check").orderBy("key", "check").collect()] if keys else []
    again = [x for x in again if x[0] in first or first.add(x[0])]
    return {(k, c): int(mix(np.array([k ^ c], dtype=np.int64).view(np.uint64)).view(np.int64)[0]) for k, c in again}


def _placed(docs: DataFrame, rule: Rule, id_col: str, text_col: str, row: Column) -> DataFrame:
    """doc_id (LOWEST for null), row, n, key, component (the least key of the linked sets) of every row of docs."""
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("doc_id"), F.col(text_col).alias("text"), row.cast("long").alias("row"))
    rows = keyed.select("doc_id", "text")
    told = stored(keyed.mapInArrow(_describe(rule.words), _ONE_SQL), "sets")
    by_set = told.where(f"n >= {rule.least}").groupBy("key", "check").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("parity").alias("parity"))
    classes = stored(by_set, "classes")
    clashes = _clashes(classes)
    scale = _rareness(told)
    told, classes = _renamed(told.where("n is not null"), clashes), _renamed(classes, clashes)
    sizes = {r["n"]: r["count"] for r in classes.where(f"n <= {2 * rule.subset_limit}").groupBy("n").count().collect()}
    light = _boundary(sizes, rule)
    n_classes, n_entries = classes.agg(F.count(F.lit(1)), F.sum(F.expr(f"n - ceil({rule.p} * n / {rule.q}) + 2"))).first()
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(n_entries or 0) // PART_ENTRIES)
    parts, short_bits = min(parts, 1 << 15), min(60, n_classes.bit_length() + 8)
    packed = rows.mapInArrow(_lists(spark.sparkContext.broadcast((scale, clashes)), light, rule, parts, short_bits), "part long, kind long, blob binary")
    shared = stored(packed.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_shared(rule), _FOUND_SQL), "shared")
    named = classes.select(F.shiftrightunsigned("key", 64 - short_bits).alias("short"), "key", "n", "parity")
    lists = stored(shared.where("pos is not null").select("list", "short", "pos").join(named, "short").select("list", "key", "parity", F.col("n").cast("int").alias("n"), F.col("pos").cast("int").alias("pos")), "lists")
    pairs = shared.where("other is not null").select("short", "other").distinct().join(named.select("short", F.col("key").alias("a")), "short").join(named.select(F.col("short").alias("other"), F.col("key").alias("b")), "other").select("a", "b")
    subsets = shared.where("full is not null").select("list", "key", "full")
    smaller = subsets.where("full = 1").select("list", F.col("key").alias("a")).join(subsets.where("full = 0").select("list", F.col("key").alias("b")), "list").select("a", "b")
    p, q = rule.p, rule.q
    may = f"{q} * least({{n}}, {{m}}) >= {p} * greatest({{n}}, {{m}}) and {p + q} * least({{n}} - {{i}}, {{m}} - {{j}}) >= {p} * ({{n}} + {{m}}) and {p + q} * bit_count({{p}} ^ {{q}}) <= {q - p} * ({{n}} + {{m}})"
    centres = lists.groupBy("list").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.min(F.struct("pos", "n", "key", "parity")).alias("centre")).where("least <> most")
    centres = stored(centres.select("list", "centre"), "centres")
    tested = F.expr("key <> centre.key and " + may.format(n="n", m="centre.n", i="pos", j="centre.pos", p="parity", q="centre.parity"))
    live = stored(lists.join(centres, "list").select("list", "key", "parity", "n", "pos", F.when(tested, F.col("centre.key")).alias("centre")), "live")
    discard(lists, centres)
    first = live.where("centre is not null").select(F.col("centre").alias("a"), F.col("key").alias("b")).unionAll(smaller).unionAll(pairs).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stored(_linked(rows, told, classes, first, rule, clashes), "links")
    discard(shared)
    part = stored(components(links), "components")
    # lists that still hold several components: every pair across them, but for pairs within the list's largest component
    placed = live.drop("centre").join(part.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    by_component = stored(placed.groupBy("list", "component").count(), "counts")
    main = by_component.groupBy("list").agg(F.count(F.lit(1)).alias("several"), F.max_by("component", F.struct("count", "component")).alias("main")).where("several > 1").select("list", "main")
    placed = stored(placed.join(main, "list"), "mixed")
    discard(live, by_component)
    left = placed.where("component <> main").select("list", *(F.col(c).alias(f"l_{c}") for c in ("key", "parity", "n", "pos", "component")))
    across = left.join(placed, "list").where("component <> l_component and (component = main or l_key < key)")
    across = across.where(may.format(n="n", m="l_n", i="pos", j="l_pos", p="parity", q="l_parity"))
    second = across.select(F.least("l_key", "key").alias("a"), F.greatest("l_key", "key").alias("b")).distinct()
    more = _linked(rows, told, classes, second, rule, clashes)
    ends = part.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(more)
    final = components(ends).withColumnRenamed("node", "key")
    discard(placed)
    return told.select("doc_id", "row", "n", "key").join(final, "key", "left").withColumn("component", F.coalesce("component", "key"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, similarity: float = 0.9) -> DataFrame:
    """doc_id, n_shingles, class_key, component_id: one row per row of docs.

    Sets of shingles of so many words (fewer words: the sequence as one); links at that Jaccard similarity; component_id
    is the least id reachable. Null, empty and blank texts have empty sets, link with nothing and are components of their
    own. Equal sets link, whatever their texts; repeated ids stay as they are; a null id gets the least id of its
    component, null if there is none. Whole texts count; other columns are not read; an empty table gives an empty one.
    """
    joined = _placed(docs, rule_of(words, similarity), id_col, text_col, F.lit(None))
    own = F.nullif(F.col("doc_id"), F.lit(LOWEST))
    least = joined.where("n > 0").groupBy("component").agg(F.min(own).alias("least"))
    out = joined.join(least, "component", "left")
    return out.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), F.col("key").alias("class_key"), F.when(F.col("n") > 0, F.col("least")).otherwise(own).alias("component_id"))


def drop_near_copies(docs: DataFrame, words: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ngram_components, and all rows without words.

    Kept is the row with the least id, null ids last; among rows of one id the one with the least hash of all columns, so
    that neither null nor repeated ids keep copies or lose texts. Of rows that are equal in all columns one stays. Rows
    that a bitmap of the leaving ones doesn't mark pass by; only marked ones are shuffled to be looked up.
    """
    row = F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns))
    found = stored(_placed(docs, rule_of(words, similarity), id_col, text_col, row).select("doc_id", "row", "n", "component"), "placed")
    equal = stored(found.where("n > 0").groupBy("component", "doc_id", "row").agg(F.count(F.lit(1)).alias("copies")), "equal")
    order = F.struct((F.col("doc_id") == LOWEST).alias("none"), "doc_id", "row")
    kept = stored(equal.groupBy("component").agg(F.min(order).alias("kept")), "kept")
    stays = F.expr("doc_id = kept.doc_id and row = kept.row")
    going = stored(equal.join(kept, "component").where(~stays | (F.col("copies") > 1)).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), stays.alias("__kept")), "going")
    own = docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)), "__row": row})
    at = lambda: F.xxhash64("__id", "__row")
    bits = bitmap(going.select(at().alias("key")))
    asked = stored(marked(own, at(), bits).join(_few(going), ["__id", "__row"], "left"), "asked")
    once = asked.where("__kept").dropDuplicates(["__id", "__row"])
    return marked(own, at(), bits, False).unionByName(asked.where("__kept is null").unionByName(once).drop("__kept")).select(*docs.columns)
