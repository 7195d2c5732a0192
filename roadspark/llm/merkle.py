"""Merkle manifest of a dataset: a leaf for each row, a tree for each group of rows, a tree over the groups.

A leaf's coordinate is its rank by id within its group. Ranks come from bitmaps, not from sorting leaves: ids are cut into
chunks of 1024, each group's chunk is a compressed bitmap (its non-empty 64-bit words), made in parts before the shuffle
and merged, with a directory of running counts, so that a rank is a look-up and a popcount. Only rows of words in which
an id occurs more than once are put in order. Trees are then reduced 256 slots at a time: leaves are placed in a keyed
slot array by their coordinate, a block gives its node eight levels up, and on the way down each block hands its
slots the siblings above them.

Digests are 32 bytes; a node is the SHA-256 of its children's lowercase hex digits. A proof has 33 bytes a level, from the leaf to
the root: 0 (no sibling), 1 (the sibling is on the right) or 2 (on the left), then the sibling's digest.
"""

from __future__ import annotations

from binascii import hexlify
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadspark.llm.common import stored
from roadspark.plans.store import numbered, running_total

LEVELS = 8  # of a block
NO_ID = -(1 << 60)  # the chunk of null ids; no id has it


def sized(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(sized(v) for v in values)), 256))


def coordinates(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves with tree, size, pos added, groups).

    leaves (stored): grp string, id long, leaf binary, row long (distinct), and more. tree: the group's number, null first, then
    bytewise. pos: the rank by id, null first; rows that share an id go by leaf, then by row. groups: grp, tree, size.
    """
    at = leaves.withColumns({"chunk": F.coalesce(F.shiftright("id", 10), F.lit(NO_ID)), "word": F.expr("coalesce(CAST(shiftright(id, 6) & 15 AS INT), 0)"), "bit": F.expr("coalesce(CAST(id & 63 AS INT), 0)")})
    words = at.groupBy("grp", "chunk", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.count(F.lit(1)).alias("n"))
    bitmaps = words.groupBy("grp", "chunk").agg(F.array_sort(F.collect_list(F.struct("word", "bits", "n"))).alias("words"), F.sum("n").alias("n"))
    ranked = stored(running_total(bitmaps, "grp", "chunk", weight="n"), "bitmaps")
    groups = stored(numbered(ranked.groupBy("grp").agg(F.min("before").alias("begin"), F.sum("n").alias("size")), "grp", name="tree"), "groups")
    counted = """transform(words, (w, i) -> struct(w.word AS word, w.bits AS bits, w.n > bit_count(w.bits) AS crowded,
        before - begin + aggregate(slice(words, 1, i), 0L, (a, x) -> a + x.n) AS before))"""
    g = groups.withColumnRenamed("grp", "__grp")
    directory = ranked.join(g, F.col("grp").eqNullSafe(F.col("__grp"))).select("__grp", F.col("chunk").alias("__chunk"), "tree", "size", F.expr(counted).alias("words"))
    met = at.join(directory, F.col("grp").eqNullSafe(F.col("__grp")) & (F.col("chunk") == F.col("__chunk")))
    entry = met.withColumn("entry", F.expr("filter(words, w -> w.word = word)[0]")).drop("words", "__grp", "__chunk")
    rank = F.expr("entry.before + bit_count(entry.bits & ~shiftleft(-1L, bit))")
    placed = stored(entry.select(*leaves.columns, "tree", "size", "chunk", "word", F.col("entry.crowded").alias("crowded"), F.when(F.col("entry.crowded"), F.col("entry.before")).otherwise(rank).alias("pos")), "placed")
    out = placed.where("NOT crowded").select(*leaves.columns, "tree", "size", "pos")
    if not placed.where("crowded").isEmpty():
        ordered = stored(numbered(placed.where("crowded"), "tree", "id", "leaf", "row"), "crowded")
        first = ordered.groupBy("tree", "chunk", "word").agg(F.min("idx").alias("first"))
        crowded = ordered.join(first, ["tree", "chunk", "word"]).withColumn("pos", F.col("pos") + F.col("idx") - F.col("first"))
        out = out.unionByName(crowded.select(*out.columns))
    return out, groups


def _levels(slots: list[bytes], size: int) -> list[list[bytes]]:
    """The nodes of a block, level by level; size: of its whole row of blocks."""
    rows = [slots]
    for _ in range(min(LEVELS, (size - 1).bit_length())):
        last = rows[-1]
        rows.append([sha256(b"".join(map(hexlify, last[k : k + 2]))).digest() for k in range(0, len(last), 2)])
    return rows


def _siblings(rows: list[list[bytes]]) -> np.ndarray:
    """(slots, levels * 33): the part of each slot's proof that lies in its block."""
    n = len(rows[0])
    out = np.zeros((n, len(rows) - 1, 33), dtype=np.uint8)
    for k, row in enumerate(rows[:-1]):
        own = np.arange(n) >> k
        other = own ^ 1
        there = other < len(row)
        out[there, k, 0] = 1 + own[there] % 2
        out[there, k, 1:] = np.frombuffer(b"".join(row), dtype=np.uint8).reshape(-1, 32)[other[there]]
    return out.reshape(n, -1)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.StructArray, np.ndarray, list[list[bytes]]]]:
    """Each block: its row, size, items, their slots and the levels. Items are placed in the slot array by their slot."""
    items = batch.column("items")
    for k, size in enumerate(batch.column("size").to_pylist()):
        own = items[k].values
        slot = own.field("slot").to_numpy(zero_copy_only=False)
        slots: list[bytes] = [b""] * len(own)
        for s, d in zip(slot.tolist(), own.field("leaf").to_pylist(), strict=True):
            slots[s] = d
        yield k, size, own, slot, _levels(slots, size)


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tops = [rows[-1][0] for *_, rows in _blocks(batch)]
        size = batch.column("size").to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column("tree"), pa.array(-(-size >> LEVELS)), batch.column("block"), pa.array(tops, pa.binary())], names=["tree", "size", "pos", "leaf"])


def _down(kept: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = {c: batch.column(c).to_pylist() for c in ("above", "subroot", "root", "block", "tree")}
            for k, _, own, slot, rows in _blocks(batch):
                proof, upper = _siblings(rows)[slot], above["above"][k]
                n = len(own)
                columns = {
                    "tree": pa.array([above["tree"][k]] * n, pa.int64()), "pos": pa.array(above["block"][k] * (1 << LEVELS) + slot.astype(np.int64)), "leaf": own.field("leaf"),
                    "subroot": pa.array([above["subroot"][k]] * n, pa.binary()), "root": pa.array([above["root"][k]] * n, pa.binary()), "proof": pa.array([p.tobytes() + upper for p in proof], pa.binary()),
                }
                yield pa.RecordBatch.from_arrays([columns[c] if c in columns else own.field(c) for c in schema.names], schema=schema)

    return run


_NODE = "tree long, size long, pos long, leaf binary"


def _packed(nodes: DataFrame, kept: list[str]) -> DataFrame:
    """tree, size, block, items: nodes dealt into the slot arrays of their blocks. Stored."""
    slot = (F.col("pos") % (1 << LEVELS)).cast("int").alias("slot")
    return stored(nodes.groupBy("tree", "size", F.shiftright("pos", LEVELS).alias("block")).agg(F.collect_list(F.struct(slot, "leaf", *kept)).alias("items")), "blocks")


def climb(nodes: DataFrame, most: int, kept: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """(tiers of blocks from the leaves up, the top node of each tree). nodes: tree, size, pos, leaf; most: the largest size."""
    tiers = []
    while True:
        tiers.append(_packed(nodes, kept))
        nodes, kept, most = stored(tiers[-1].mapInArrow(_up, _NODE), "nodes"), [], -(-most >> LEVELS)
        if most <= 1:
            return tiers, nodes


def descend(tiers: list[DataFrame], above: DataFrame, kept: list[str]) -> DataFrame:
    """tree, pos, leaf, subroot, root, proof and the kept columns of all leaves. above: tree, block, above, subroot, root."""
    out = above
    for k, tier in reversed(list(enumerate(tiers))):
        own = kept if k == 0 else []
        fields = tier.schema["items"].dataType.elementType
        types = {f.name: f.dataType.simpleString() for f in fields}
        columns = {"tree": "bigint", "pos": "bigint", "leaf": "binary", "subroot": "binary", "root": "binary", "proof": "binary"} | {c: types[c] for c in own}
        arrow = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
        schema = pa.schema([(c, arrow[t]) for c, t in columns.items()])
        rows = tier.join(out, ["tree", "block"]).mapInArrow(_down(own, schema), ", ".join(f"`{c}` {t}" for c, t in columns.items()))
        out = rows if k == 0 else stored(rows.select("tree", F.col("pos").alias("block"), F.col("proof").alias("above"), "subroot", "root"), "paths")
    return out


def merkle_manifest(leaves: DataFrame) -> DataFrame:
    """grp's number tree, pos, leaf, subroot, root, proof and all other columns of leaves but grp and row: one row per leaf.

    leaves: grp string, id long, leaf binary and more columns of simple types. Within a group leaves ascend by id; null groups
    and null ids come first; rows that share an id go by leaf, and equal rows may stand in either order. Two consecutive
    nodes become one while there are several, a last one alone becomes one too; a group of one leaf is its own subroot. The
    subroots, by group, are the leaves of the last tree. An empty table gives an empty table.
    """
    rows = stored(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    kept = [c for c in leaves.columns if c not in ("grp", "leaf")]
    placed, groups = coordinates(rows)
    sizes = groups.agg(F.count(F.lit(1)), F.max("size")).first()
    tiers, subroots = climb(placed, sizes[1] or 0, kept)
    trees, root = climb(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(sizes[0]).cast("long").alias("size"), F.col("tree").alias("pos"), "leaf"), sizes[0], [])
    top = root.select("tree", F.col("pos").alias("block"), F.lit(b"").alias("above"), F.col("leaf").alias("subroot"), F.col("leaf").alias("root"))
    paths = descend(trees, top, []).select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("proof").alias("above"), F.col("leaf").alias("subroot"), "root")
    return descend(tiers, stored(paths, "paths"), kept)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], []]
        for leaf, proof in zip(batch.column("claimed").to_pylist(), batch.column("proof").to_pylist(), strict=True):
            node, seen = leaf, []
            for k in range(0, len(proof), 33):
                side, other = proof[k], hexlify(proof[k + 1 : k + 33])
                if side:
                    seen.append(other)
                own = hexlify(node)
                node = sha256(own if side == 0 else own + other if side == 1 else other + own).digest()
            out[0].append(node)
            out[1].append(sha256(b"".join(seen)).digest())
        n = batch.num_columns
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], names=[*batch.schema.names, "folded_root", "proof_sha256"])


def fold_proofs(manifest: DataFrame) -> DataFrame:
    """manifest with folded_root, what its proof makes of the column claimed (a leaf), and proof_sha256, of all siblings' hex digits."""
    return manifest.mapInArrow(_fold, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in manifest.schema) + ", folded_root binary, proof_sha256 binary")


def document_leaves(docs: DataFrame) -> DataFrame:
    """grp (lang), id (doc_id), leaf, and claimed: the leaf after the tampering that the contract describes. Other columns are not read."""
    fields = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), F.col("text")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    leaf = leaf_of(*fields)
    return docs.select(F.col("lang").alias("grp"), F.col("doc_id").cast("long").alias("id"), leaf.alias("leaf"), F.when(tampered, leaf_of(*fields[:3], fields[3].cast("decimal(20,0)") + 1, fields[4])).otherwise(leaf).alias("claimed"))


def manifest_digest(manifest: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (hex) and whether the folded root is the root."""
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return fold_proofs(manifest).select(F.col("id").alias("doc_id"), *(text(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), (F.col("folded_root") == F.col("root")).alias("verified"))
