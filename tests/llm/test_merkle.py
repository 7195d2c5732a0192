"""The Merkle manifest against a plain one over lists, and its SQL."""

import hashlib
import zlib

import duckdb
import pytest

from roadspark.llm.merkle import document_leaves, manifest_digest, merkle_manifest
from roadspark.llm.queries import ORACLE_SQL, op13_merkle_manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*map(enc, (doc_id, source, lang, n_chars, text)))


def path(nodes, at):
    """(siblings with sides, top)."""
    out = []
    while len(nodes) > 1:
        other = at ^ 1
        out.append((None, None) if other >= len(nodes) else (nodes[other], other < at))
        nodes, at = [H(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)], at // 2
    return out, nodes[0]


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = []
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        tops.append(path([x[2] for x in groups[g]], 0)[1])
    out = []
    for k, g in enumerate(order):
        above, root = path(tops, k)
        for n, (_, _, own, r) in enumerate(groups[g]):
            way = path([x[2] for x in groups[g]], n)[0] + above
            node = own
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                node = leaf(*r[:4], r[4] + 1)
            same = node == own
            for other, left in way:
                node = H(node) if other is None else H(other, node) if left else H(node, other)
            assert not same or node == root
            out.append((r[0], own, tops[k], root, H(*(o for o, _ in way if o is not None)), node, node == root))
    return out


def sorted_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, size int"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS).repartition(4)


@pytest.mark.parametrize("case", ["many", "odd", "one", "null"])
def test_manifest(spark, case):
    if case == "many":  # over two levels of blocks, sparse and dense ids, negative ones
        rows = [(k * k - 5000 if k % 3 else k, f"t{k} é", ("en", "de", "ünt", "zz")[min(3, k % 17 // 5)], None if k % 11 == 0 else "src", k) for k in range(1500)]
    elif case == "odd":  # repeated ids and rows, nulls everywhere
        rows = [(5, "a", "en", "s", 1), (5, "a", "en", "s", 1), (5, "b", "en", "s", 1), (None, "n", "en", None, None), (None, None, "en", None, None), (7, None, None, "x", 3), (-(2**63), "min", "en", "s", 2), (2**63 - 1, "max", "en", "s", 2), (6, "", "", "", 0)]
        rows += [(9, f"copy {k % 7}", "de", "s", k % 3) for k in range(600)] + [(None, "hot", "fr", "s", 1)] * 300 + [(k, "x" * 200_000, "fr", "s", 1) for k in range(3)]
    elif case == "one":
        rows = [(3, "only", "en", "s", 4)]
    else:
        rows = [(None, None, None, None, None)]
    got = sorted_rows(manifest_digest(merkle_manifest(document_leaves(documents(spark, rows)))))
    assert got == sorted(brute(rows), key=str)


def test_empty(spark):
    assert merkle_manifest(document_leaves(documents(spark, [(1, "x", "en", "s", 1)]).where("doc_id < 0"))).count() == 0


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = con.execute(ORACLE_SQL["op13_merkle_manifest"])
    names = [c[0] for c in found.description]
    df = op13_merkle_manifest(spark, sf)
    assert names == df.columns
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in df.collect())
