"""The queries of the numbered operators: (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadspark.llm.ngram_join import ngram_components

    return ngram_components(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadspark.llm.sentencepiece_codec import codec_digest, encode_decode

    return codec_digest(encode_decode(_documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model")))


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries, the English texts and then all others; the second scans only what the first one's ledger lacks."""
    from pyspark.sql import functions as F

    from roadspark.llm.secrets import scan_secrets, secret_digest

    docs = _documents(spark, sf_dir)
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    return secret_digest(scan_secrets([docs.where(english), docs.where(~english)])[0])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadspark.llm.toxicity import fit, score_toxicity, toxicity_digest

    docs = _documents(spark, sf_dir)
    return toxicity_digest(score_toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadspark.llm.packing import pack_documents

    return pack_documents(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), 2048)


def op6_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, played; those of conversations with an id divisible by 20 are searched for by an excerpt."""
    from pyspark.sql import functions as F

    from roadspark.llm.common import stored
    from roadspark.llm.media import fingerprint_played, search_report

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    wide = (turns.agg(F.max("turn")).first()[0] or 0) + 1
    played = turns.withColumn("rec_id", F.col("conv_id") * wide + F.col("turn"))
    conv = F.floor(F.col("rec_id") / wide)
    prints = stored(fingerprint_played(played, "rec_id", "text", F.col("conv_id") % 20 == 0), "prints")
    queries = prints.where("sample IS NOT NULL").select("rec_id", F.col("sample").alias("codes"))
    return search_report(prints.select("rec_id", "codes"), queries, spent=prints).select(conv.alias("conv_id"), (F.col("rec_id") - conv * wide).alias("turn"), "*")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadspark.llm.pii import find_pii, pii_digest

    return pii_digest(find_pii(_documents(spark, sf_dir)))


def op8_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadspark.llm.lz_fingerprint import fingerprint_digest, fingerprint_with_next

    return fingerprint_digest(fingerprint_with_next(_documents(spark, sf_dir)))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadspark.llm.token_counts import count_tokens

    return count_tokens(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from roadspark.llm.chat import chat_digest, format_windows, read_windows

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat_digest(read_windows(format_windows(turns.unionByName(extra))))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadspark.llm.periodic_runs import periodic_runs, replanted, runs_digest

    return runs_digest(periodic_runs(replanted(_documents(spark, sf_dir))))


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadspark.llm.hamming_index import nearest_vectors

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_vectors(vectors, vectors.where("vec_id % 50 = 0"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadspark.llm.merkle import document_leaves, manifest_digest, merkle_manifest

    return manifest_digest(merkle_manifest(document_leaves(_documents(spark, sf_dir))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scans, op2_ngram_jaccard, op3_sentencepiece, op4_toxicity, op5_best_fit_packing, op6_media_fingerprints, op7_pii, op8_lz_fingerprints, op9_token_counts, op10_chat_formatting, op11_periodic_runs, op12_nearest_vectors, op13_merkle_manifest)
}

#: op2: exploded sets, pair counts and a recursive walk over the links. op13: levels by recursion, the CRC bit by bit. The others
#: have spans with offsets, trained scores, tokenizers, templates, runs or approximate answers; tests hold them against
#: libraries, brute force and round trips.
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS g FROM w),
    m AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
    p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM m a JOIN m b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
    e AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
    r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON r.doc_id = e.u),
    least_of AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
    SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM s JOIN least_of USING (doc_id)""",
    "op13_merkle_manifest": r"""WITH RECURSIVE d AS (SELECT *, (xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, v: xor(xor(c, v) >> 1, (xor(c, v) & 1) * 3988292384)), 4294967295::UBIGINT) % 7 = 0) IS TRUE AS hit FROM documents),
    e AS (SELECT doc_id, lang, hit, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a, coalesce(strlen(text) || ':' || text, '-') AS z FROM d),
    l AS (SELECT *, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf, sha256(a || coalesce(strlen((n_chars + hit::INT)::VARCHAR) || ':' || (n_chars + hit::INT), '-') || z) AS claimed FROM e),
    g AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS t FROM (SELECT DISTINCT lang FROM l)),
    p AS (SELECT l.*, t, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS k FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang),
    n(t, lvl, pos, h, size) AS (SELECT t, 0, pos, leaf, count(*) OVER (PARTITION BY t) FROM p
        UNION ALL SELECT t, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(size) + 1) // 2 FROM n WHERE size > 1 GROUP BY t, lvl, pos // 2),
    s AS (SELECT t, lvl AS height, h AS subroot FROM n WHERE size = 1),
    u(lvl, pos, h, size) AS (SELECT 0, t, subroot, count(*) OVER () FROM s
        UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(size) + 1) // 2 FROM u WHERE size > 1 GROUP BY lvl, pos // 2),
    steps AS (SELECT k, n.lvl, n.h, n.pos < p.pos >> n.lvl AS is_left FROM p JOIN n ON n.t = p.t AND n.pos = xor(p.pos >> n.lvl, 1)
        UNION ALL SELECT k, height + u.lvl, u.h, u.pos < p.t >> u.lvl FROM p JOIN s ON s.t = p.t JOIN u ON u.pos = xor(p.t >> u.lvl, 1)),
    f(k, lvl, h) AS (SELECT k, 0, claimed FROM p
        UNION ALL SELECT f.k, f.lvl + 1, sha256(CASE WHEN steps.is_left THEN steps.h || f.h ELSE f.h || coalesce(steps.h, '') END) FROM f JOIN p ON p.k = f.k JOIN s ON s.t = p.t LEFT JOIN steps ON steps.k = f.k AND steps.lvl = f.lvl WHERE f.lvl < height + (SELECT max(lvl) FROM u)),
    proofs AS (SELECT k, sha256(string_agg(h, '' ORDER BY lvl)) AS proof_sha256 FROM steps GROUP BY k)
    SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
    FROM p JOIN s ON s.t = p.t JOIN (SELECT h AS root, lvl AS top FROM u WHERE size = 1) ON true JOIN f ON f.k = p.k AND f.lvl = height + top LEFT JOIN proofs ON proofs.k = p.k""",
}
