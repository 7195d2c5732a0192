"""Secret scans with a blob ledger, in DataFrame functions only.

Every version of a text is addressed by the SHA-256 of its content: the history has a row (path, version, blob) for each,
the ledger a row (blob, rule, version, spans) for each blob and rule version that was scanned. A scan looks at the pairs
that the ledger lacks, and findings go back to every path that holds the blob. History, ledger and findings are stored
tables, so a blob that very many paths hold meets them in joins that split.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadspark.llm.common import count_kind, span_text, stored


class Rule(NamedTuple):
    """A match is kept if the characters of `group` (0: the match) number at least `least`."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


# The patterns. The first three are the base rules, in the order in which their spans are listed.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
BASE = ("assign", "access", "hex")
SPAN = "struct<start:int,rank:int,end:int,kind:string>"
PAIR = "struct<rule:string,version:int>"
LEDGER = f"blob binary, rule string, version int, spans array<{SPAN}>"
FEW = 200_000  # up to so many blobs are broadcast to the texts that they are looked for in, some 20 MB


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _pairs(rules: tuple[Rule, ...]) -> Column:
    return F.array(*(F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules))


def history_of(docs: DataFrame, version: Column | int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """path, version, blob: one row per row of docs. Null texts count as empty; null and repeated ids stay as they are."""
    version = F.lit(version) if isinstance(version, int) else version
    return docs.select(F.col(id_col).cast("long").alias("path"), version.cast("int").alias("version"), blob_of(F.coalesce(F.col(text_col), F.lit(""))).alias("blob"))


def _matches(todo: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """todo (blob, text, seen) -> a row for each unseen pair, with gaps and matches by their lengths alone."""
    scans = []
    for k, r in enumerate(rules):
        pattern = F.lit(r.pattern)
        text = F.col("text")
        gaps = F.transform(F.split(text, r.pattern, -1), F.char_length)
        hits = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.char_length)
        kept = F.transform(F.regexp_extract_all(text, pattern, F.lit(r.group)), lambda v: F.char_length(v) >= r.least)  # noqa: B023
        parts = F.when(text.rlike(r.pattern), F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), kept.alias("kept")))
        scan = F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), F.lit(k).alias("rank"), parts.alias("parts"))
        scans.append(F.when(~F.array_contains("seen", F.struct(scan["rule"].alias("rule"), scan["version"].alias("version"))), scan))
    return todo.select("blob", F.explode(F.filter(F.array(*scans), lambda s: s.isNotNull())).alias("s")).select("blob", "s.*")


def scan_blobs(blobs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text) -> new ledger rows (blob, rule, version, spans) for the pairs that the ledger lacks.

    A match's place is the running sum of what stands before it, taken over rows, so that a text with very many matches
    costs no more a match than others.
    """
    none = F.array().cast(f"array<{PAIR}>")
    if ledger is None:
        todo = blobs.withColumn("seen", none)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", F.col("version").cast("int").alias("version"))).alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", none)).where(F.size(F.array_except(_pairs(rules), F.col("seen"))) > 0)
    scanned = _matches(todo.withColumn("text", F.coalesce("text", F.lit(""))), rules)
    each = scanned.select("blob", "rule", "version", "rank", F.posexplode_outer("parts").alias("at", "part"))
    upto = Window.partitionBy("blob", "rule", "version").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("part.gap") + F.coalesce(F.col("part.hit"), F.lit(0))).over(upto).cast("int")
    span = F.when(F.col("part.kept"), F.struct((F.col("end") - F.col("part.hit")).alias("start"), "rank", "end", F.col("rule").alias("kind")))
    found = each.withColumn("end", end).select("blob", "rule", "version", span.alias("span"))
    return found.groupBy("blob", "rule", "version").agg(F.array_sort(F.collect_list("span")).alias("spans")).select("blob", "rule", "version", F.col("spans").cast(f"array<{SPAN}>").alias("spans"))


def unseen_blobs(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """blob: the distinct blobs of docs that the ledger lacks for some rule version. Texts are hashed where they are read and stay there."""
    known = ledger.where(F.array_contains(_pairs(rules), F.struct("rule", F.col("version").cast("int").alias("version"))))
    complete = known.groupBy("blob").agg(F.count_distinct("rule").alias("n")).where(F.col("n") == len(rules)).select("blob")
    return docs.select(blob_of(F.coalesce(F.col(text_col), F.lit(""))).alias("blob")).distinct().join(complete, "blob", "left_anti")


def scan_new(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """New ledger rows for the texts of docs: each unseen blob is scanned once, whatever the number of rows that hold it.

    With a ledger, hashes alone are compared with it first; only texts of unseen blobs leave the task that reads them. Up to FEW
    unseen blobs are broadcast to the texts; where more are new, texts meet them by the shuffle that makes them distinct.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", blob_of(F.col("text")))
    if ledger is not None:
        unseen = stored(unseen_blobs(docs, ledger, rules, text_col), "unseen")
        texts = texts.join(F.broadcast(unseen) if unseen.count() <= FEW else unseen, "blob", "left_semi")
    return scan_blobs(texts.dropDuplicates(["blob"]), ledger, rules)


def hits_of(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of the blobs with findings by the given rule versions; spans by start and rule."""
    known = ledger.where(F.array_contains(_pairs(rules), F.struct("rule", F.col("version").cast("int").alias("version"))) & (F.size("spans") > 0))
    return known.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def findings(history: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """history with the spans of each row's blob, empty where there are none. Store history and ledger first."""
    return history.join(stored(hits_of(ledger, rules), "hits"), "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))


def scan_secrets(deliveries: list[DataFrame], ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, ledger) after the deliveries, one after the other. Findings: path, version, blob, spans(start, rank, end, kind).

    Delivery k is version k of its paths; a blob that the ledger or a delivery before it holds isn't scanned again.
    Findings have one row per row of all deliveries. Offsets are code points, the end is exclusive; spans go by start,
    then by rule. Null texts count as empty; null or repeated ids stay as they are; no other column is read; empty tables
    give empty tables. The ledger returned holds the old rows and the new ones; the next scan starts from it.
    """
    history = None
    for k, docs in enumerate(deliveries):
        new = stored(scan_new(docs, ledger, rules, text_col), "ledger")
        ledger = new if ledger is None else ledger.unionByName(new)
        own = history_of(docs, k + 1, id_col, text_col)
        history = own if history is None else history.unionByName(own)
    return findings(stored(history, "history"), ledger, rules), ledger


def _gaps(hits: DataFrame) -> DataFrame:
    """(blob, gaps): what lies outside all spans, as (start, end) with end null for the rest of the text."""
    each = hits.select("blob", F.explode("spans").alias("s")).select("blob", "s.start", "s.end")
    before = Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = each.withColumn("done", F.coalesce(F.max("end").over(before), F.lit(0)))
    inner = fresh.where((F.col("start") > F.col("done")) | (F.col("done") == 0)).select("blob", F.struct(F.col("done").alias("start"), F.col("start").alias("end")).alias("gap"))
    last = each.groupBy("blob").agg(F.max("end").alias("start")).select("blob", F.struct("start", F.lit(None).cast("int").alias("end")).alias("gap"))
    return inner.unionAll(last).groupBy("blob").agg(F.array_sort(F.collect_list("gap")).alias("gaps"))


def redact(text: Column, gaps: Column, mark: str = "[secret]") -> Column:
    """The text's gaps joined by marks. Cut from four bytes a character, so each piece is found at once."""
    wide = F.array(F.encode(text, "UTF-32"))
    piece = lambda b, g: F.decode(F.substring(b, 4 * g["start"] + 1, F.coalesce(4 * (g["end"] - g["start"]), F.octet_length(b))), "UTF-32")
    return F.get(F.transform(wide, lambda b: F.array_join(F.transform(gaps, lambda g: piece(b, g)), mark)), F.lit(0))


def mask_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with the secrets in their texts masked (and length_col, if there, set anew for those); other rows as they are.

    Overlapping and touching secrets share one mark. Null and empty texts stay; repeated rows are masked alike. The texts
    shuffle once, to be scanned; blobs with findings are then broadcast if they and their gaps number at most FEW * 10, some
    60 MB; beyond that texts meet them by a shuffle.
    """
    new = stored(scan_new(docs, ledger, rules, text_col), "ledger")
    gaps = stored(_gaps(hits_of(new if ledger is None else ledger.unionByName(new), rules)).select(F.col("blob").alias("__blob"), F.col("gaps").alias("__gaps")), "gaps")
    rows = docs.withColumn("__blob", F.when(F.col(text_col).isNotNull(), blob_of(F.col(text_col))))
    size = gaps.agg(F.coalesce(F.sum(F.size("__gaps") + 4), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(gaps) if size <= 10 * FEW else gaps, "__blob", "left")
    clean = F.col("__gaps").isNull()
    masked = joined.withColumn(text_col, F.when(clean, F.col(text_col)).otherwise(redact(F.col(text_col), F.col("__gaps"))))
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        masked = masked.withColumn(length_col, F.when(clean, F.col(length_col)).otherwise(F.char_length(text_col).cast(kind)))
    return masked.select(*docs.columns)


def secret_digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        F.col("path").alias("doc_id"),
        *(count_kind(F.col("spans"), k).alias(f"n_{k}") for k in BASE),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
