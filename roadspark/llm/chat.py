"""Chat formatting in budgeted windows, in DataFrame functions only.

A conversation's turns carry prefix sums of their token costs. Windows are spans of whole turns chosen by those sums:
each takes the turns that fit the budget besides the system turns, which every window repeats, and a limited history
of turns before the span. Only the assistant texts of the span itself are targets; repeated ones are masked.

Format of a turn: <turn:ROLE>TEXT</turn>, or <past:ROLE>TEXT</turn> if it is repeated from before. In ROLE and TEXT
"\\" is written "\\0", "<" "\\1" and ">" "\\2", so no text can hold a mark, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\0")), F.lit("<"), F.lit("\\1")), F.lit(">"), F.lit("\\2"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\2"), F.lit(">")), F.lit("\\1"), F.lit("<")), F.lit("\\0"), F.lit("\\"))


def token_cost(text: Column) -> Column:
    """A fixed stand-in for a turn's tokens: a quarter of its UTF-8 bytes, and four for its marks."""
    return (F.octet_length(text) / 4).cast("long") + 4


def format_windows(turns: DataFrame, budget: int = 512, history: int = 128, system_role: str = "system", target_role: str = "assistant") -> DataFrame:
    """conv_id, window, formatted, loss(start, end), tokens, over_budget: a row per window.

    turns: conv_id, turn, role, text. Null texts and roles are empty; turns go by turn, then role and text (null turns
    first); equal rows stay. The first turns of system_role are kept whole in every window. A turn that is larger than
    the budget gets a window of its own with over_budget; no turn is cut. loss has code-point spans (end exclusive) of
    formatted. Null conv_ids are one conversation; an empty table gives an empty table; no other column is read.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), escape(text).alias("body"), token_cost(escape(text)).alias("cost")).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # the system turns that lead the conversation, then the prefix sum before each of the others
    lead = F.aggregate("turns", F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, t: F.struct((s["n"] + (s["on"] & (t["role"] == system_role)).cast("int")).alias("n"), (s["on"] & (t["role"] == system_role)).alias("on")), lambda s: s["n"])
    split = whole.withColumn("lead", lead).select("conv_id", F.slice("turns", 1, F.col("lead")).alias("system"), F.expr("slice(turns, lead + 1, size(turns))").alias("rest"))
    split = split.withColumn("room", F.lit(budget) - F.aggregate("system", F.lit(0).cast("long"), lambda a, t: a + t["cost"]))
    sums = F.aggregate(
        "rest",
        F.struct(F.lit(0).cast("long").alias("sum"), F.array(F.lit(0).cast("long")).alias("sums")),
        lambda s, t: F.struct((s["sum"] + t["cost"]).alias("sum"), F.concat(s["sums"], F.array(s["sum"] + t["cost"])).alias("sums")),
        lambda s: s["sums"],
    )
    split = split.withColumn("sums", sums)
    # a span ends before the turn whose prefix sum leaves the room that its own history leaves
    past_cost = lambda a: F.least(F.lit(history).cast("long"), F.get("sums", a))
    starts = F.aggregate(
        F.expr("sequence(1, size(sums) - 1)"),
        F.struct(F.lit(0).alias("from"), F.array(F.lit(0)).alias("starts")),
        lambda s, k: F.when(
            (F.get("sums", k) - F.get("sums", s["from"]) + past_cost(s["from"]) > F.col("room")) & (k - 1 > s["from"]),
            F.struct((k - 1).alias("from"), F.concat(s["starts"], F.array(k - 1)).alias("starts")),
        ).otherwise(s),
        lambda s: s["starts"],
    )
    split = split.withColumn("starts", F.when(F.size("rest") > 0, starts).otherwise(F.array(F.lit(0))))
    windows = F.transform(
        "starts",
        lambda a, w: F.struct(
            w.alias("window"),
            F.when(w > 0, F.lit("past")).otherwise(F.lit("turn")).alias("system_mark"),
            F.filter(F.sequence(F.greatest(a - history, F.lit(0)), a), lambda j: (j < a) & (F.get("sums", a) - F.get("sums", j) <= history)).alias("past"),
            a.alias("from"),
            F.coalesce(F.get("starts", w + 1), F.size("rest")).alias("to"),
        ),
    )
    cut = split.select("conv_id", "system", "rest", "sums", "room", F.explode(windows).alias("w"))
    mark = lambda what, t: F.struct(F.lit(what).alias("mark") if isinstance(what, str) else what.alias("mark"), t["role"].alias("role"), t["body"].alias("body"))
    chosen = F.concat(
        F.transform("system", lambda t: mark(F.col("w.system_mark"), t)),
        F.transform("w.past", lambda j: mark("past", F.get("rest", j))),
        F.transform(F.expr("slice(rest, w.from + 1, w.to - w.from)"), lambda t: mark("turn", t)),
    )
    placed = cut.withColumn("chosen", chosen)
    head = lambda t: F.concat(F.lit("<"), t["mark"], F.lit(":"), escape(t["role"]), F.lit(">"))
    written = placed.withColumn("pieces", F.transform("chosen", lambda t: F.struct(head(t).alias("head"), t["body"].alias("body"), ((t["mark"] == "turn") & (t["role"] == target_role)).alias("target"))))
    loss = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss")),
        lambda s, p: F.struct(
            (s["at"] + F.char_length(p["head"]) + F.char_length(p["body"]) + 7).alias("at"),
            F.when(p["target"], F.concat(s["loss"], F.array(F.struct((s["at"] + F.char_length(p["head"])).alias("start"), (s["at"] + F.char_length(p["head"]) + F.char_length(p["body"])).alias("end"))))).otherwise(s["loss"]).alias("loss"),
        ),
        lambda s: s["loss"],
    )
    used = F.lit(budget) - F.col("room") + F.get("sums", F.col("w.to")) - F.get("sums", F.coalesce(F.get("w.past", F.lit(0)), F.col("w.from")))
    return written.select(
        "conv_id",
        F.col("w.window").alias("window"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("</turn>"))), "").alias("formatted"),
        loss.alias("loss"),
        used.alias("tokens"),
        (used > budget).alias("over_budget"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """conv_id, turns(role, text) in order without repeats, loss_text, formatted_chars: read back from the output alone."""
    pattern = F.lit("<turn:([^<>]*)>([^<>]*)</turn>")
    texts = F.transform(F.col("loss"), lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))
    parts = windows.select(
        "conv_id",
        F.struct(
            "window",
            F.regexp_extract_all("formatted", pattern, F.lit(1)).alias("roles"),
            F.regexp_extract_all("formatted", pattern, F.lit(2)).alias("bodies"),
            F.array_join(texts, "").alias("loss"),
            F.char_length("formatted").cast("long").alias("chars"),
        ).alias("w"),
    )
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("w"), lambda a, b: (a["window"] - b["window"]).cast("int")).alias("ws"))
    both = F.arrays_zip(F.flatten("ws.roles").alias("role"), F.flatten("ws.bodies").alias("text"))
    return whole.select(
        "conv_id",
        F.transform(both, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))).alias("turns"),
        unescape(F.array_join("ws.loss", "")).alias("loss_text"),
        F.aggregate("ws.chars", F.lit(0).cast("long"), lambda a, c: a + c).alias("formatted_chars"),
    )


def chat_digest(read: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
