"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A log holds events of conversations: ``delta`` appends to a turn, ``edit`` replaces its text,
``regenerate`` empties it and voids what later turns held until then.  Logs are partitioned by
conversation, sorted by sequence, folded into final messages and rendered with one template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import column

#: Fixed values of the template.
START, END, ASSISTANT = "<|im_start|>", "<|im_end|>\n", "assistant"


def escape(text: Column) -> Column:
    """No control string survives: ``\\`` becomes ``\\b``, ``<|`` becomes ``<\\p``.  Reversible."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\b"), F.lit("\\"))


def fold_events(events: DataFrame, conv: str = "conv_id", row_turns: bool = False) -> DataFrame:
    """``events(conv, seq, turn, role, op, text)`` -> one row per surviving turn: conv, turn, role, text.

    With ``row_turns`` the log is a table of whole messages: every row is a turn of its own, in the order of turn, seq, role and
    text, so that messages which share a turn number, or have none, stay apart.

    Events of equal sequence number apply in the order of their op, role and text.  Null texts are
    empty, a null op is ``delta``, a null seq or turn counts as the smallest.  The last
    non-null role of a turn is its role, or the empty string.  Repeated rows are repeated events.
    """
    low = F.lit(-(2**62))
    e = events.select(column(conv).alias("conv"), F.coalesce(F.col("turn").cast("bigint"), low).alias("turn"), F.coalesce(F.col("seq").cast("bigint"), low).alias("seq"), F.coalesce("op", F.lit("delta")).alias("op"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    e = e.repartition("conv")
    if row_turns:
        e = e.withColumn("turn", F.row_number().over(Window.partitionBy("conv").orderBy("turn", "seq", F.coalesce("role", F.lit("")), "text")).cast("bigint"))
    cut = Window.partitionBy("conv").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("conv", "turn")
    at = F.struct("seq", F.when(F.col("op") == "regenerate", 0).when(F.col("op") == "edit", 1).otherwise(2).alias("k"), F.coalesce("role", F.lit("")).alias("r"), F.col("text").alias("t"))
    e = e.withColumn("at", at).withColumn("void", F.max(F.when(F.col("op") == "regenerate", F.col("seq"))).over(cut)).where("void is null or seq > void")
    # A turn keeps its role through resets, so it is taken from all events of the turn.
    e = e.withColumn("last_role", F.max_by("role", F.when(F.col("role").isNotNull(), F.col("at"))).over(own))
    e = e.withColumn("reset", F.max(F.when(F.col("op") != "delta", F.col("at"))).over(own)).where("reset is null or at >= reset")
    turns = e.groupBy("conv", "turn").agg(F.array_sort(F.collect_list("at")).alias("log"), F.first("last_role").alias("role"))
    body = F.array_join(F.transform(F.filter("log", lambda x: x["k"] != 0), lambda x: x["t"]), "")
    return turns.select(F.col("conv").alias(conv), "turn", F.coalesce("role", F.lit("")).alias("role"), body.alias("text"))


def render(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``messages(conv, turn, role, text)`` -> conv, formatted, loss_spans.

    ``loss_spans`` has an entry for each turn in order: (start, end) in code points of ``formatted``
    around an assistant's escaped text, null for other roles.  Rows with equal turn are ordered by
    role and text.  Null roles and texts are empty; an empty input gives no rows.
    """
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\l"))
    m = messages.select(column(conv).alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), role.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    m = m.withColumn("piece", F.concat(F.lit(START), "head", F.lit("\n"), "body", F.lit(END)))
    order = Window.partitionBy("conv").orderBy("turn", "role", "body")
    before = F.coalesce(F.sum(F.length("piece").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m = m.withColumn("n", F.row_number().over(order)).withColumn("from", before + len(START) + F.length("head") + 1)
    span = F.when(F.col("role") == ASSISTANT, F.struct(F.col("from").alias("start"), (F.col("from") + F.length("body")).alias("end")))
    listed = m.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("n", "piece", span.alias("span")))).alias("all"))
    return listed.select(F.col("conv").alias(conv), F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"), F.transform("all", lambda x: x["span"]).alias("loss_spans"))


def format_conversations(events: DataFrame, conv: str = "conv_id", row_turns: bool = False) -> DataFrame:
    """Fold, then render."""
    return render(fold_events(events, conv, row_turns), conv)


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Parse formatted conversations again: conv, turn number, role, text, and the text under the loss mask (or null)."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    parts = F.arrays_zip(F.slice(pieces, 1, F.size(pieces) - 1).alias("piece"), F.col("loss_spans").alias("span"))
    x = formatted.select(column(conv).alias("conv"), F.posexplode(parts).alias("n", "x")).select("conv", "n", "x.piece", "x.span")
    order = Window.partitionBy("conv").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("from", F.coalesce(F.sum(F.length("piece").cast("bigint") + len(END)).over(order), F.lit(0)))
    inner = F.substring("piece", len(START) + 1, F.length("piece"))
    role = F.substring_index(inner, "\n", 1)
    text = F.expr(f"substring(piece, {len(START)} + length(substring_index(substring(piece, {len(START)} + 1), '\n', 1)) + 2)")
    masked = F.expr("substring(piece, cast(span.start - `from` as int) + 1, cast(span.end - span.start as int))")
    return x.select(F.col("conv").alias(conv), "n", unescape(F.replace(role, F.lit("\\l"), F.lit("\n"))).alias("role"), unescape(text).alias("text"), unescape(masked).alias("loss_text"))
