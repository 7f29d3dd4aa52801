"""Secret scan with multipart credential linking, in DataFrame operations only.

Strong patterns (``assign``, ``access``, ``hex``) are reported as found.  Weak parts, which alone
prove nothing, are reported only if complementary parts lie within the same scope: an
identifier needs a secret, a secret an identifier, an endpoint both.  Parts are linked by an interval
join on scope-sized cells, so that no document forms all pairs: parts of one kind do not overlap,
hence few fit a scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bloom import with_maybe
from .names import column, columns, fresh
from .storage import Scratch

#: Kind, pattern, group whose length counts, least length.  Kinds rank in this order.
STRONG = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
#: Weak parts; a weak secret must also mix digits with letters in both cases.
WEAK = [
    ("weak_id", r"""(?i:access_?key_?id|client_?id|account_?id|user_?name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}""", 0, 4),
    ("weak_secret", r"[A-Za-z0-9+/_-]{20,}", 0, 20),
    ("endpoint", r"""(?:https?|ftp|ssh|postgresql|mysql|mongodb|redis|amqp)://[^\x09-\x0D\x20"'<>]+""", 0, 8),
]
#: What a weak secret must contain, each.
WEAK_SECRET_NEEDS = ["[0-9]", "[A-Z]", "[a-z]"]
KINDS = [k for k, *_ in STRONG + WEAK]
#: Code points within which parts complement each other.
SCOPE = 256
#: What stands for a secret in a redacted text.
MASK = "[SECRET]"


def _cuts(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (kind rank, code points before the match since the last, of the match, whether it counts)."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    ok = lambda x: F.length(x) >= least
    if kind == "weak_secret":
        ok = lambda x: (F.length(x) >= least) & x.rlike(WEAK_SECRET_NEEDS[0]) & x.rlike(WEAK_SECRET_NEEDS[1]) & x.rlike(WEAK_SECRET_NEEDS[2])
    zipped = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(whole, F.length).alias("len"), F.transform(judged, ok).alias("ok"))
    made = F.transform(zipped, lambda z: F.struct(F.lit(KINDS.index(kind)).alias("rank"), z["gap"].alias("gap"), z["len"].alias("len"), z["ok"].alias("ok")))
    return F.when(text.rlike(pattern), F.filter(made, lambda z: z["len"].isNotNull()))


def find_spans(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``: rows(uid, doc_id, text_key) has one row per input row, spans(uid, rank, s, e) the spans to
    report, in code points with exclusive end.

    A null text is empty and has no spans; repeated rows are scanned each for itself; an empty
    table gives empty results; other columns are not read, whatever their names.  Whole texts are scanned.
    """
    body = F.coalesce(F.col("_text"), F.lit(""))
    source = docs.select(column(doc_id).alias("doc_id"), column(text).alias("_text"))
    cuts = F.filter(F.array(*[_cuts(body, *p) for p in STRONG + WEAK]), lambda a: a.isNotNull())
    rows = scratch.put(source.select("doc_id", F.monotonically_increasing_id().alias("uid"), F.md5(body.cast("binary")).alias("text_key"), F.flatten(cuts).alias("cuts")), "cuts")
    every = rows.where("size(cuts) > 0").select("uid", F.posexplode("cuts").alias("pos", "cut")).select("uid", "pos", "cut.*")
    before = Window.partitionBy("uid", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = every.select("uid", "rank", "ok", "len", F.sum(F.col("gap") + F.col("len")).over(before).alias("e")).where("ok")
    spans = placed.select("uid", "rank", (F.col("e") - F.col("len")).cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"))
    spans = scratch.put(spans, "parts")
    strong, weak = spans.where(F.col("rank") < len(STRONG)), spans.where(F.col("rank") >= len(STRONG))

    # The role of a part: identifier or secret.  Every cell of scope size gets the parts that touch it.
    rank = {k: KINDS.index(k) for k in KINDS}
    role = F.when(F.col("rank").isin(rank["access"], rank["weak_id"]), F.lit("i")).when(F.col("rank") != rank["endpoint"], F.lit("s"))
    cell = lambda c: F.floor(c / scope).cast("bigint")
    near = spans.select("uid", role.alias("role"), F.col("s").alias("s2"), F.col("e").alias("e2")).where("role is not null").withColumn("cell", F.explode(F.sequence(cell(F.col("s2")), cell(F.col("e2") - 1))))
    seek = weak.withColumn("cell", F.explode(F.sequence(F.greatest(cell(F.col("s") - scope), F.lit(0)), cell(F.col("e") - 1 + scope))))
    # Non-overlapping parts that end or begin at most `scope` away.
    apart = ((F.col("s2") >= F.col("e")) & (F.col("s2") - F.col("e") <= scope)) | ((F.col("e2") <= F.col("s")) & (F.col("s") - F.col("e2") <= scope))
    met = seek.join(near, ["uid", "cell"]).where(apart).groupBy("uid", "rank", "s", "e").agg(F.max(F.col("role") == "i").alias("has_id"), F.max(F.col("role") == "s").alias("has_secret"))
    linked = met.where(F.when(F.col("rank") == rank["weak_id"], F.col("has_secret")).when(F.col("rank") == rank["weak_secret"], F.col("has_id")).otherwise(F.col("has_id") & F.col("has_secret")))
    # A weak part inside a strong span says nothing new.
    inside = linked.withColumn("cell", F.explode(F.sequence(cell(F.col("s")), cell(F.col("e") - 1)))).join(strong.select("uid", F.col("s").alias("s2"), F.col("e").alias("e2")).withColumn("cell", F.explode(F.sequence(cell(F.col("s2")), cell(F.col("e2") - 1)))), ["uid", "cell"]).where("s < e2 and s2 < e").select("uid", "rank", "s", "e").distinct()
    return rows.select("uid", "doc_id", "text_key"), strong.unionByName(linked.select("uid", "rank", "s", "e").join(inside, ["uid", "rank", "s", "e"], "left_anti"))


def scan_secrets(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: doc_id and ``found``, an array of (s, rank, e) in reading order; see :func:`find_spans`."""
    rows, spans = find_spans(docs, scratch, doc_id, text, scope)
    per = spans.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("s", "rank", "e"))).alias("found"))
    return rows.join(per, "uid", "left").select("doc_id", F.coalesce("found", F.array().cast("array<struct<s:bigint,rank:int,e:bigint>>")).alias("found"))


def spell(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``MASK``; texts without one stay as they are.

    Overlapping spans are masked once.  Only documents with spans meet their spans, by doc_id and the
    text's digest, so that repeated rows are all masked.  Other columns pass as they are, whatever their names.
    """
    rows, spans = find_spans(docs, scratch, doc_id, text, scope)
    order = Window.partitionBy("uid").orderBy("s", "e")
    earlier = spans.withColumn("reach", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    runs = earlier.withColumn("run", F.sum(F.when(F.col("s") < F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    maybe, id_, key, cuts = fresh(docs.columns, "_maybe", "_id", "_key", "_cuts")
    merged = runs.groupBy("uid", "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias(cuts))
    keyed = scratch.put(merged.join(rows, "uid").select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), cuts).dropDuplicates([id_, key]), "runs")
    t = column(text)
    flagged = with_maybe(docs, column(doc_id), keyed.select(id_), maybe)
    clean = flagged.where(~F.col(maybe)).select(*columns(docs))
    held = flagged.where(maybe).join(keyed, column(doc_id).eqNullSafe(F.col(id_)) & (F.md5(F.coalesce(t, F.lit("")).cast("binary")) == F.col(key)), "left")
    at = F.col(cuts)
    parts = F.transform(at, lambda x, i: F.concat(F.substring(t, F.when(i == 0, 0).otherwise(F.get(at, i - 1)["e"]).cast("int") + 1, (x["s"] - F.when(i == 0, 0).otherwise(F.get(at, i - 1)["e"])).cast("int")), F.lit(MASK)))
    masked = F.concat(F.array_join(parts, ""), F.substring(t, F.element_at(at, -1)["e"].cast("int") + 1, F.length(t)))
    return clean.union(held.select(*[F.when(at.isNull(), t).otherwise(masked).alias(text) if c == text else column(c) for c in docs.columns]))
