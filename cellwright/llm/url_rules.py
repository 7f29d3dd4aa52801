"""URL filtering by fixed host/path rules and by association rules mined from labels.

FP-growth finds combinations of URL tokens that labelled pages share; a rule ``tokens -> bad``
is kept if its support and confidence reach their thresholds, and if no rule on fewer of these
tokens is as confident.  Rules match by an inverted index: each is filed under its rarest token.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import column
from .storage import Scratch

#: Fixed values: (verdict, host, path), in the order they are given.
HOST_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
BAD = "\x00bad"
#: Mining parameters.  Support is relative to the labelled pages, so a frequent combination is
#: never rare at scale; confidence is the share of bad labels among the pages that match.
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.6
#: A rule list is broadcast only up to this length; a longer one is joined by shuffle.
BROADCAST_RULES = 10_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; only A-Z lower-cased; '' without one."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = HOST_RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits host and path, or null.

    A rule fits its host and all subdomains if the path starts with the rule's.  Of rules of equal length the first wins.
    """
    picked = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))
        picked = F.when(fits, out) if picked is None else picked.when(fits, out)
    return picked


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels, path segments with digits folded, query keys and values."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    fold = lambda a: F.transform(a, lambda x: F.regexp_replace(x, r"[0-9]+", "9"))
    named = lambda tag, a: F.transform(F.filter(a, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    scheme = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    return F.array_distinct(F.concat(named("s:", F.array(scheme)), named("h:", F.split(host, r"\.")), named("p:", fold(F.split(path, r"[/._-]+"))), named("q:", F.split(query, "&"))))


def mine_rules(tokens: DataFrame, scratch: Scratch, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``tokens(tokens, bad)`` of labelled pages -> rules(parts, anchor, confidence, support).

    A rule matches a URL that has a token of each of its ``parts``.  Tokens that occur in the very same labelled pages are one item while rules are mined: a
    combination of several of them says no more than one does, and forty parameters that always come together would have 2^40 combinations.  Only tokens on
    enough bad pages are mined.  ``anchor`` is the rarest part.  No labelled pages give no rules.
    """
    pages = scratch.put(tokens.where("size(tokens) > 0").select(F.monotonically_increasing_id().alias("uid"), F.array_distinct("tokens").alias("tokens"), F.coalesce("bad", F.lit(False)).alias("bad")), "labelled")
    n = pages.count()
    least = max(1, math.ceil(min_support * n))
    each = pages.select("uid", "bad", F.explode("tokens").alias("token"))
    # Two sums of 64-bit hashes tell sets of pages apart.
    where = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("hits"), F.bit_xor(F.xxhash64("uid")).alias("p"), F.bit_xor(F.xxhash64("uid", F.lit(1))).alias("q")).where(F.col("hits") >= least)
    groups = scratch.put(where.groupBy("n", "p", "q").agg(F.array_sort(F.collect_list("token")).alias("part")).select(F.col("part")[0].alias("item"), "part", "n"), "groups")
    items = each.join(groups.select(F.explode("part").alias("token"), "item"), "token").groupBy("uid").agg(F.collect_set("item").alias("items"), F.max("bad").alias("bad"))
    baskets = scratch.put(items.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")), "baskets")
    # The support is counted in all labelled pages, also those without any frequent token; half a page less, against rounding.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, baskets.count())), minConfidence=min_confidence).fit(baskets)
    # With and without BAD side by side, so that the combinations are mined once.
    bad = F.array_contains("items", BAD)
    sets = model.freqItemsets.groupBy(F.array_sort(F.array_remove("items", BAD)).alias("rule")).agg(F.max(F.when(bad, F.col("freq"))).alias("hits"), F.max(F.when(~bad, F.col("freq"))).alias("seen"))
    sets = sets.where("hits is not null and size(rule) > 0").select("rule", "hits", (F.col("hits") / F.col("seen")).alias("confidence"))
    sets = scratch.put(sets, "sets")
    longest = sets.where(F.col("confidence") >= min_confidence).agg(F.max(F.size("rule"))).first()[0] or 0
    pruned = _irredundant(sets, longest, scratch).where(F.col("confidence") >= min_confidence).select("rule", "confidence", (F.col("hits") / max(1, n)).alias("support"))
    parts = pruned.withColumn("item", F.explode("rule")).join(groups, "item")
    rules = scratch.put(parts.groupBy("rule", "confidence", "support").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.min(F.struct("n", "part"))["part"].alias("anchor")).drop("rule"), "rules")
    scratch.drop(pages, groups, baskets, sets)
    return rules


def _irredundant(sets: DataFrame, longest: int, scratch: Scratch) -> DataFrame:
    """Sets of at most ``longest`` tokens that are more confident than every proper subset.

    All subsets of a frequent set are in ``sets``, so each size takes the best confidence below it from the size
    before: a set of n tokens looks up n sets, however large n is.
    """
    level = sets.where("size(rule) = 1").withColumn("below", F.lit(None).cast("double"))
    out = level
    for size in range(2, longest + 1):
        best = level.select(F.col("rule").alias("part"), F.greatest("confidence", "below").alias("best"))
        parts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.filter("rule", lambda x, i: i != k))
        below = sets.where(F.size("rule") == size).select("*", F.explode(parts).alias("part")).join(best, "part")
        level = scratch.put(below.groupBy("rule", "hits", "confidence").agg(F.max("best").alias("below")), "level")
        out = out.unionByName(level)
    return out.where("below is null or below < confidence").drop("below")


def judge_pages(pages: DataFrame, labels: DataFrame | None, scratch: Scratch, page_id: str = "page_id", url: str = "url", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_confidence: one row per page row.

    ``labels(page_id, bad)``: pages judged by hand; pages or labels that are null teach nothing, of repeated
    labels of a page any bad one counts.  A fixed rule decides; else the page is blocked if a mined rule
    matches, and allowed otherwise.  A null url or one without ``://`` has empty host and path.
    Repeated pages get a row each; an empty table gives none; other columns are not read.
    """
    u = F.col("_url")
    rows = pages.select(column(page_id).alias("page_id"), column(url).alias("_url")).withColumn("host", host_of(u)).withColumn("path", path_of(u)).withColumn("tokens", url_tokens(F.col("host"), F.col("path"), u)).withColumn("fixed", fixed_rule(F.col("host"), F.col("path")))
    mined = None
    if labels is not None:
        known = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
        mined = mine_rules(rows.join(known, "page_id").select("tokens", "bad"), scratch, min_support, min_confidence)
        n = mined.count()
    if not mined or not n:
        hit = rows.withColumn("mined_confidence", F.lit(None).cast("double"))
    else:
        index = mined.withColumn("token", F.explode("anchor")).groupBy("token").agg(F.collect_list(F.struct("parts", "confidence")).alias("rules"))
        index = F.broadcast(index) if n <= BROADCAST_RULES else index
        numbered = scratch.put(rows.withColumn("uid", F.monotonically_increasing_id()), "pages")
        matched = numbered.where("fixed is null").select("uid", "tokens", F.explode("tokens").alias("token")).join(index, "token").select("uid", F.explode(F.filter("rules", lambda r: F.forall(r["parts"], lambda part: F.arrays_overlap(part, "tokens")))).alias("r")).groupBy("uid").agg(F.max("r.confidence").alias("mined_confidence"))
        hit = numbered.join(matched, "uid", "left")
    verdict = F.coalesce(F.col("fixed.verdict"), F.when(F.col("mined_confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return hit.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), "mined_confidence")
