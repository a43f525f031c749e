"""URL filters: host rules, and a path-template tree for what no rule decides.

A path is a walk down its host's tree. Variable segments (numbers, long hex)
become wildcards at once; a node with more than ``FANOUT`` children of little
support has its children made wildcards too. Branches whose subtrees look alike
and whose labelled shares agree are merged. A template is rejected if the
smoothed share of bad pages among its labelled ones reaches ``REJECT``:
``WEIGHT`` further pages count as ``PRIOR`` of a bad one each. Pages without a
label take the verdict of their template's labelled ones.
DataFrame operations only; trees are built from counts by template, so a host
with many pages is aggregated before it is shuffled, and joined by template.

Rules are (host, path prefix, verdict): a rule fits its host and all subdomains
if the path starts with its prefix; the longest wins. Defined results: a null
url, or one without ``://``, has an empty host and path, fits no rule, and is
judged like any other template; trees are as deep as any two paths run
together; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
FANOUT, SUPPORT = 20, 5
PRIOR, WEIGHT, REJECT = 0.1, 2.0, 0.8
#: How far a branch's child shares, and its bad share, may be from its siblings' and still merge.
ALIKE = 0.2
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def by_rules(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for own, prefix, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(own + prefix)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The segments of a path with variable parts as wildcards."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"(?i)(?<![0-9a-z])(?=[0-9a-f-]*[0-9])[0-9a-f-]{8,}(?![0-9a-z])", "*"), "[0-9]+", "*"))


def _prefix(d: int) -> Column:
    """The template above segment d (from 0), as text that no segment can forge."""
    return F.array_join(F.slice("to", 1, d), "/")


def _tail(d: int) -> Column:
    return F.array_join(F.expr(f"slice(to, {d + 2}, greatest(size(to) - {d + 1}, 0))"), "/")


def _put(d: int, value: str) -> Column:
    return F.transform("to", lambda s, k: F.when(k == d, F.lit(value)).otherwise(s))


def templates(labelled: DataFrame, prior: float = PRIOR, weight: float = WEIGHT, reject: float = REJECT) -> DataFrame:
    """From (host, segs, bad: 1, 0 or null): (host, segs, template, verdict) for each host and list of segments."""
    nodes = labelled.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("bad").alias("known"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    nodes = cut(nodes.withColumn("to", F.col("segs")))
    depth = 0
    while True:  # a node with many children of little support: all of them one wildcard
        d, here = depth, nodes.where(F.size("to") > depth)
        if not here.groupBy("host", _prefix(d)).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            break  # no two paths go on together, so deeper there is nothing to generalise or merge
        depth += 1
        kids = here.groupBy("host", _prefix(d).alias("above"), F.get("to", F.lit(d)).alias("seg")).agg(F.sum("n").alias("n"))
        wide = kids.groupBy("host", "above").agg(F.count("*").alias("kids"), F.sum("n").alias("n")).where((F.col("kids") > FANOUT) & (F.col("n") < SUPPORT * F.col("kids")))
        wide = wide.select(F.col("host").alias("_h"), F.col("above").alias("_a"))
        nodes = nodes.join(wide, (F.col("host") == F.col("_h")) & (_prefix(d) == F.col("_a")), "left")
        nodes = cut(nodes.withColumn("to", F.when(F.col("_h").isNotNull(), _put(d, "*")).otherwise(F.col("to"))).drop("_h", "_a"))
    for d in reversed(range(depth)):  # branches alike in their subtrees and labels: one
        here = nodes.where(F.size("to") > d).select("host", _prefix(d).alias("above"), F.get("to", F.lit(d)).alias("seg"), _tail(d).alias("tail"), "n", "known", "bad")
        shapes = here.groupBy("host", "above", "seg", "tail").agg(*[F.sum(c).alias(c) for c in ("n", "known", "bad")])
        branch = shapes.groupBy("host", "above", "seg").agg(*[F.sum(c).alias(f"b_{c}") for c in ("n", "known", "bad")])
        whole = branch.groupBy("host", "above").agg(*[F.sum(f"b_{c}").alias(f"w_{c}") for c in ("n", "known", "bad")], F.count("*").alias("kids")).where("kids > 1")
        common = shapes.groupBy("host", "above", "tail").agg(F.sum("n").alias("w_tail"))
        each = shapes.join(whole, ["host", "above"]).join(branch, ["host", "above", "seg"]).join(common, ["host", "above", "tail"])
        share, usual = F.col("n") / F.col("b_n"), F.col("w_tail") / F.col("w_n")
        spread = each.groupBy("host", "above", "seg").agg((0.5 * (F.sum(F.abs(share - usual)) + 1 - F.sum(usual))).alias("far"), *[F.max(c).alias(c) for c in ("b_n", "b_known", "b_bad", "w_known", "w_bad")])
        agrees = (F.col("b_known") == 0) | (F.abs(F.col("b_bad") / F.greatest("b_known", F.lit(1)) - F.col("w_bad") / F.greatest("w_known", F.lit(1))) <= ALIKE + 1 / F.sqrt(F.greatest("b_known", F.lit(1))))
        alike = spread.where((F.col("far") <= ALIKE + 1 / F.sqrt("b_n")) & agrees).select(F.col("host").alias("_h"), F.col("above").alias("_a"), F.col("seg").alias("_s"))
        nodes = nodes.join(alike, (F.col("host") == F.col("_h")) & (_prefix(d) == F.col("_a")) & (F.get("to", F.lit(d)) == F.col("_s")), "left")
        nodes = cut(nodes.withColumn("to", F.when(F.col("_h").isNotNull(), _put(d, "{}")).otherwise(F.col("to"))).drop("_h", "_a", "_s"))
    nodes = nodes.withColumn("template", F.concat(F.lit("/"), F.array_join("to", "/")))
    total = nodes.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "known", "bad")])
    purity = (F.col("bad") + prior * weight) / (F.col("known") + weight)
    judged = total.select("host", "template", F.when(purity >= reject, "block").otherwise("allow").alias("found"), purity.alias("purity"))
    return nodes.select("host", "segs", "template").join(judged, ["host", "template"])


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, label: Column | None = None) -> DataFrame:
    """(id_col, host, path, rule, verdict, template) for every row.

    ``label`` (1 bad, 0 good, null unknown) is an expression over ``pages``; without it the pages that a rule decides are the labelled ones.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), (F.lit(None).cast("int") if label is None else label.cast("int")).alias("_label"))
    rows = rows.select("_id", "_label", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("by_rule", verdict).withColumn("segs", segments(F.col("path")))
    bad = F.when(F.col("by_rule").isNotNull(), (F.col("by_rule") == "block").cast("int")) if label is None else F.col("_label")
    found = cut(templates(rows.select("host", "segs", bad.alias("bad"))))
    out = rows.join(found.select("host", "segs", "template", "found"), ["host", "segs"])
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", "found").alias("verdict"), "template")
