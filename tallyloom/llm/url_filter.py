"""URL filter: explicit rules, then a tree of path templates for each host.

Segments of digits or of long hexadecimal text become typed wildcards. Level by level, the branches of a node are
compared by their labels: a branch whose labelled share of blocked pages does not differ from that of its siblings
(chi-squared with one degree of freedom below ``similar``), or which has no labels, is named ``*``; so are branches
seen fewer than ``support`` times under a node with over ``children`` branches. A template is rejected if its smoothed
share of blocked pages, (blocked + a) / (labelled + 2a), is over ``purity``. Templates without labels have the share one
half and pass. Built-in functions only.

A branch without labels is like its labelled siblings only if a node above it was told apart by its labels: it then
inherits what holds there. Elsewhere nothing says that they are alike, and the pages of such branches are judged apart
from labelled ones of the same template; having no labels, they pass.

Urls are first reduced to distinct (host, segments) with counts, so the tree is built on that much smaller table and
a host that holds a third of all pages is spread like any other.

The tree goes as deep as the paths do, one written table a level. A path that is alone under a node has no siblings to
differ from, so that its further levels are known and it leaves the tree there.

Defined cases: a null url or one without ``://`` has empty host and path, fits no rule and passes; an empty table gives no rows; repeated rows give repeated rows; extra columns
are not read. Of rules of equal length that fit one url, the first in text order holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.ascii import ascii_lower
from tallyloom.functions.spill import join_counted, written

#: The levels that the query's SQL spells out; the tree itself has no such end.
DEPTH = 3
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, _URL, 1)), F.regexp_extract(url, _URL, 2)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]], wanted: int) -> Column:
    """Of the rules (verdict, 'host/path') that fit, the longest: its text if ``wanted`` is 1, its verdict if 0. Else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        name, _, rest = rule[1].partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule[wanted])).otherwise(found)
    return found


def segments(path: Column) -> Column:
    """All segments of a path, typed."""

    def typed(s: Column) -> Column:
        return F.when(s.rlike(r"^[0-9a-f]{8,}$") & s.rlike("[a-f]"), "{hex}").otherwise(F.regexp_replace(s, r"^[0-9]+($|\.)", "{n}$1"))

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), typed)


def template_tree(shapes: DataFrame, support: int = 5, children: int = 8, similar: float = 3.84) -> DataFrame:
    """Adds ``template`` and ``apart`` to rows (host, segs, n, labelled, blocked), one for each shape.

    ``apart``: under a branch without labels, and no node above that branch was told apart by labels.
    """
    size = F.size("segs")
    level = shapes.select("*", F.col("host").alias("template"), F.lit(False).alias("told"), F.lit(False).alias("apart"))
    done, level, k = level.filter(size == 0), level.filter(size > 0), 0
    while not level.isEmpty():
        rows = level.withColumn("s", F.get("segs", F.lit(k)))
        branch = rows.groupBy("template", "s").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")], F.count(F.lit(1)).alias("shapes"))
        family = branch.groupBy("template").agg(F.count(F.lit(1)).alias("_c"), F.sum("labelled").alias("_l"), F.sum("blocked").alias("_b"), F.sum("shapes").alias("_shapes"))
        joined = branch.join(family, "template")
        l, b, lr, br = F.col("labelled"), F.col("blocked"), F.col("_l") - F.col("labelled"), F.col("_b") - F.col("blocked")
        d = [x.cast("double") for x in (F.col("_l"), b * (lr - br) - br * (l - b), l, lr, F.col("_b"), F.col("_l") - F.col("_b"))]
        below = d[2] * d[3] * d[4] * d[5]
        differs = F.when(below > 0, d[0] * d[1] * d[1] / below >= F.lit(float(similar))).otherwise(F.lit(False))
        rare = (F.col("n") < support) & (F.col("_c") > children)
        name = F.when(differs & ~rare, F.col("s")).otherwise(F.lit("*"))
        named = joined.select("template", "s", name.alias("_name"), (l == 0).alias("_bare"), (differs & ~rare).alias("_told"), (F.col("_shapes") == 1).alias("_alone"))
        rest = F.when(F.col("_alone"), F.repeat(F.lit("/*"), size - F.lit(k + 1))).otherwise(F.lit(""))
        rows = rows.join(named, ["template", "s"]).select(
            "host", "segs", "n", "labelled", "blocked", F.concat("template", F.lit("/"), "_name", rest).alias("template"), (F.col("told") | F.col("_told")).alias("told"),
            (F.col("apart") | (F.col("_bare") & ~F.col("told"))).alias("apart"), (F.col("_alone") | (size == k + 1)).alias("_ended"))
        rows = written(rows, "url-level")
        done = done.unionByName(rows.filter("_ended").drop("_ended"))
        level, k = rows.filter("NOT _ended").drop("_ended"), k + 1
    return done


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], purity: float = 0.7, smoothing: float = 2.0, support: int = 5,
               children: int = 8, similar: float = 3.84, id_col: str = "page_id", url_col: str = "url", label: Column | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, template). label: 1 blocked, 0 fine, null unknown; by default what the rules say."""
    host, path = host_and_path(F.col(url_col))
    found = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), *([label.cast("int").alias("_label")] if label is not None else []))
    verdict = longest_rule(F.col("host"), F.col("path"), rules, 0)
    found = found.select("*", longest_rule(F.col("host"), F.col("path"), rules, 1).alias("rule"), verdict.alias("_said"), segments(F.col("path")).alias("segs"))
    if label is None:
        found = found.withColumn("_label", F.when(F.col("_said").isNotNull(), (F.col("_said") == "block").cast("int")))
    found = written(found, "urls")
    keys = ["host", "segs"]
    shapes = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("_label").alias("labelled"), F.coalesce(F.sum("_label"), F.lit(0)).alias("blocked"))
    tree = template_tree(written(shapes, "url-shapes"), support, children, similar)
    sums = tree.groupBy("template", "apart").agg(F.sum("labelled").cast("double").alias("_l"), F.sum("blocked").cast("double").alias("_b"))
    bad = (F.col("_b") + F.lit(smoothing)) / (F.col("_l") + F.lit(2 * smoothing)) > F.lit(purity)
    judged = written(tree.select(*keys, "n", "template", "apart").join(sums.select("template", "apart", bad.alias("_bad")), ["template", "apart"]).drop("apart"), "url-templates")
    out = join_counted(found, judged, keys, "n", found.count())
    return out.select("page_id", "host", "path", "rule", F.coalesce("_said", F.when(F.col("_bad"), "block").otherwise("allow")).alias("verdict"), "template")
