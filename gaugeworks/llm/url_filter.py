"""URL verdicts: explicit rules first, then a path-template tree with labelled purity.

Per host the paths' segments, all of them, form a tree; empty segments don't count. It is built from aggregated nodes,
never from pages, and each path of a host counts once, however many pages have it:

1. Segments that look like identifiers become wildcards. So do the rare children of a node with more than
   `max_children` of them: those with a share below `rare`.
2. Sibling branches with at least `min_support` labelled paths (those that a rule has judged) are merged if their share
   of blocked ones doesn't differ from the siblings' pooled one by a two-proportion test: each then has the counts of all.
3. A branch's purity lies between its parent's, from the host down, and the share of its labelled paths that are blocked:

       purity = parent's + weight * (blocked / labelled - parent's)
       weight = labelled / paths * labelled / (labelled + prior_weight)

   with 0.5 above the host. Where every path is labelled that is smoothing by `prior_weight` paths of the parent's kind. A
   branch whose labels cover a part of its paths only, since a rule names one of its branches, tells as much less about
   the others, however many there are: growth of a site changes no verdict as long as its shares stay. A branch without
   labels has its parent's purity.
4. Templates whose purity reaches `purity` are rejected: their pages without a rule are blocked, all others allowed.

Pages meet the tree once, by (host, generalised path); every table of nodes that is joined is written first, so that
adaptive execution can cut a host or path that a third of the pages share into several tasks.

Cases: a null url or one without `://` has empty host and path, no rule, and a tree of its own without labels, so its
verdict is allow; very long paths have as many levels as segments; repeated rows and ties are judged alike; an empty
table gives an empty result; columns other than page_id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed by the contract: (verdict, rule).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Segments that name one page rather than a part of a site: numbers, hex digests, dates, anything with three digits.
VARIABLE = r"^([0-9]+(\.[a-z]{1,5})?|[0-9a-fA-F-]{8,}|[^0-9]*[0-9][^0-9]*[0-9][^0-9]*[0-9].*)\z"
WILD = "*"


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict; longest fitting rule first."""
    url = F.col("url").cast("string")
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(cast(url as string), instr(cast(url as string), '://') + 3)")).otherwise(F.lit(""))
    rows = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest"))
    raw = F.regexp_extract("rest", r"^[^/?#]*", 0)
    rows = rows.select("page_id", "rest", raw.alias("raw"))
    path = F.regexp_extract(F.expr("substring(rest, length(raw) + 1)"), r"^[^?#]*", 0)
    rows = rows.select("page_id", F.translate("raw", UPPER, LOWER).alias("host"), path.alias("path"))
    rule, given = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested first
        name, _, start = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith("/" + start)
        rule, given = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(given)
    return rows.withColumn("rule", rule).withColumn("given", given)


def _segments(path: Column) -> Column:
    """All segments of a path that aren't empty; identifiers as wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(VARIABLE), F.lit(WILD)).otherwise(s))


def _above(segments: str) -> Column:
    return F.expr(f"slice({segments}, 1, size({segments}) - 1)")


def _prefixes(segments: str) -> Column:
    """The empty prefix, the first segment, and so on to the whole path."""
    return F.expr(f"transform(sequence(0, size({segments})), k -> slice({segments}, 1, k))")


def _templates(leaves: DataFrame, max_children: int, rare: float) -> DataFrame:
    """leaves with `template`: their segments, rare children as wildcards too."""
    steps = leaves.filter("size(segments) > 0").select("host", "segments", "n", F.explode(F.expr("sequence(1, size(segments))")).alias("level"))
    steps = steps.select("host", "segments", "n", "level", F.expr("slice(segments, 1, level - 1)").alias("parent"), F.expr("segments[level - 1]").alias("child"))
    children = steps.groupBy("host", "parent", "child").agg(F.sum("n").alias("own"))
    parents = children.groupBy("host", "parent").agg(F.count(F.lit(1)).alias("kinds"), F.sum("own").alias("whole"))
    few = children.join(parents, ["host", "parent"]).filter((F.col("kinds") > max_children) & (F.col("own") < rare * F.col("whole"))).select("host", "parent", "child")
    few = materialise(few, "url-rare")
    wild = steps.join(few, ["host", "parent", "child"], "left_semi").groupBy("host", "segments").agg(F.collect_list("level").alias("wild"))  # at most one for each level
    told = leaves.join(wild, ["host", "segments"], "left")
    template = F.transform("segments", lambda s, i: F.when(F.array_contains(F.coalesce("wild", F.array().cast("array<int>")), i + 1), F.lit(WILD)).otherwise(s))
    return told.select("host", "segments", template.alias("template"), "n", "bad", "labelled")


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "bad", "labelled")]


def _nodes(shapes: DataFrame, min_support: int, z: float) -> DataFrame:
    """host, prefix, n, bad, labelled of all nodes of the trees; those of merged siblings have the sums of their group."""
    nodes = shapes.select("host", F.explode(_prefixes("template")).alias("prefix"), "n", "bad", "labelled").groupBy("host", "prefix").agg(*_sums())
    nodes = materialise(nodes, "url-nodes")
    known = nodes.filter((F.size("prefix") > 0) & (F.col("labelled") >= min_support)).withColumn("parent", _above("prefix"))
    pooled = known.groupBy("host", "parent").agg(F.sum("bad").alias("_b"), F.sum("labelled").alias("_l"))
    share = F.col("_b") / F.col("_l")
    error = F.sqrt(share * (1 - share) * (1 / F.col("labelled") + 1 / F.col("_l")))
    alike = known.join(pooled, ["host", "parent"]).filter(F.abs(F.col("bad") / F.col("labelled") - share) <= z * error)
    group = alike.groupBy("host", "parent").agg(F.struct(*_sums()).alias("_all"))
    merged = alike.join(group, ["host", "parent"]).select("host", "prefix", "_all")
    told = nodes.join(merged, ["host", "prefix"], "left")
    return materialise(told.select("host", "prefix", *[F.coalesce(f"_all.{c}", c).alias(c) for c in ("n", "bad", "labelled")]), "url-merged")


def rejected(rows: DataFrame, max_children: int = 20, rare: float = 0.02, min_support: int = 5, purity: float = 0.8, prior_weight: float = 4.0, z: float = 1.96) -> DataFrame:
    """host, segments whose template is rejected. rows: host, path, segments, given."""
    once = rows.groupBy("host", "path").agg(F.first("segments").alias("segments"), F.first("given").alias("given"))  # a path has one of each
    leaves = once.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("given") == "block").alias("bad"), F.count_if(F.col("given").isNotNull()).alias("labelled"))
    told = materialise(_templates(materialise(leaves, "url-leaves"), max_children, rare), "url-templates")
    shapes = told.groupBy("host", "template").agg(*_sums())
    nodes = _nodes(shapes, min_support, z)
    steps = shapes.select("host", "template", F.explode(_prefixes("template")).alias("prefix")).join(nodes, ["host", "prefix"])
    chains = steps.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct(F.size("prefix").alias("level"), "n", "bad", "labelled"))).alias("chain"))  # one for each level
    weight = lambda x: x["labelled"] / x["n"] * (x["labelled"] / (x["labelled"] + prior_weight))
    smoothed = F.aggregate("chain", F.lit(0.5), lambda p, x: F.when(x["labelled"] == 0, p).otherwise(p + weight(x) * (x["bad"] / x["labelled"] - p)))
    out = chains.filter(smoothed >= purity).select("host", "template")
    return materialise(told.join(out, ["host", "template"], "left_semi").select("host", "segments"), "url-rejected")


def url_filter(pages: DataFrame, rules=RULES, **settings) -> DataFrame:
    """Per page: page_id, host, path, rule and verdict (the rule's, else the tree's)."""
    rows = parsed(pages, rules).withColumn("segments", _segments(F.col("path")))
    bad = rejected(rows, **settings).withColumn("_bad", F.lit(True))
    judged = rows.join(bad, ["host", "segments"], "left")
    verdict = F.coalesce("given", F.when(F.col("_bad"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op8_url_filter(spark, sf_dir):
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _rule_sql(value) -> str:
    cases = []
    for rule in sorted(RULES, key=lambda r: -len(r[1])):
        name, _, start = rule[1].partition("/")
        cases.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{start}') THEN '{value(rule)}'")
    return "CASE " + " ".join(cases) + " END"


SQL = f"""
WITH RECURSIVE u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, {_rule_sql(lambda r: r[1])} AS rule, {_rule_sql(lambda r: r[0])} AS given,
  list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '{VARIABLE}') THEN '{WILD}' ELSE s END) AS segments FROM p),
leaves AS (SELECT host, segments, count(*) AS n, count(*) FILTER (given = 'block') AS bad, count(given) AS labelled FROM (SELECT DISTINCT host, path, segments, given FROM r) GROUP BY host, segments),
steps AS (SELECT host, segments, n, level, segments[1:level - 1] AS parent, segments[level] AS child FROM (SELECT *, unnest(range(1, len(segments) + 1)) AS level FROM leaves)),
children AS (SELECT host, parent, child, sum(n) AS own FROM steps GROUP BY host, parent, child),
parents AS (SELECT host, parent, count(*) AS kinds, sum(own) AS whole FROM children GROUP BY host, parent),
few AS (SELECT host, parent, child FROM children JOIN parents USING (host, parent) WHERE kinds > 20 AND own < 0.02 * whole),
wild AS (SELECT host, segments, list(level) AS wild FROM steps JOIN few USING (host, parent, child) GROUP BY host, segments),
told AS (SELECT host, segments, list_transform(segments, lambda s, i: CASE WHEN list_contains(coalesce(wild, []), i) THEN '{WILD}' ELSE s END) AS template, n, bad, labelled FROM leaves LEFT JOIN wild USING (host, segments)),
shapes AS (SELECT host, template, sum(n) AS n, sum(bad) AS bad, sum(labelled) AS labelled FROM told GROUP BY host, template),
walk AS (SELECT host, template, n, bad, labelled, unnest(range(0, len(template) + 1)) AS level FROM shapes),
nodes AS (SELECT host, template[1:level] AS prefix, level, sum(n) AS n, sum(bad) AS bad, sum(labelled) AS labelled FROM walk GROUP BY ALL),
known AS (SELECT *, prefix[1:level - 1] AS parent FROM nodes WHERE level > 0 AND labelled >= 5),
pooled AS (SELECT host, parent, sum(bad) AS b, sum(labelled) AS l FROM known GROUP BY host, parent),
alike AS (SELECT host, parent, prefix, n, bad, labelled FROM known JOIN pooled USING (host, parent) WHERE abs(bad / labelled - b / l) <= 1.96 * sqrt(b / l * (1 - b / l) * (1 / labelled + 1 / l))),
merged AS (SELECT host, prefix, sum(n) OVER w AS m_n, sum(bad) OVER w AS m_bad, sum(labelled) OVER w AS m_labelled FROM alike WINDOW w AS (PARTITION BY host, parent)),
tree AS (SELECT host, prefix, level, coalesce(m_n, n)::DOUBLE AS n, coalesce(m_bad, bad)::DOUBLE AS bad, coalesce(m_labelled, labelled)::DOUBLE AS labelled FROM nodes LEFT JOIN merged USING (host, prefix)),
step AS (SELECT host, prefix, level, CASE WHEN labelled = 0 THEN 0::DOUBLE ELSE labelled / n * (labelled / (labelled + 4.0::DOUBLE)) END AS w, CASE WHEN labelled = 0 THEN 0::DOUBLE ELSE bad / labelled END AS share FROM tree),
chain AS (SELECT host, prefix, level, 0.5::DOUBLE + w * (share - 0.5::DOUBLE) AS p FROM step WHERE level = 0
  UNION ALL SELECT t.host, t.prefix, t.level, c.p + t.w * (t.share - c.p) FROM step t JOIN chain c ON t.host = c.host AND t.level = c.level + 1 AND t.prefix[1:t.level - 1] = c.prefix),
gone AS (SELECT told.host, told.segments FROM told JOIN chain ON told.host = chain.host AND told.template = chain.prefix WHERE p >= 0.8)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN EXISTS (SELECT 1 FROM gone g WHERE g.host = r.host AND g.segments = r.segments) THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""
