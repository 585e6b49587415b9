"""URL filters: listed rules, then templates learned for each host.

A path is a walk in its host's tree, a segment a level, however deep. Going down level by level, digits become ``<n>``,
the children of a node become a wildcard when they are many and each rare, and siblings merge when what lies below them is
alike: they have the same chief children, and a chi-squared test finds their counts of children no more unlike than chance
allows; where both have labels, their shares of blocked pages must be alike too. The labels are the rules' own verdicts. A
node's purity is its labelled share of blocked pages, smoothed towards its parent's purity, so branches without labels take
over what the branches that they merged with, or the levels above, have learned. Templates of high purity are rejected.
All of it works on counts by host and template: aggregations and joins, no windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, Workspace

#: A node's children become a wildcard when there are that many at least and they have no more pages each than this.
FANOUT, MEAN_PAGES = 16, 4
#: A node is looked into while it has that many pages, of two kinds of path at least; below, what is left of a path is one step.
LEAST_PAGES = 8
#: A child is a chief one when it has that share of a node's pages.
CHIEF = 0.25
#: Standard errors within which two shares count as alike, and the normal quantile (99 %) of the test on children.
ALIKE, LIKELY = 1.96, 2.326
#: Labelled pages that the parent's purity counts for; the purity of a host without labels; the purity that is rejected.
WEIGHT, PRIOR, PURITY = 2.0, 0.5, 0.8
#: Up to so many rules come as one expression, more as a join by host.
LITERAL_RULES = 200


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def ruled(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct of its text and verdict; else null."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text, r.verdict))
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    options = [F.when(fits(r), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ordered]
    return F.coalesce(*options) if options else F.lit(None).cast("struct<rule: string, verdict: string>")


def with_rules(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds ``hit``, as ``ruled`` gives it, to ``rows(host, path, ...)``. Long lists are joined by each suffix of a host."""
    if len(rules) <= LITERAL_RULES:
        return rows.withColumn("hit", ruled(F.col("host"), F.col("path"), rules))
    listed = rows.sparkSession.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "suffix string, start string, rule string, verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = rows.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix"))
    fits = each.join(listed, (each["suffix"] == listed["suffix"]) & each["path"].startswith(listed["start"]))
    best = fits.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("k"), "rule", "verdict")).alias("best"))
    best = best.select(F.col("host").alias("h"), F.col("path").alias("p"), F.struct("best.rule", "best.verdict").alias("hit"))
    return rows.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").drop("h", "p")


def _first(rest: Column) -> Column:
    return F.substring_index(rest, "/", 1)


def _wide(nodes: DataFrame, parents: list[str], step: str) -> DataFrame:
    """Replaces ``step`` by ``*`` under parents with many rare children."""
    children = nodes.groupBy(*parents, step).agg(F.sum("n").alias("n"))
    wide = children.groupBy(*parents).agg(F.count("*").alias("kids"), F.sum("n").alias("all")).where((F.col("kids") >= FANOUT) & (F.col("all") <= MEAN_PAGES * F.col("kids")))
    return nodes.join(wide.select(*parents, F.lit(True).alias("wide")), parents, "left").withColumn(step, F.when(F.col("wide"), F.lit("*")).otherwise(F.col(step))).drop("wide")


def _branches(nodes: DataFrame, ws: Workspace) -> DataFrame:
    """``nodes(host, prefix, step, below, n, m, b)`` -> ``host, prefix, step, branch``: the name under which a step goes on.

    Siblings with the same chief children are a pool. Each is tested against its whole pool, for what lies below it and for
    its labels; those that pass go by the least of their names in braces.
    """
    at, pool = ["host", "prefix", "step"], ["host", "prefix", "shape"]
    cells = ws.keep(nodes.groupBy(*at, "below").agg(*(F.sum(c).alias(c) for c in "nmb")), "cells")
    steps = ws.keep(cells.groupBy(*at).agg(F.sum("n").alias("tot"), F.sum("m").alias("m"), F.sum("b").alias("b")), "steps")
    chief = cells.select(*at, "below", "n").join(steps.select(*at, "tot"), at).where(F.col("n") >= CHIEF * F.col("tot"))
    shapes = ws.keep(chief.groupBy(*at).agg(F.array_join(F.array_sort(F.collect_set("below")), "\x01").alias("shape")), "shapes")  # four at most
    steps = ws.keep(steps.join(shapes, at, "left").withColumn("shape", F.coalesce("shape", F.lit(""))), "shaped")
    parts = ws.keep(cells.select(*at, "below", "n").join(steps.select(*at, "tot", "shape"), at), "parts")
    shares = ws.keep(parts.groupBy(*pool, "below").agg(F.sum("n").alias("held")), "shares")
    chi = parts.join(shares, [*pool, "below"]).groupBy(*pool, "step").agg(F.sum(F.col("n").cast("double") * F.col("n") / (F.col("tot") * F.col("held"))).alias("chi"))
    pools = steps.groupBy(*pool).agg(F.sum("tot").alias("size"), F.sum("m").alias("mm"), F.sum("b").alias("bb"))
    pools = pools.join(shares.groupBy(*pool).agg((F.count("*") - 1).cast("double").alias("free")), pool)
    rows = steps.join(ws.keep(pools, "pools"), pool).join(ws.keep(chi, "chi"), [*pool, "step"]).where("size > tot")
    spread = 2 / (9 * F.col("free"))
    bound = F.when(F.col("free") == 0, 1e-6).otherwise(F.col("free") * F.pow(1 - spread + LIKELY * F.sqrt(spread), F.lit(3.0)))
    apart_by = (F.col("chi") * F.col("size") - F.col("tot")) / (1 - F.col("tot") / F.col("size"))
    rest, share = F.col("mm") - F.col("m"), (F.col("bb") + 1) / (F.col("mm") + 2)
    error = F.sqrt(share * (1 - share) * (1 / F.greatest(F.col("m"), F.lit(1)) + 1 / F.greatest(rest, F.lit(1))))
    apart = F.abs(F.col("b") / F.greatest(F.col("m"), F.lit(1)) - (F.col("bb") - F.col("b")) / F.greatest(rest, F.lit(1)))
    same = (apart_by <= bound) & ((F.col("m") == 0) | (rest == 0) | (apart <= ALIKE * error))
    alike = ws.keep(rows.where(same).select(*pool, "step"), "alike")
    named = alike.groupBy(*pool).agg(F.concat(F.lit("{"), F.min("step"), F.lit("}")).alias("branch"))
    return alike.join(named, pool).select(*at, "branch")


def _purity(b: Column, m: Column, above: Column) -> Column:
    return (b + WEIGHT * above) / (m + WEIGHT)


def _shared(x: Column, y: Column) -> Column:
    """How many whole segments all paths from ``x`` to ``y`` begin with, if each goes on behind them."""
    a, b = F.split(x, "/"), F.split(y, "/")
    size = F.least(F.size(a), F.size(b)) - 1
    unlike = F.array_position(F.zip_with(F.slice(a, F.lit(1), size), F.slice(b, F.lit(1), size), lambda s, t: s == t), F.lit(False))
    return F.when(unlike > 0, unlike - 1).otherwise(size).cast("int")


def _looked_into(nodes: DataFrame, ws: Workspace, label: str) -> DataFrame:
    """Adds ``p``, the purity of the node of each row, and whether the node is ``open``.

    Below an open node whose paths all go on alike, nothing can merge and no page leaves until they part; the walk goes to
    that place at once, with the purity that it has after so many levels.
    """
    sums = nodes.groupBy("host", "prefix").agg(F.sum("n").alias("pages"), F.sum("m").alias("mm"), F.sum("b").alias("bb"), F.min("rest").alias("x"), F.max("rest").alias("y"), F.count("rest").alias("deeper"), F.count("*").alias("rows"))
    kinds = (F.col("x") != F.col("y")) | (F.col("deeper") != F.col("rows"))
    wanted = (F.col("pages") >= LEAST_PAGES) & (F.col("deeper") > 0) & F.coalesce(kinds, F.lit(True))
    skipped = F.when(wanted & (F.col("deeper") == F.col("rows")), _shared(F.col("x"), F.col("y"))).otherwise(0)
    sums = sums.select("host", "prefix", "mm", "bb", wanted.alias("wanted"), "x", skipped.alias("skipped"))
    sums = sums.select("host", "prefix", "mm", "bb", "wanted", "skipped", F.when(F.col("skipped") > 0, F.array_join(F.slice(F.split("x", "/"), F.lit(1), F.col("skipped")), "/")).alias("way"))
    purity = F.aggregate(F.sequence(F.lit(0), F.col("skipped")), F.col("p"), lambda p, _: _purity(F.col("bb").cast("double"), F.col("mm").cast("double"), p))
    rows = nodes.join(sums, ["host", "prefix"]).withColumn("p", purity)
    rows = rows.withColumn("prefix", F.concat("prefix", F.coalesce(F.concat(F.lit("/"), F.col("way")), F.lit("")))).withColumn("rest", F.when(F.col("way").isNull(), F.col("rest")).otherwise(F.substr("rest", F.length("way") + 2)))
    return ws.keep(rows.select("host", "raw", "prefix", "rest", "n", "m", "b", "p", (F.col("wanted") & F.col("rest").isNotNull()).alias("open")), label)


def templates(pages: DataFrame, ws: Workspace) -> DataFrame:
    """``pages(host, path, verdict)`` -> ``host, raw, template, purity``, a row for each kind of path (digits as ``<n>``).

    ``verdict`` is a page's rule's, or null. A round goes down to where paths part next, in all hosts at once; the rounds end
    when no node has both pages enough and two kinds of path below it. So rounds are as many as partings on one path.
    """
    raw = F.regexp_replace("path", "[0-9]+", "<n>")
    nodes = pages.groupBy("host", raw.alias("raw")).agg(F.count("*").alias("n"), F.count("verdict").alias("m"), F.count(F.when(F.col("verdict") == "block", 1)).alias("b"))
    nodes = nodes.withColumn("prefix", F.lit("")).withColumn("rest", F.when(F.col("raw") != "", F.substr("raw", F.lit(2)))).withColumn("p", F.lit(PRIOR))
    done, now = [], _looked_into(nodes, ws, "root")
    while True:
        done.append(now.where("not open"))
        open_ = now.where("open")
        if not open_.limit(1).count():
            break
        open_ = open_.withColumn("step", _first(F.col("rest")))
        tail = F.when(F.instr("rest", "/") > 0, F.substr("rest", F.length("step") + 2))
        open_ = ws.keep(_wide(open_.withColumn("tail", tail), ["host", "prefix"], "step"), "generalised")
        open_ = _wide(open_.withColumn("below", F.coalesce(_first(F.col("tail")), F.lit("$"))), ["host", "prefix", "step"], "below")
        open_ = ws.keep(open_, "steps")
        branches = ws.keep(_branches(open_, ws), "branches")
        down = open_.join(branches, ["host", "prefix", "step"], "left")
        down = down.select("host", "raw", F.concat("prefix", F.lit("/"), F.coalesce("branch", "step")).alias("prefix"), F.col("tail").alias("rest"), "n", "m", "b", "p")
        now = _looked_into(down, ws, "level")
    leaves = done[0]
    for part in done[1:]:
        leaves = leaves.unionByName(part)
    leaves = ws.keep(leaves, "leaves")
    kind = F.concat_ws("/", "prefix", "rest")
    sums = leaves.groupBy("host", kind.alias("template"), "p").agg(F.sum("m").alias("mm"), F.sum("b").alias("bb"), F.count("rest").alias("below"))
    sums = sums.select("host", "template", F.when(F.col("below") > 0, _purity(F.col("bb"), F.col("mm"), F.col("p"))).otherwise(F.col("p")).alias("purity"))
    return leaves.select("host", "raw", kind.alias("template")).join(sums, ["host", "template"])


def filtered(pages: DataFrame, ws: Workspace, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``pages(page_id, url, ...)`` -> ``page_id, host, path, rule, verdict``, a row for each row.

    A null url, or one without ``://``, has empty host and path; such rows are a host of their own. Pages no rule fits
    are blocked when their template is rejected, else allowed. A host without labels rejects nothing. Repeated rows count
    as often as they are there. An empty table gives an empty result; other columns are ignored.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = with_rules(pages.select("page_id", host.alias("host"), path.alias("path")), rules)
    rows = rows.select("page_id", "host", "path", "hit.rule", F.col("hit.verdict").alias("verdict"), F.regexp_replace("path", "[0-9]+", "<n>").alias("raw"))
    rejected = templates(rows, ws).where(F.col("purity") >= PURITY).select("host", "raw").distinct()
    out = rows.join(ws.keep(rejected, "rejected").withColumn("rejected", F.lit(True)), ["host", "raw"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet"), Workspace(spark))


def _wide_sql(name: str, source: str, parents: str, step: str) -> str:
    on = " AND ".join(f"w.{p} = s.{p}" for p in parents.split(", "))
    return f"""{name} AS (
  SELECT s.* REPLACE (CASE WHEN w.host IS NULL THEN s.{step} ELSE '*' END AS {step}) FROM {source} s LEFT JOIN (
    SELECT {parents} FROM (SELECT {parents}, {step}, sum(n) AS n FROM {source} GROUP BY {parents}, {step}) GROUP BY {parents}
    HAVING count(*) >= {FANOUT} AND sum(n) <= {MEAN_PAGES} * count(*)
  ) w ON {on}
)"""


def _looked_into_sql(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT host, raw, prefix, rest, n, m, b, (bb + {WEIGHT} * p) / (mm + {WEIGHT}) AS p, wanted AND rest IS NOT NULL AS open
  FROM {source} JOIN (
    SELECT host, prefix, sum(m) AS mm, sum(b) AS bb,
      sum(n) >= {LEAST_PAGES} AND count(rest) > 0 AND coalesce(min(rest) <> max(rest) OR count(rest) <> count(*), true) AS wanted
    FROM {source} GROUP BY host, prefix
  ) USING (host, prefix)
)"""


def _level_sql(i: int) -> str:
    """A round of ``templates``, from the nodes ``a{i}`` to ``a{i + 1}``."""
    return f"""o{i} AS (
  SELECT *, split_part(rest, '/', 1) AS step, CASE WHEN contains(rest, '/') THEN substr(rest, length(split_part(rest, '/', 1)) + 2) END AS tail FROM a{i} WHERE open
), {_wide_sql(f"p{i}", f"o{i}", "host, prefix", "step")}, q{i} AS (
  SELECT *, coalesce(split_part(tail, '/', 1), '$') AS below FROM p{i}
), {_wide_sql(f"r{i}", f"q{i}", "host, prefix, step", "below")}, c{i} AS (
  SELECT host, prefix, step, below, sum(n) AS n, sum(m) AS m, sum(b) AS b FROM r{i} GROUP BY ALL
), t{i} AS (
  SELECT host, prefix, step, sum(n) AS tot, sum(m) AS m, sum(b) AS b FROM c{i} GROUP BY ALL
), h{i} AS (
  SELECT t.*, coalesce(shape, '') AS shape FROM t{i} t LEFT JOIN (
    SELECT host, prefix, step, string_agg(below, chr(1) ORDER BY below) AS shape FROM c{i} JOIN t{i} USING (host, prefix, step) WHERE n >= {CHIEF} * tot GROUP BY ALL
  ) USING (host, prefix, step)
), g{i} AS (
  SELECT host, prefix, shape, sum(tot) AS size, sum(m) AS mm, sum(b) AS bb FROM h{i} GROUP BY ALL
), s{i} AS (
  SELECT host, prefix, shape, below, sum(n) AS held FROM c{i} JOIN h{i} USING (host, prefix, step) GROUP BY ALL
), k{i} AS (
  SELECT host, prefix, shape, (count(*) - 1)::DOUBLE AS free FROM s{i} GROUP BY ALL
), x{i} AS (
  SELECT host, prefix, shape, step, sum(n::DOUBLE * n / (tot * held)) AS chi
  FROM c{i} JOIN (SELECT host, prefix, step, tot, shape FROM h{i}) USING (host, prefix, step) JOIN s{i} USING (host, prefix, shape, below) GROUP BY ALL
), l{i} AS (
  SELECT host, prefix, shape, step FROM h{i} JOIN g{i} USING (host, prefix, shape) JOIN k{i} USING (host, prefix, shape) JOIN x{i} USING (host, prefix, shape, step)
  WHERE size > tot AND (chi * size - tot) / (1 - tot / size) <= CASE WHEN free = 0 THEN 1e-6 ELSE free * pow(1 - 2 / (9 * free) + {LIKELY} * sqrt(2 / (9 * free)), 3.0) END
    AND (m = 0 OR mm - m = 0 OR abs(b / greatest(m, 1) - (bb - b) / greatest(mm - m, 1))
      <= {ALIKE} * sqrt((bb + 1) / (mm + 2) * (1 - (bb + 1) / (mm + 2)) * (1 / greatest(m, 1) + 1 / greatest(mm - m, 1))))
), b{i} AS (
  SELECT host, prefix, step, branch FROM l{i} JOIN (SELECT host, prefix, shape, '{{' || min(step) || '}}' AS branch FROM l{i} GROUP BY ALL) USING (host, prefix, shape)
), d{i} AS (
  SELECT host, raw, prefix || '/' || coalesce(branch, step) AS prefix, tail AS rest, n, m, b, p FROM r{i} LEFT JOIN b{i} USING (host, prefix, step)
), {_looked_into_sql(f"a{i + 1}", f"d{i}")}"""


#: Levels that the SQL is written out for; no path of the tables is deeper than three.
SQL_LEVELS = 4

OP10_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN coalesce(instr(url, '://'), 0) > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS bare, rest FROM cut
), split AS (
  SELECT page_id, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(bare) + 1), '^[^?#]*') AS path FROM parts
), rules AS (
  SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) r(v, h, p)
), hits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
), judged AS (
  SELECT s.page_id, host, path, rule, verdict, regexp_replace(path, '[0-9]+', '<n>', 'g') AS raw FROM split s LEFT JOIN hits USING (page_id)
), nodes AS (
  SELECT host, raw, '' AS prefix, CASE WHEN raw <> '' THEN substr(raw, 2) END AS rest, count(*) AS n, count(verdict) AS m, count(*) FILTER (verdict = 'block') AS b, {PRIOR}::DOUBLE AS p
  FROM judged GROUP BY host, raw
), {_looked_into_sql("a0", "nodes")}, {", ".join(_level_sql(i) for i in range(SQL_LEVELS))}, leaves AS (
  {" UNION ALL ".join(f"SELECT host, raw, concat_ws('/', prefix, rest) AS template, rest, m, b, p FROM a{i} WHERE NOT open" for i in range(SQL_LEVELS))} UNION ALL
  SELECT host, raw, concat_ws('/', prefix, rest), rest, m, b, p FROM a{SQL_LEVELS}
), sums AS (
  SELECT host, template, CASE WHEN count(rest) > 0 THEN (sum(b) + {WEIGHT} * p) / (sum(m) + {WEIGHT}) ELSE p END AS purity FROM leaves GROUP BY host, template, p
), rejected AS (
  SELECT DISTINCT host, raw FROM leaves JOIN sums USING (host, template) WHERE purity >= {PURITY}
)
SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN r.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN rejected r ON j.host = r.host AND j.raw = r.raw
"""
