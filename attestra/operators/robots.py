"""Robots files: parsed into rules, and asked whether an address may be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .apply import robots_verdict

# How much of a robots file counts.
MOST_CHARS = 512_000


def robots_rules(files: DataFrame) -> DataFrame:
    """``files(origin, text)`` -> ``origin, agent, path, allow``: a row for each rule and each agent that it is meant for.

    A group is one or more lines that name agents and the rules up to the next such line; rules before any agent count for
    nobody. Names are taken in any case, what follows ``#`` is left out, unknown lines are passed over. A rule without a path
    forbids nothing and isn't given; agents without any rule have a row with a null path. Null and empty files have no rules.
    """
    lines = F.split(F.substring(F.regexp_replace("text", "\r\n?", "\n"), 1, MOST_CHARS), "\n")
    rows = files.select("origin", F.posexplode(lines).alias("at", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    rows = rows.select("origin", "at", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("name"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value")).where("name IN ('user-agent', 'allow', 'disallow')")
    file = Window.partitionBy("origin").orderBy("at")  # the lines of one file
    names_agent = F.col("name") == "user-agent"
    begins = names_agent & (F.coalesce(F.lag("name").over(file), F.lit("")) != "user-agent")
    rows = rows.withColumn("group", F.sum(begins.cast("int")).over(file)).where("group > 0")
    agents = rows.where(names_agent).select("origin", "group", F.lower("value").alias("agent")).distinct()
    rules = rows.where(~names_agent & (F.col("value") != "")).select("origin", "group", F.col("value").alias("path"), (F.col("name") == "allow").alias("allow"))
    return agents.join(rules, ["origin", "group"], "left").select("origin", "agent", "path", "allow").distinct()


def matcher(path: Column) -> Column:
    """A rule's path as a pattern: ``*`` is any characters, ``$`` at the end is the address's end, all else is literal."""
    literal = F.regexp_replace(F.regexp_replace(path, r"\$\z", ""), r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(literal, F.lit("*"), F.lit(".*")), F.when(F.endswith(path, F.lit("$")), r"\z").otherwise(""))


def robots_allowed(urls: DataFrame, files: DataFrame, agent: str) -> DataFrame:
    """``urls(url_id, origin, path)``, ``files(origin, status, text)`` -> ``url_id, verdict, rule``.

    404 allows all, 401 and 403 deny all, other statuses but 2xx are ERROR, as is an origin without a file. Else the rules for
    the agent decide, or those for ``*`` if no group names it: the longest path that matches, an allowing one among equals;
    without a match all is allowed. An agent is named by the part before a slash, in any case. Paths hold the query too;
    an empty one is ``/``. A file's rules are one row, as a file is bounded; so an origin with many addresses joins with one.
    """
    name = agent.split("/")[0].strip().lower()
    c = F.col
    rules = robots_rules(files.where("status BETWEEN 200 AND 299")).where(c("agent").isin(name, "*"))
    by_origin = rules.groupBy("origin").agg(F.bool_or(c("agent") == name).alias("named"), F.collect_list(F.when(c("path").isNotNull(), F.struct(F.length("path").alias("length"), "allow", "path", matcher(c("path")).alias("pattern"), (c("agent") == name).alias("own"), c("path").rlike(r"\*|\$\z").alias("wild")))).alias("rules"))
    known = files.select("origin", "status").join(by_origin, "origin", "left")
    path = F.when(F.coalesce(c("path"), F.lit("")) == "", "/").otherwise(c("path"))
    rows = urls.select("url_id", "origin", path.alias("path")).join(known, "origin", "left")
    mine = F.filter("rules", lambda r: (r["own"] == c("named")) & F.when(r["wild"], F.regexp(c("path"), r["pattern"])).otherwise(F.startswith(c("path"), r["path"])))
    rows = rows.withColumn("best", F.array_max(F.transform(mine, lambda r: F.struct(r["length"].alias("length"), r["allow"].alias("allow"), r["path"].alias("path")))))
    said = robots_verdict(c("status"))
    verdict = F.when(c("status").isNull(), "ERROR").when(said != "RULES", said).when(F.coalesce(c("best.allow"), F.lit(True)), "ALLOW").otherwise("DENY")
    return rows.select("url_id", verdict.alias("verdict"), F.when(said == "RULES", c("best.path")).alias("rule"))
