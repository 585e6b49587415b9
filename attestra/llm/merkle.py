"""A manifest of a dataset as a Merkle tree, with a proof for each document.

Documents are leaves of their source's tree, the sources' roots are leaves of one tree more. Levels are built by grouping
runs of consecutive nodes. Proofs come by pointer jumping: each node holds the segment of siblings towards an ancestor;
a self-join appends the ancestor's own segment, which doubles the distance, until every leaf reaches the root. Nodes too
low to be anybody's ancestor any more are left out of later rounds, so these join leaves with ever fewer rows.

No group is gathered: places in a source come from ranges of the sorted table and their sizes, runs have ``FANOUT`` nodes
at most, and a proof grows with the logarithm of the table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace

FANOUT = 3
#: The tree above the sources.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left: binary, right: binary>>"


def digest(*values: Column) -> Column:
    """SHA-256 in lowercase hex of the values as texts, each with its length in UTF-8 before it; ``-`` is null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give; all digests as hex text."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(F.lower(F.hex(s["left"])), acc, F.lower(F.hex(s["right"]))), 256))


def siblings(path: Column) -> Column:
    """A proof's digests as hex text, one after the other."""
    return F.array_join(F.transform(path, lambda s: F.lower(F.hex(F.concat(s["left"], s["right"])))), "")


def _height(n: int) -> int:
    h = 0
    while FANOUT**h < n:
        h += 1
    return h


def _ranked(rows: DataFrame, by: list[str], order: list[str], ws: Workspace, label: str) -> DataFrame:
    """Adds ``idx``, the place among the rows of the same ``by``, and ``n``, their number.

    Rows are sorted by range; a range knows its rows' places, and what lies before it is a sum over ranges, so a group
    that fills many of them costs a row for each.
    """
    sort = [*by, *order]
    placed = ws.keep(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33)), label)
    ranges = placed.groupBy(*by, "range").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy(*by)
    before = F.sum("rows").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ws.keep(ranges.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("range").alias("_range"), "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n")), f"{label}-ranges")
    same = F.col("range") == F.col("_range")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return placed.join(ranges, same).withColumn("idx", F.col("at") - F.col("first") + F.col("before")).drop("at", "range", "first", "before", "_range", *(f"_{c}" for c in by))


def _levels(nodes: DataFrame, height: int, ws: Workspace, label: str) -> list[DataFrame]:
    """``nodes(tree, idx, n, digest, load)`` -> for each level its runs: ``tree, idx, n`` of the parents, their digest, the run."""
    out = []
    for level in range(height):
        run = F.array_sort(F.collect_list(F.struct("idx", "digest", "load")))
        runs = nodes.where("n > 1").groupBy("tree", F.expr(f"idx div {FANOUT}").alias("up"), "n").agg(run.alias("run"))
        parent = F.unhex(F.sha2(F.array_join(F.transform("run", lambda x: F.lower(F.hex(x["digest"]))), ""), 256))
        runs = ws.keep(runs.select("tree", F.col("up").alias("idx"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), parent.alias("digest"), "run"), f"{label}-{level}")
        out.append(runs)
        nodes = runs.select("tree", "idx", "n", "digest", F.lit(None).cast(nodes.schema["load"].dataType).alias("load"))
    return out


class Proofs(NamedTuple):
    """``leaves``: ``source, doc_id, leaf, load, tree, path``; ``sources``: ``tree, source, subroot``; ``root``: one row."""

    leaves: DataFrame
    sources: DataFrame
    root: DataFrame


def prove(leaves: DataFrame, ws: Workspace) -> Proofs | None:
    """``leaves(source string, doc_id long, leaf string, load string)`` -> every leaf's siblings up to the root.

    ``leaf`` is a hex digest; ``load`` is handed through. Leaves of a source stand in the order of their ids, nulls first,
    those of one id in the order of their digests, so rows repeated whole may change places unnoticed. A null source is a
    source of its own and the first. Without any leaf there is no root: the result is None.
    """
    spark = leaves.sparkSession
    rows = leaves.select("source", "doc_id", F.unhex("leaf").alias("digest"), F.col("load"))
    ranked = _ranked(rows, ["source"], ["doc_id", "digest"], ws, "leaves")
    sources = _ranked(ranked.groupBy("source").agg(F.max("n").alias("size")), [], ["source"], ws, "sources").withColumnRenamed("idx", "tree")
    sources = ws.keep(sources.select(F.col("source").alias("_source"), "tree", "size", F.col("n").alias("trees")), "trees")
    most = sources.agg(F.max("size"), F.max("trees")).first()
    if most[0] is None:
        return None
    height, top = _height(most[0]), _height(most[1])
    load = F.struct("doc_id", F.col("load").alias("value"))
    leaf = ws.keep(ranked.join(sources, F.col("source").eqNullSafe(F.col("_source"))).select("tree", "idx", "n", "digest", load.alias("load")), "placed")
    below = _levels(leaf, height, ws, "level")
    ends = [leaf.where("n = 1").select("tree", "digest", "load")] + [runs.where("n = 1").select("tree", "digest", F.lit(None).cast(leaf.schema["load"].dataType).alias("load")) for runs in below]
    subroots = ends[0]
    for end in ends[1:]:
        subroots = subroots.union(end)
    subroots = ws.keep(subroots, "subroots")
    above = _levels(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(most[1]).cast("long").alias("n"), "digest", F.lit(None).cast("long").alias("load")), top, ws, "top")
    root = (above[-1] if above else subroots).select(F.lower(F.hex("digest")).alias("root"))

    def climb(runs: DataFrame, level: int, upper: bool) -> DataFrame:
        """The nodes of a level, with their siblings and their parent; the root is no parent, as nothing lies above."""
        at = F.posexplode("run").alias("at", "node")
        part = lambda first, n: F.array_join(F.transform(F.slice("run", first, n), lambda x: F.hex(x["digest"])), "")
        rows = runs.select("tree", F.col("idx").alias("up"), "n", "run", at)
        left, right = F.unhex(part(F.lit(1), F.col("at"))), F.unhex(part(F.col("at") + 2, F.lit(FANOUT)))
        ends = F.col("n") == 1  # the parent is its tree's root
        over = F.lit(True) if upper or top == 0 else F.lit(False)
        link = F.struct(F.when(ends, TOP).otherwise(F.col("tree")).cast("long").alias("tree"), F.when(ends, 0).otherwise(level + 1).cast("int").alias("level"), F.when(ends, F.col("tree")).otherwise(F.col("up")).alias("idx"))
        empty = F.lit(None).cast("struct<doc_id: long, value: string>")
        return rows.select(
            F.struct("tree", F.lit(level).cast("int").alias("level"), F.col("node.idx").alias("idx")).alias("at"), F.when(~(ends & over), link).alias("up"), F.array(F.struct(left.alias("left"), right.alias("right"))).cast(STEP).alias("path"),
            (F.col("node.load") if level == 0 and not upper else empty).alias("load"), F.when(F.lit(level == 0 and not upper), F.col("node.digest")).alias("digest"), F.col("tree").alias("of"),
        )

    alone = F.struct(F.lit(TOP).cast("long").alias("tree"), F.lit(0).cast("int").alias("level"), F.col("tree").alias("idx"))
    single = subroots.where("load IS NOT NULL").select(F.lit(None).cast("struct<tree: long, level: int, idx: long>").alias("at"), F.when(F.lit(top > 0), alone).alias("up"), F.array().cast(STEP).alias("path"), "load", "digest", F.col("tree").alias("of"))
    paths = single
    for level, runs in enumerate(below):
        paths = paths.union(climb(runs, level, False))
    for level, runs in enumerate(above):
        paths = paths.union(climb(runs, level, True))
    paths = ws.keep(paths, "reach-1")
    reach, farthest = 1, max(height + top, top + 1)
    while reach < farthest:
        ancestors = paths.where((F.col("at.tree") == TOP) | (F.col("at.level") >= reach))
        movers = paths.where(F.col("load").isNotNull() | (F.col("at.tree") == TOP) | (F.col("at.level") >= 2 * reach))
        further = ancestors.select(F.col("at.tree").alias("t"), F.col("at.level").alias("l"), F.col("at.idx").alias("i"), F.col("up").alias("beyond"), F.col("path").alias("more"))
        further = ws.keep(further, f"ancestors-{reach}")  # its size shows whether it can go to every task
        there = (F.col("up.tree") == F.col("t")) & (F.col("up.level") == F.col("l")) & (F.col("up.idx") == F.col("i"))
        moved = movers.where("up IS NOT NULL").join(further, there).select("at", F.col("beyond").alias("up"), F.concat("path", "more").alias("path"), "load", "digest", "of")
        paths = movers.where("up IS NULL").union(moved)
        reach *= 2
        if reach < farthest:
            paths = ws.keep(paths, f"reach-{reach}")
    found = paths.where("load IS NOT NULL").select("load.doc_id", F.lower(F.hex("digest")).alias("leaf"), F.col("load.value").alias("load"), F.col("of").alias("tree"), "path")
    return Proofs(found, subroots.join(sources, "tree").select("tree", F.col("_source").alias("source"), F.lower(F.hex("digest")).alias("subroot")), spark.createDataFrame(root.collect(), "root string"))


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's proof. Where 2 divides the crc32 of the id's digits, the leaf is folded from a text without line feeds.

    A null id has no digits and isn't tampered with.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), *(F.col(c) for c in FIELDS[1:]))
    fields = {c: F.col(c) for c in FIELDS}
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    altered = F.when(touched & F.contains("text", F.lit("\n")), digest(*(fields | {"text": F.replace(fields["text"], F.lit("\n"), F.lit(""))}).values()))
    ws = Workspace(spark)
    proofs = prove(ws.keep(docs.select("source", "doc_id", digest(*fields.values()).alias("leaf"), altered.alias("load")), "digests"), ws)
    if proofs is None:
        return spark.createDataFrame([], RESULT)
    rows = proofs.leaves.join(proofs.sources, "tree").crossJoin(F.broadcast(proofs.root))  # one row
    proof, fold = F.sha2(siblings(F.col("path")), 256), folded(F.coalesce("load", "leaf"), F.col("path"))
    out = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = """
WITH RECURSIVE t AS (
  SELECT *, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM documents
), l AS (
  SELECT doc_id, source, head || coalesce(octet_length(encode(text)) || ':' || text, '-') AS whole,
         CASE WHEN xor(crc, 4294967295) % 2 = 0 AND text IS NOT NULL
              THEN head || octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), '') END AS cut
  FROM (SELECT *, coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
               || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM t)
), leaves AS (
  SELECT doc_id, source, sha256(whole) AS leaf, sha256(coalesce(cut, whole)) AS held, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx,
         count(*) OVER (PARTITION BY source) AS n
  FROM l
), low AS (
  SELECT source, 0 AS level, idx, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY source, level, n, idx // 3
), sub AS (
  SELECT source, level AS height, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS ord, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, ord AS idx, n, subroot AS digest FROM sub
  UNION ALL
  SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY level, n, idx // 3
), nodes AS (
  SELECT source, FALSE AS upper, level, idx, n, digest FROM low UNION ALL SELECT NULL, TRUE, level, idx, n, digest FROM high
), runs AS (
  SELECT source, upper, level, idx // 3 AS up, list(digest ORDER BY idx) AS run FROM nodes WHERE n > 1 GROUP BY source, upper, level, idx // 3
), climb AS (
  SELECT l.doc_id, l.leaf, l.source, s.height, s.ord, s.subroot, 0 AS level, '' AS proof, l.held AS acc, l.idx AS place FROM leaves l JOIN sub s ON l.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT c.doc_id, c.leaf, c.source, c.height, c.ord, c.subroot, c.level + 1,
         c.proof || array_to_string(r.run[1:c.place % 3], '') || array_to_string(r.run[c.place % 3 + 2:], ''),
         sha256(array_to_string(r.run[1:c.place % 3], '') || c.acc || array_to_string(r.run[c.place % 3 + 2:], '')),
         CASE WHEN c.level + 1 = c.height THEN c.ord ELSE c.place // 3 END
  FROM (SELECT * REPLACE (CASE WHEN level = height THEN ord ELSE place END AS place) FROM climb) c
  JOIN runs r ON r.upper = (c.level >= c.height) AND r.level = CASE WHEN c.level >= c.height THEN c.level - c.height ELSE c.level END AND r.up = c.place // 3
       AND (r.upper OR r.source IS NOT DISTINCT FROM c.source)
), done AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) AS last FROM climb
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM done, (SELECT digest AS root FROM high WHERE n = 1) WHERE last = 1
"""
