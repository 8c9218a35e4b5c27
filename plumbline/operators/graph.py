"""Lineage graphs: dataset choice, short names, assets and bounded reachability with paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import criticality, short_name
from . import stable

MAX_HOPS, MAX_RESULTS = 3, 100


def preferred(candidates: DataFrame, keyword: str, urn: str = "urn", name: str = "name", position: str = "position", marker: str = "dbt", by: list[str] | None = None) -> DataFrame:
    """One row: the candidate whose short name is the keyword, else the first by position; only urns with the marker."""
    exact = (F.lower(short_name(F.col(name))) == keyword.casefold()).cast("int")
    order = Window.partitionBy(*(by or [])).orderBy(F.desc("_exact"), position)
    marked = candidates.where(F.contains(F.lower(F.col(urn)), F.lit(marker))).withColumn("_exact", exact)
    if not by:
        return marked.orderBy(F.desc("_exact"), position).limit(1).drop("_exact")
    return marked.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at", "_exact")


def ordered_distinct(df: DataFrame, name: str, position: str) -> DataFrame:
    """Short names once each with their first position."""
    return df.groupBy(short_name(F.col(name)).alias("short_name")).agg(F.min(position).alias("first_position"))


def assets(entities: DataFrame, source_name: str) -> DataFrame:
    """Downstream assets of raw entities (urn, name, type, platform, degree, tokens, paths): without urn or name none.

    A representation is a copy under the source's own short name; of several paths the first counts, without elements that lack a urn.
    """
    known = entities.where("urn is not null and name is not null")
    path = F.filter(F.coalesce(F.try_element_at("paths", F.lit(1)), F.array()), lambda x: x["urn"].isNotNull())
    return known.select("urn", "name", "type", "platform", "degree", criticality(F.col("tokens")).alias("criticality"), F.array_distinct("tokens").alias("classifications"), (F.lower(short_name(F.col("name"))) == source_name.rpartition(".")[2].casefold()).alias("is_representation"), path.alias("lineage_path"))


#: Out-edges from which a node is a hub, whose edges are dealt to PARTS tasks; a thousandth of all edges if that is more, so that there are a thousand at most.
HUB, PARTS = 100_000, 64


def _hubs(edges: DataFrame, hub: int) -> DataFrame | None:
    """The hubs (src), a thousand at most; None if there are none."""
    least = max(hub, -(-edges.count() // 1000))
    found = [(r["src"],) for r in edges.groupBy("src").count().where(F.col("count") >= least).select("src").collect()]
    return edges.sparkSession.createDataFrame(found, edges.select("src").schema).withColumn("_hub", F.lit(True)) if found else None


def hops_from(edges: DataFrame, sources: DataFrame, hops: int = MAX_HOPS, hub: int = HUB) -> list[DataFrame]:
    """For each hop the nodes met then: source, node, parent. Each hop is one join on the frontier, which carries no path.

    Of the nodes of the hop before that lead to a node, the smallest is its parent. Nodes met earlier are left out, which also ends cycles.
    """
    edges, keys = edges.select("src", "dst"), ["src"]
    hubs = _hubs(edges, hub)
    if hubs is not None:  # a hub's edges are dealt to PARTS tasks
        keys.append("part")
        edges = edges.join(F.broadcast(hubs), "src", "left").select("src", "dst", F.when(F.col("_hub"), F.pmod(F.xxhash64("dst"), F.lit(PARTS))).otherwise(0).cast("int").alias("part"))
    met = [sources.select(F.col("node").alias("source"), "node", F.lit(None).cast("string").alias("parent")).distinct()]
    for hop in range(hops):
        seen = reduce(DataFrame.unionByName, [x.select("source", "node") for x in met])
        front = met[-1].select("source", F.col("node").alias("src"))
        if hubs is not None:
            parts = F.when(F.col("_hub"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
            front = front.join(F.broadcast(hubs), "src", "left").select("source", "src", F.explode(parts).alias("part"))
        step = front.join(edges, keys).groupBy("source", F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        step = step.join(seen, ["source", "node"], "left_anti")
        met.append(stable.kept(step) if hop < hops - 1 else step)
    return met[1:]


def reachable(edges: DataFrame, sources: DataFrame, hops: int = MAX_HOPS, limit: int | None = None, hub: int = HUB) -> DataFrame:
    """source, node, degree, path: nodes within `hops` of each source (column node) over edges (src, dst), by a shortest path.

    With a limit, each source's first nodes by degree and name. Paths are put together backwards from parents, for what is returned only.
    """
    met = hops_from(edges, sources, hops, hub)
    found = reduce(DataFrame.unionByName, [x.withColumn("degree", F.lit(i + 1)) for i, x in enumerate(met)])
    if limit is not None:
        order = Window.partitionBy("source").orderBy("degree", "node")
        found = stable.kept(found.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= limit).drop("_at"))
    out = []
    for degree in range(1, hops + 1):
        own = found.where(F.col("degree") == degree).select("source", "node", "degree", "parent", F.array("node").alias("path"))
        for back in range(degree - 2, -1, -1):
            before = met[back].select("source", F.col("node").alias("parent"), F.col("parent").alias("_next"))
            own = own.join(before, ["source", "parent"]).select("source", "node", "degree", F.col("_next").alias("parent"), F.concat(F.array("parent"), "path").alias("path"))
        out.append(own.select("source", "node", "degree", F.concat(F.array("source"), "path").alias("path")))
    return reduce(DataFrame.unionByName, out)


def reachable_sql(edges: str, source: str, hops: int = MAX_HOPS) -> str:
    """Nodes within `hops` of one source, as a recursive query over a view of edges (src, dst)."""
    return f"""
WITH RECURSIVE reached(node, degree) AS (
  SELECT CAST({source} AS STRING), 0
  UNION ALL
  SELECT e.dst, r.degree + 1 FROM reached r JOIN {edges} e ON e.src = r.node WHERE r.degree < {hops}
)
SELECT node, CAST(min(degree) AS BIGINT) AS degree FROM reached WHERE degree > 0 GROUP BY node
"""
