"""Connected components of an edge table by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _scrambled(c):
    """A bijection of 64-bit integers without arithmetic overflow: the order of nodes in the rounds is then as good as random."""
    c = c.bitwiseXOR(F.shiftleft(c, 13))
    c = c.bitwiseXOR(F.shiftrightunsigned(c, 7))
    return c.bitwiseXOR(F.shiftleft(c, 17))


def component_ids(edges: DataFrame) -> DataFrame:
    """From edges (u, v) of 64-bit integers: d, component (the smallest id reachable), for each id with an edge.

    Each round maps every node to its least neighbour in the scrambled order, or to itself, and replaces edges by those between the
    images; about half of the nodes or more go per round. The rounds' maps are then composed. Rounds are written to the shared
    folder, so lineage stays short. A node with very many edges meets only a partial aggregate (its minimum) and sort-merge joins,
    which AQE splits. Null ends are ignored.
    """
    ends = written(edges.where("u is not null and v is not null and u != v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")), "ends")
    names = ends.select(F.explode(F.array("u", "v")).alias("d")).distinct()
    now = written(ends.select(_scrambled(F.col("u")).alias("u"), _scrambled(F.col("v")).alias("v")).select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))).distinct(), "edges")
    whole: DataFrame | None = None
    while not now.isEmpty():
        to = written(now.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("to")), "labels")
        whole = to if whole is None else whole.join(to.withColumnRenamed("u", "at").withColumnRenamed("to", "next"), F.col("to") == F.col("at"), "left").select("u", F.coalesce("next", "to").alias("to"))
        first = now.join(to, "u").select(F.col("to").alias("a"), "v")
        second = first.join(to.withColumnRenamed("u", "v"), "v").select(F.col("a").alias("u"), F.col("to").alias("v"))
        now = written(second.where("u != v").distinct(), "edges")
    if whole is None:
        return edges.sparkSession.createDataFrame([], "d long, component long")
    of = written(names.withColumn("u", _scrambled(F.col("d"))).join(whole, "u").select("d", "to"), "roots")
    least = of.groupBy("to").agg(F.min("d").alias("component"))
    return of.join(least, "to").select("d", "component")
