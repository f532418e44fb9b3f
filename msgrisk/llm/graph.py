"""Connected components of an edge table, by randomised contraction.

Each round gives every vertex the neighbour (or itself) of the smallest hash,
merges along these choices and relabels the edges; hashes change with the
round, so a chain shrinks by a constant factor whatever its order. A hub's
edges meet in a minimum, which is combined before the shuffle. Rounds are
written to the shared folder, so nothing depends on an executor's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgrisk.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of ``edges(u, v)``; self loops give a vertex alone."""
    roots = materialise(edges.select(F.col("u").alias("vertex")).union(edges.select("v")).distinct().withColumn("root", F.col("vertex")), "roots")
    now = materialise(edges.filter("u <> v").distinct(), "links")
    k = 0
    while not now.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("x"))
        both = now.select("u", "v").union(now.select("v", "u"))
        chosen = both.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least("m", rank("u"))["x"].alias("to"))
        chosen = materialise(chosen, "chosen")
        left, right = chosen.toDF("u", "a"), chosen.toDF("v", "b")
        now = materialise(now.join(left, "u").join(right, "v").filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "links")
        roots = materialise(roots.join(chosen.toDF("root", "to"), "root", "left").select("vertex", F.coalesce("to", "root").alias("root")), "roots")
        k += 1
    return roots
