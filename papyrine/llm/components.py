"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Neighbourhoods are never gathered: each step is an aggregation with map-side combine and one join. Every step is stored in the
shared folder, so no plan holds another step's; rounds end as soon as the edges are stars. Nothing comes to the driver but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import materialize


def _both(edges: DataFrame) -> DataFrame:
    """A row (node, other) for each end of the edges (u, v)."""
    ends = F.array(*(F.struct(F.col(x).alias("node"), F.col(y).alias("other")) for x, y in ("uv", "vu")))
    return edges.select(F.explode(ends).alias("e")).select("e.*")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), v < u. Large: link larger neighbours to the least of the neighbourhood; small: the others and oneself."""
    if large:
        least = _both(edges).groupBy(F.col("node").alias("v")).agg(F.min("other").alias("m")).withColumn("m", F.least("m", "v"))
        joined = edges.join(least, "v").select("u", F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return joined.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each larger end has one edge and is no other edge's lesser end: then the edges are stars around least nodes."""
    seen = _both(edges).groupBy("node").agg(F.count_if(F.col("node") > F.col("other")).alias("up"), F.count("*").alias("n"))
    return not seen.where("up > 1 or (up = 1 and n > 1)").agg(F.count("*")).first()[0]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node that ``node`` reaches; nodes without an edge don't appear.

    ``edges`` has two columns of one orderable type, in any order, with repeats and loops allowed.
    """
    a, b = edges.columns[:2]
    state = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    state = materialize(state, "edges")
    for _ in range(max_rounds):
        if _settled(state):
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        for large in (True, False):
            state = materialize(_star(state, large), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
