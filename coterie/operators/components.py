"""Connected components of an edge table by alternating large-star and small-star rounds.

Both stars are a ``min`` aggregation (map-side combined) and an equi-join on the node, which AQE can
split where a hub is skewed.  Every round is written to the shared folder, so lineage stays short and
a lost executor costs one round at most.  Nothing about the graph reaches the driver but one row with
the number of edges and an order-free checksum, which tells when a round changed nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.functions.storage import materialize, release


def _joined(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the smallest of u and its neighbours."""
    mins = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(mins, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = _joined(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = _joined(down)
    links = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        joined.select("u", F.col("m").alias("v"))
    )
    return links.where(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    ).collect()[0]
    return row["n"], int(row["s"] or 0)


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph.

    ``edges``: two columns of one orderable type; nulls and self-loops are ignored, repeats are free.
    Returns ``node, component`` (the smallest node of the component) for every node that has an edge;
    an empty edge table gives an empty result.
    """
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null and u != v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        after = materialize(_small_star(_large_star(e)))
        new = _state(after)
        release(e)
        e, old, state = after, state, new
        if new == old:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
