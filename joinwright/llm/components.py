"""Connected components by alternating large-star and small-star steps.

Each half step is an aggregate and an equi-join. The minima are written
before they are joined, so that both sides of the join are plain shuffles
which adaptive execution can split where one node has very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinwright.llm.workspace import Workspace

MAX_ROUNDS = 60


def _half_step(work: Workspace, edges: DataFrame, name: str, large: bool) -> DataFrame:
    if large:
        seen = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    low = work.write(low, f"{name}-low")
    joined = seen.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        out = joined.select(F.explode(pairs).alias("p")).select("p.u", "p.v").where("u <> v")
    out = work.write(out.distinct(), name)
    work.drop(f"{name}-low")
    return out


def connected_components(work: Workspace, edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v, both long): root is the
    smallest node that can be reached. Nodes without an edge are not listed.
    """
    edges = work.write(edges.where("u <> v").select("u", "v").distinct(), "edges-0")
    mark, last = None, "edges-0"
    for k in range(1, MAX_ROUNDS):
        edges = _half_step(work, edges, f"edges-{k}a", large=True)
        work.drop(last)
        edges = _half_step(work, edges, f"edges-{k}b", large=False)
        work.drop(f"edges-{k}a")
        last = f"edges-{k}b"
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("connected components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
