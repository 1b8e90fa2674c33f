"""Connected components by contraction: each round hooks every vertex to its smallest neighbour and merges the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b): root is one vertex of its component, the same for all of it.

    Repeated edges, loops and an empty table are allowed. A round's edges and pointers are written, so lineage does
    not grow; the graph at least halves its vertices that still have edges. Minima are combined before the shuffle and
    only two columns move, so a vertex with very many neighbours is no more than a key with many small rows.
    """
    left = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    pointers: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("to")), "hooks")
        twice = smallest.select(F.col("v").alias("to"), F.col("to").alias("next"))
        hooked = written(smallest.join(twice, "to").select("v", F.col("next").alias("to")), "pointers")
        pointers.append(hooked)
        of_a = hooked.select(F.col("v").alias("a"), F.col("to").alias("ra"))
        of_b = hooked.select(F.col("v").alias("b"), F.col("to").alias("rb"))
        merged = left.join(of_a, "a").join(of_b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        left = written(merged.distinct(), "edges")
    if not pointers:
        return left.select(F.col("a").alias("v"), F.col("b").alias("root"))
    out = pointers[0].select("v", F.col("to").alias("root"))
    for p in pointers[1:]:
        further = p.select(F.col("v").alias("root"), F.col("to").alias("_next"))
        out = out.join(further, "root", "left").select("v", F.coalesce("_next", "root").alias("root"))
    return out
