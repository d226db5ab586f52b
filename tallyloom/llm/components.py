"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import storage


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    return moved.distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them; links run from larger to smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that links reach, for every node of ``links`` (two long columns a, b).

    Links with a NULL end or equal ends say nothing. Each round is written to the shared folder, in place of the one before; the
    number of rounds grows with the logarithm of a component's width, and ``max_rounds`` only stops a run that cannot end.
    """
    state = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state, path = storage.written(state.where("a <> b").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        total = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if total == before or not total[0]:
            break
        before = total
        state, new = storage.written(_small_star(_large_star(state)), "links")
        storage.remove(links.sparkSession, path)
        path = new
    else:
        raise RuntimeError("links did not settle")
    stars = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionAll(state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
