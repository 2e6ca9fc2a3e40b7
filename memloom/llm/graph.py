"""Connected components of a link table, by contraction over Spark joins; nothing meets on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memloom.llm.shared import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component: for every id in a link, the smallest id that it reaches.

    Each round points every node at its smallest neighbour, follows the pointers a second step, and renames the links'
    ends; links inside a component vanish. The pointers of all rounds, one after the other, lead to the component.
    Links to itself or with a null end are passed over; an empty table gives an empty result.
    """
    links = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    links = cut(links.union(links.select("b", "a")).distinct(), "links")
    steps: list[DataFrame] = []
    while not links.isEmpty():
        near = cut(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("to")), "pointers")
        jump = near.join(near.select(F.col("id").alias("i2"), F.col("to").alias("to2")), F.col("to") == F.col("i2"), "left")
        far = cut(jump.select("id", F.coalesce("to2", "to").alias("to")), "pointers")
        steps.append(far)
        ends = links.join(far.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a").select("b", "ta")
        ends = ends.join(far.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b").where("ta <> tb")
        links = cut(ends.select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(), "links")
    if not steps:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = steps[0].select("id", F.col("to").alias("component"))
    for step in steps[1:]:
        out = out.join(step.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return out
