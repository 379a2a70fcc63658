"""Connected components of a link table, without ever bringing links together in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.llm.shared import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); component is the smallest id that can be reached.

    Every round each node points at its smallest neighbour, pointers are followed twice, and links are
    rewritten between what they point at. Pointers only ever go to smaller ids, so the smallest id of a
    component keeps its name; a round at least halves the names that still have links. Minima combine
    before the shuffle and joins are plain equi-joins, so a node with very many links is no hot task.
    Null ends and loops are no links. Each round is written to the shared folder.
    """
    links = links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    links = stored(links.where("a is not null and b is not null and a != b").distinct(), "links")
    names = None
    while not links.isEmpty():
        near = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("b"))
        points = stored(least.select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "points")
        nearest = points
        for _ in range(2):
            step = points.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
            points = points.join(step, "to").select("node", F.col("beyond").alias("to"))
        points = stored(points, "points")
        discard(nearest)
        before = names
        if names is None:
            names = points.select(F.col("node").alias("id"), F.col("to").alias("component"))
        else:
            moved = points.select(F.col("node").alias("component"), "to")
            names = names.join(moved, "component", "left").select(
                "id", F.coalesce("to", "component").alias("component")
            )
        names = stored(names, "names")
        if before is not None:
            discard(before)
        old = links
        for end in ("a", "b"):
            links = links.join(points.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")), end)
        links = links.select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).where("a != b").distinct()
        links = stored(links, "links")
        discard(old, points)
    return names if names is not None else links.select(F.col("a").alias("id"), F.col("b").alias("component"))
