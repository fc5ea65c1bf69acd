"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of the links (a, b), the smallest node it reaches.

    Each round points a node to the smallest of itself and its neighbours, follows pointers to
    their ends, and replaces every node of the links by its end. Links within one end vanish
    and equal ones become one, so the links shrink fast; the rounds end with the last link. Each is
    written to the shared folder. Links of a node that has very many are folded on the map
    side. No links: no rows.
    """
    edges, found = materialise(links.select("a", "b").distinct(), "links"), None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        ends = _followed(materialise(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("end")), "ends"))
        found = ends if found is None else _through(found, ends)
        a, b = ends.select(F.col("node").alias("a"), F.col("end").alias("x")), ends.select(F.col("node").alias("b"), F.col("end").alias("y"))
        left = edges.join(a, "a").join(b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = materialise(left, "links")
        if edges.isEmpty():
            return found.select("node", F.col("end").alias("component"))


def _through(low: DataFrame, high: DataFrame) -> DataFrame:
    """(node, end): the ends of low, sent on to what high has for them."""
    on = high.select(F.col("node").alias("end"), F.col("end").alias("next"))
    return materialise(low.join(on, "end", "left").select("node", F.coalesce("next", "end").alias("end")), "ends")


def _followed(ends: DataFrame) -> DataFrame:
    """Pointers followed to their ends; each round doubles how far they reach."""
    while True:
        on = ends.filter("node <> end").select(F.col("node").alias("end"), F.col("end").alias("next"))
        moving = ends.filter("node <> end").join(on, "end", "left_semi")
        if moving.isEmpty():
            return ends
        ends = _through(ends, on.select(F.col("end").alias("node"), F.col("next").alias("end")))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) after further links (a, b) between their nodes or new ones."""
    def named(side: str) -> DataFrame:
        return labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_to"))

    between = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
    higher = materialise(components(between.filter("a <> b")), "labels")
    old = labels.join(higher.select(F.col("node").alias("component"), F.col("component").alias("next")), "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return materialise(old.union(higher.join(labels, "node", "left_anti").select("node", "component")), "labels")
