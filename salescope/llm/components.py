"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.sources.shared import fresh_path, land, release


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.selectExpr("b AS a", "a AS b"))


def _star(edges: DataFrame, nearest: DataFrame) -> DataFrame:
    """Each edge's far end with the least neighbour of its near end."""
    return edges.join(nearest, "a")


def _is_done(state: DataFrame) -> bool:
    """Whether every node but the roots has one edge, and that to a root."""
    twice = state.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    inner = state.join(state.selectExpr("b AS a").distinct(), "a", "left_semi").select("a")
    return twice.unionByName(inner).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for all nodes of ``edges``.

    ``edges`` has a and b of one orderable type; loops and repeats do no harm. In turns,
    every node hands its least neighbour to the larger and then to the smaller ones, until
    all edges lead to roots; that takes some rounds per doubling of the longest path. A node
    with very many edges meets its least neighbour in a join, which may be split, and
    never gathers its neighbours. Each round is written to the shared folder, which keeps the last one only.
    """
    spark = edges.sparkSession
    written: list[str] = []

    def round_of(rows: DataFrame) -> DataFrame:
        written.append(fresh_path(spark, "component_edges"))
        return land(rows, "component_edges", path=written[-1])

    state = round_of(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    while not _is_done(state):
        # Larger neighbours go to the least of a node and all its neighbours.
        ways = _both_ways(state)
        least = ways.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
        large = _star(ways, least).where("b > a").selectExpr("b AS a", "m AS b").distinct()
        # Smaller neighbours, and the node itself, go to the least of them.
        down = round_of(large)
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            _star(down, least)
            .where("b <> m")
            .selectExpr("b AS a", "m AS b")
            .unionByName(least.selectExpr("a", "m AS b"))
            .distinct()
        )
        state = round_of(small)
        release(spark, *written[:-1])
        del written[:-1]
    return state.selectExpr("a AS node", "b AS root").unionByName(state.selectExpr("b AS node", "b AS root").distinct())
