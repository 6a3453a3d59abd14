"""Elementary cycles of a dependency graph.

Cycles live inside strongly connected components, so edges that no circle can use are peeled off first (a
node without an incoming or without an outgoing edge, again and again). Paths then grow by joins from their
least node only, so each cycle is found from one start. A cycle and its reverse count as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.ids import nul_id
from corvane.functions.tables import checkpointed


def peeled(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Edges (a, b) left when nodes without a way in or a way out are gone."""
    now = checkpointed(edges.select("a", "b").distinct())
    n = now.count()
    for _ in range(most_rounds):
        ends = now.select(F.col("b").alias("x")).intersect(now.select(F.col("a").alias("x")))
        now = checkpointed(now.join(ends.withColumnRenamed("x", "xa"), F.col("a") == F.col("xa"), "left_semi").join(ends.withColumnRenamed("x", "xb"), F.col("b") == F.col("xb"), "left_semi"))
        left = now.count()
        if left in (0, n):
            break
        n = left
    return now


def rotated(route: Column) -> Column:
    """The least rotation of a cycle in either direction, as an array."""
    turns = lambda r: F.transform(F.sequence(F.lit(1), F.size(r)), lambda i: F.concat(F.slice(r, i, F.size(r)), F.slice(r, 1, i - 1)))
    return F.array_min(F.concat(turns(route), turns(F.reverse(route))))


def elementary_cycles(edges: DataFrame, most_nodes: int | None = None) -> DataFrame:
    """cycle: array of nodes, of each elementary cycle of the edges (a, b), self-loops included.

    The number of cycles can grow exponentially with the edges; `most_nodes` bounds a cycle's length where a
    graph is too dense to list them all.
    """
    edges = peeled(edges)
    paths = edges.select(F.col("a").alias("start"), F.col("b").alias("at"), F.array("a").alias("route"))
    found = None
    length = 1
    while most_nodes is None or length <= most_nodes:
        closed = paths.where("at = start").select("route")
        found = closed if found is None else found.unionByName(closed)
        more = paths.where("at > start AND NOT array_contains(route, at)").select("start", F.col("at").alias("via"), F.concat("route", F.array("at")).alias("route"))
        paths = checkpointed(more.join(edges, F.col("via") == F.col("a")).where("b >= start").select("start", F.col("b").alias("at"), "route"))
        if paths.isEmpty():
            break
        length += 1
    return found.select(rotated(F.col("route")).alias("cycle")).distinct()


def dependency_cycles(dependencies: DataFrame, parsed_files: DataFrame, most_nodes: int | None = None) -> DataFrame:
    """id, file_ids, relative_paths of each cycle of files, both in the order of the least rotation of the paths."""
    names = parsed_files.select("file_id", "relative_path")
    edges = dependencies.join(names.withColumnsRenamed({"file_id": "s", "relative_path": "a"}), F.col("source_file_id") == F.col("s")).join(names.withColumnsRenamed({"file_id": "t", "relative_path": "b"}), F.col("target_file_id") == F.col("t"))
    found = elementary_cycles(edges.select("a", "b"), most_nodes)
    spread = found.select(F.col("cycle").alias("relative_paths"), F.posexplode("cycle").alias("at", "path"))
    ids = spread.join(names, F.col("path") == F.col("relative_path")).groupBy("relative_paths").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "file_id"))), lambda x: x["file_id"]).alias("file_ids"))
    return ids.select(nul_id("cycle", F.array_join("file_ids", "\0")).alias("id"), "file_ids", "relative_paths")
