"""Connected components of an undirected graph given by its edges.

Stars in turn: each node hands its larger neighbours to its smallest, then the smaller
ones. After a number of rounds that grows with the logarithm of the nodes, every node is
joined to its component's smallest. Minima are taken before the shuffle, so a node with
very many neighbours costs no more than its edges, and the joins are ones that Spark can
split. Each round is written to the shared folder; only a count and a checksum come to
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folio.session import write_once


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``edges``: (a, b). The result: (node, root) for every node but the roots; a root is
    the smallest node of its component. Null ends are not edges."""
    now = write_once(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state, before = _state(now), None
    while state != before:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        large = write_once(large.filter("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        met = large.join(least, "a")
        small = met.select(F.col("b").alias("a"), F.col("_m").alias("b")).union(least.select("a", F.col("_m").alias("b")))
        now = write_once(small.filter("a <> b").distinct())
        state, before = _state(now), state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
