"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import checkpoint_dir

#: So many links at most (8 MB) are connected in one task; more of them in rounds of joins.
ONE_TASK = 1 << 19


def fitted(table: DataFrame, rows: int | None = None, each: int = 1 << 18) -> DataFrame:
    """The table in as many partitions as its rows need (at least two for each core, never more than it has): a short
    table then does not cost a task and a file for each of many near-empty partitions. Without ``rows`` the table is
    counted, so it should be a checkpointed one."""
    rows = table.count() if rows is None else rows
    return table.coalesce(max(2 * table.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def connected(table: pa.Table) -> pa.Table:
    """The same for the links of a bounded table: each node's way leads to the smallest node of its component."""
    way: dict[int, int] = {}

    def end(x: int) -> int:
        while (up := way.setdefault(x, x)) != x:
            way[x] = x = way[up]
        return x

    for u, v in zip(table["u"].to_pylist(), table["v"].to_pylist(), strict=True):
        a, b = end(u), end(v)
        way[max(a, b)] = min(a, b)
    return pa.table({"node": pa.array(list(way), pa.int64()), "root": pa.array([end(x) for x in list(way)], pa.int64())})


def roots(links: DataFrame, most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) of every node of ``links`` (columns a, b, long): the smallest node that it is connected to. Up to
    ``one_task`` links are connected in one task, which saves some forty jobs. Of more, each round hangs the larger
    neighbours of a node, then the smaller ones, on the smallest; links never grow in number. Raises where ``most_rounds``
    are not enough."""
    checkpoint_dir(links.sparkSession)
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    print_of = lambda e: tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
    mark = print_of(edges)
    if mark[0] <= one_task:
        return edges.groupBy(F.lit(0).alias("all")).applyInArrow(connected, "node long, root long")
    for _ in range(most_rounds):
        fit = lambda table, rows=mark[0]: fitted(table, 2 * rows)
        edges = fit(edges)
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = fit(fit(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        edges = fit(fit(small.where("u <> v")).distinct()).checkpoint()
        now = print_of(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components are not complete after {most_rounds} rounds")
    edges = fitted(edges, mark[0])
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
