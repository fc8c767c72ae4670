"""Cutting lineage and finding connected components, for the operators that need more than one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import cut, drop, ensure_checkpoint_dir, scratch

__all__ = ["bounded_sample", "components", "cut", "drop", "ensure_checkpoint_dir", "scratch", "short_batches", "small"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): one row (node, component) per node, the component being
    its smallest node.

    Alternates the large-star and small-star steps until the edge set no longer changes. Each step is one
    group-by on the node with a minimum, so no node's neighbours are ever gathered in a task; edges stay distinct,
    so a hub of n neighbours has n rows. An empty input gives an empty result. Self-loops and repeated
    edges are ignored; rows with a null end are dropped.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = cut(e.where("u is not null and v is not null and u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        # Large star: every neighbour above u is joined to the least of u and its neighbours.
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: u and its lower neighbours are joined to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        old, e = e, cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        drop(old)
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        state = (row["n"], row["h"])
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(
        roots.join(e.select(F.col("u").alias("node")), "node", "left_anti")
    )


def bounded_sample(rows: DataFrame, text: str, group: str | None, most_rows: int, most_chars: int) -> list[Row]:
    """Different texts of rows, (group,) text, sorted: of each value of group (or of all) at most so many rows and characters (expected), chosen by a hash of the text.

    The choice depends on the texts alone, never on ids, and rows of equal group and text are one before they are collected, so neither many copies nor a column of nulls
    pass the bound. A text of more characters than most_chars is never chosen. For groups of few values: their counts reach the driver.
    """
    keys = [group] if group else []
    rows = rows.where(F.col(text).isNotNull() & (F.length(text) <= most_chars)).select(*keys, text)
    bucket = F.pmod(F.xxhash64(text, F.lit(17)), F.lit(1 << 30))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n_"), F.sum(F.length(text)).alias("c_")).collect()
    share = lambda r: int(min(1.0, most_rows / max(1, r["n_"]), most_chars / max(1, r["c_"] or 0)) * (1 << 30))
    limit = F.lit(share(counts[0]) if counts and not group else 0)
    if group and counts:
        limit = reduce(lambda when, r: when.when(F.col(group).eqNullSafe(F.lit(r[group])), share(r)), counts, F.when(F.lit(False), 0)).otherwise(0)
    return sorted(rows.where(bucket < limit).distinct().collect(), key=lambda r: tuple((x is None, x) for x in r))


#: Rows of whole texts in an Arrow batch. Spark's default is made for short rows.
BATCH_ROWS = 1000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(df: DataFrame) -> DataFrame:
    """df, whose session sends BATCH_ROWS rows at once to Python unless it was told another number than Spark's default.

    Batches lie in memory on both sides, outside the executor's heap. Spark bounds them by bytes too (64 MB, or one row), which longer texts meet first.
    """
    conf = df.sparkSession.conf
    if conf.get(_ROWS_SETTING) == "10000":
        conf.set(_ROWS_SETTING, str(BATCH_ROWS))
    return df


def small(batches, rows: int = 1000):
    """Arrow batches in slices of at most so many rows, so that a worker turns few of them into Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
