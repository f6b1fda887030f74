"""Incremental tables: anti-joins, first and latest wins, budgets, dead letters, journals to snapshots.

Spark rows have no order, so every operator names its order column(s) where the first, last or next counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_only(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of found whose key isn't known. Null keys are never known."""
    return found.join(known.select(key).distinct(), key, "left_anti")


def matched_or_failed(links: DataFrame, rows: DataFrame, key: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """links with their rows, and the dead letters: links without one, with the reason."""
    both = links.join(rows.withColumn("_matched", F.lit(True)), key, "left")
    dead = both.filter("_matched is null").select(*[links[c] for c in links.columns if c != key], key).withColumn("reason", F.lit(reason))
    return both.filter("_matched").drop("_matched"), dead


def latest(journal: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row with the greatest order, and first_seen, the least: snapshots keep keys in the
    order in which they came. Pre-aggregated before the shuffle; rows of one key are never gathered."""
    whole = F.struct(*[F.col(c) for c in journal.columns])
    out = journal.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(whole, F.col(order)).alias("_row"), F.min(order).alias("first_seen"))
    return out.select("_row.*", "first_seen")


def earliest(found: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row with the least order."""
    return found.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in found.columns]), F.col(order)).alias("_row")).select("_row.*")


def budget(found: DataFrame, order: list[str], left: int) -> DataFrame:
    """The first `left` rows in order."""
    return found.orderBy(*order).limit(max(0, left))


def page_range(pages: DataFrame, column: str, start: int, most: int | None) -> DataFrame:
    kept = F.col(column) >= start
    return pages.filter(kept if most is None else kept & (F.col(column) < start + most))


def numbered(found: DataFrame, within: list[str], order: str, name: str = "position") -> DataFrame:
    """Places from 1, in order, within each group."""
    return found.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(order)))


def stop_page(pages: DataFrame, column: str, empty: str, most: int = 2) -> DataFrame:
    """One row: the page at which a run ends because `most` pages in a row were empty; null if none did. Each empty page
    counts for itself and for the pages up to most - 1 after it; the first that `most` pages count for is the end. So
    no task sees all pages in order."""
    own = pages.filter(F.col(empty)).select(F.col(column).alias("_page")).distinct()
    reached = own.select(F.explode(F.sequence("_page", F.col("_page") + (most - 1))).alias("_page")).groupBy("_page").count()
    return reached.filter(F.col("count") == most).agg(F.min("_page").alias("stop_page"))


def counters(rows: DataFrame, key: str) -> DataFrame:
    """Numbers of rows and of distinct keys."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"))


def sorted_json(column: str) -> Column:
    """A map column as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.col(column)))))
