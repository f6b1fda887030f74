"""A run over captured pages, as a command: python -m parcela.jobs --input PAGES --output DIR --portal a --mode listing

Pages in the range and budget asked for become rows; rows that the journal doesn't have yet are appended; the snapshot,
the state, the failures, the counters and the dumps of intermediate responses are written anew, so a run that is repeated changes
nothing. Pages are parsed once and written, and so are the rows, under DIR/work. Results pages end at the second empty
one in a row. Everything but the one-row state stays distributed.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.operators import incremental as inc
from parcela.operators.observed import Counters
from parcela.plans import portals
from parcela.sources import files, tables

MODES = ("listing", "detail", "cards")


@dataclass(frozen=True)
class Options:
    input: str
    output: str
    portal: str = "a"
    mode: str = "listing"
    page_start: int = 1
    max_pages: int | None = None
    max_properties: int | None = None
    snapshot_files: int | None = None

    def __post_init__(self):
        if self.mode not in MODES or self.portal not in ("a", "b", "c") or (self.mode == "cards") != (self.portal == "c"):
            raise ValueError("portals a and b have modes listing and detail; portal c has cards")
        for name in ("page_start", "max_pages", "max_properties", "snapshot_files"):
            if getattr(self, name) is not None and getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")


def rows_of(pages: DataFrame, options: Options) -> tuple[DataFrame, str]:
    """The rows of the pages, and the name of their key."""
    if options.mode == "cards":
        return portals.cards(pages), "item_id"
    portal = portals.PORTAL_A if options.portal == "a" else portals.PORTAL_B
    return (portals.listing if options.mode == "listing" else portals.detail)(pages, portal), "url"


def up_to_empty_pages(good: DataFrame, rows: DataFrame, most: int = 2) -> DataFrame:
    """The rows of the pages up to the last of `most` pages in a row that have none."""
    found = rows.groupBy("pagina_origen").count()
    each = good.filter("page is not null").select("page").distinct().join(found, F.col("page") == F.col("pagina_origen"), "left")
    stop = inc.stop_page(each.withColumn("empty", F.col("count").isNull()), "page", "empty", most).first()[0]
    return rows if stop is None else rows.filter(F.coalesce(F.col("pagina_origen") <= stop, F.lit(True)))


def run(spark: SparkSession, options: Options) -> None:
    written = lambda df, name: (df.write.mode("overwrite").parquet(f"{options.output}/work/{name}"), spark.read.schema(df.schema).parquet(f"{options.output}/work/{name}"))[1]
    pages = spark.read.parquet(options.input)
    pages = inc.page_range(pages, "page", options.page_start, options.max_pages) if "page" in pages.columns else pages
    widgets = portals.features.WIDGETS_B if options.portal == "b" else portals.features.WIDGETS_A
    counters = Counters(spark)
    pages = portals.classified(pages, widgets, parsed=True)
    seen = written(counters.watch(pages, "pages", n_ok=F.count(F.when(F.col("response") == "ok", 1)), n_intermediate=F.count(F.when(F.col("status") == 202, 1))), "pages")
    good = seen.filter("response = 'ok'").drop("block_reason", "response")
    failed = seen.filter("response <> 'ok'").withColumn("reason", F.coalesce(F.concat(F.col("response"), F.lit(":"), F.col("block_reason")), F.col("response")))
    tables.failures(failed, "reason", "captured_at").write.mode("overwrite").json(f"{options.output}/failures")
    tables.diagnostics(seen).write.mode("overwrite").parquet(f"{options.output}/diagnostics")
    rows, key = rows_of(good, options)
    rows = written(counters.watch(inc.earliest(rows.filter(F.col(key).isNotNull()), [key], "pagina_origen"), "rows"), "rows")
    rows = rows if options.mode == "detail" else up_to_empty_pages(good, rows)
    journal = f"{options.output}/journal"
    new = inc.new_only(rows, spark.read.parquet(journal), key).select(*rows.columns) if files.exists(spark, journal) else rows
    new = inc.budget(new, ["pagina_origen", key], options.max_properties) if options.max_properties else new
    counters.watch(new, "new").write.mode("append").parquet(journal)
    counters.save(f"{options.output}/counters")
    whole = spark.read.parquet(journal)
    tables.write_snapshot(whole, f"{options.output}/snapshot", parts=options.snapshot_files)
    done = tables.last_completed(good, "page", inc.new_only(rows, whole, key), "pagina_origen")
    tables.state(whole, key, "pagina_origen").withColumn("last_completed_page", F.lit(done).cast("int")).write.mode("overwrite").json(f"{options.output}/state")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--portal", choices=("a", "b", "c"), default="a")
    parser.add_argument("--mode", choices=MODES, default="listing")
    for name, start in (("page-start", 1), ("max-pages", None), ("max-properties", None), ("snapshot-files", None)):
        parser.add_argument(f"--{name}", type=int, default=start)
    run(SparkSession.builder.appName("parcela").getOrCreate(), Options(**vars(parser.parse_args(argv))))


if __name__ == "__main__":
    main()
