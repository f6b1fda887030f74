"""The crawl loop as a stateful stream: results pages in, each search's new links and progress out.

Keyed by search, a state holds how many empty pages came in a row, the last completed page, the number of links taken,
whether the search has ended, and the links seen, each in a state of its own, which may expire. A page that couldn't be
had (has_html false) counts as empty and isn't completed; one without links counts as empty and is completed, unless it ends
the search; links set the count back. After `most` empty pages in a row a search has ended: what comes later
is read and dropped. A restart goes on from the checkpoint, so no page and no link is taken twice.

Pages of a search come in order: within a micro-batch they are sorted, from batch to batch the source must deal them so (a
file a results page, as captured_pages() reads them). A page that comes again, or late, is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PAGES = "search_url string, page int, has_html boolean, links array<string>"
#: kind: link (a new one), page (a row for each page read; ended on the one that ends the search).
EVENTS = "search_url string, page int, kind string, pos int, url string, last_completed int, empty_in_a_row int, n_links long, ended boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Search(StatefulProcessor):
    def __init__(self, most: int = 2, ttl_ms: int | None = None):
        self.most, self.ttl_ms = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState("progress", "read int, completed int, empty int, taken long, ended boolean")
        self.seen = handle.getMapState("seen", "url string", "page int", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        read, completed, empty, taken, ended = self.progress.get() if self.progress.exists() else (None, None, 0, 0, False)
        out = []
        for _, page in pd.concat([*rows]).sort_values("page", kind="stable").iterrows():
            number = int(page["page"])
            if ended or (read is not None and number <= read):
                continue
            read = number
            links = [] if page["links"] is None else [u for u in dict.fromkeys(page["links"]) if u]
            empty = 0 if page["has_html"] and links else empty + 1
            ended = empty >= self.most
            if page["has_html"] and not ended:
                completed = number
            new = [(i, u) for i, u in enumerate(links) if page["has_html"] and not self.seen.containsKey((u,))]
            for i, u in new:
                self.seen.updateValue((u,), (number,))
                out.append((key[0], number, "link", i, u, completed, empty, taken + len(new), ended))
            taken += len(new)
            out.append((key[0], number, "page", None, None, completed, empty, taken, ended))
        self.progress.update((read, completed, empty, taken, ended))
        yield pd.DataFrame(out, columns=["search_url", "page", "kind", "pos", "url", "last_completed", "empty_in_a_row", "n_links", "ended"]).astype({"page": "Int32", "pos": "Int32", "last_completed": "Int32", "empty_in_a_row": "Int32", "n_links": "Int64", "ended": "boolean"})

    def close(self) -> None:
        pass


def captured_pages(spark: SparkSession, path: str, files: int = 1, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files).format(fmt).load(path)


def crawl(pages: DataFrame, most: int = 2, ttl_ms: int | None = None) -> DataFrame:
    """EVENTS of a stream of PAGES. The session's state store must keep several states a key: use_rocksdb()."""
    return pages.filter("page is not null and search_url is not null").groupBy("search_url").transformWithStateInPandas(Search(most, ttl_ms), EVENTS, "Append", "ProcessingTime" if ttl_ms else "None")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
