"""Substring dedup: a de Bruijn graph of word k-mers, compacted.

Edges are the windows of WINDOW words. As in compaction tools for large graphs, edges are dealt out by
minimizer (the least hash among the GRAM-word runs inside the window): neighbouring windows mostly share
theirs, so they travel together, and a window can only repeat if its minimizer does.

1. anchors(): minimizers of all texts are counted; those found once go, and with them most of the text.
2. windows(): the edges of the texts whose minimizers repeat, a row for each run of windows.
3. first_seen(): within a minimizer each edge gets its source, the earliest place where it starts. Windows
   next to each other whose sources are next to each other become one segment.
4. paths(): segments that follow each other both in their document and in their source, one after the
   other and without a branch, are found by a join and become one path; a path is a repeated span only as far as its source
   coordinates run along with its own.

Every window is judged on the input, by 128 bits of hash: the minimizer's and the edge's own.

The runs of a minimizer with more than HOT occurrences aren't gathered. Neighbouring hot runs make a chunk, which ends
where the next minimizer is a multiple of CHUNK, so that it depends on the words alone and texts that share a passage
share its chunks. Equal chunks are one with many places (hot_chunks()), equal runs of different chunks are one with the
earliest of their places (hot_runs()). A minimizer with few different runs is settled as in 3.; of one with more than HOT, each
edge's earliest place is found by an aggregation that combines before it shuffles. Runs get their sources as segments, not by
window, chunks get those of their runs, put together where they go on, and places those of their chunk, by joins that
Spark can split (hot_parts()). The sources are the same as in 3., the earliest places of all, so HOT changes no
result; and no task holds a group that grows with the input.

A null text has no words and nothing removed; nor does one of fewer than WINDOW words. A null doc_id orders
last. Rows with equal doc_id and text are one document and get the same result; rows with equal doc_id and
other text are told apart, and a window at the same place in both is not earlier in either. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcela.llm.common import SPACE, WordHashes, discard, documents, gram_hashes, materialize, n_words, order_id, text_key

WINDOW, GRAM, HOT, CHUNK = 20, 8, 4096, 32
ANCHORS = "m long, ord long, tkey long, n int"
WINDOWS = "m long, ord long, tkey long, start int, edges array<long>"
CHUNKS = "chunk long, chunk2 long, ord long, tkey long, start int, m array<long>, edge array<long>"
RUNS = "chunk long, chunk2 long, i int, m long, run long, ord long, tkey long, start int, edges array<long>"
SOURCES = "m long, run long, i int, n int, src_ord long, src_tkey long, src_start int"
#: A place, and the segments from there on: where (in windows after the place), how long, and their source.
PART = "struct<i: int, n: int, ord: bigint, tkey: bigint, start: int>"
PARTS = f"ord long, tkey long, start int, parts array<{PART}>"


def runs(tokens: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, first window and number of windows of each run of windows with one minimizer."""
    count, width = len(tokens) - window + 1, window - gram + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    least, size = gram_hashes(tokens, gram), 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:count], least[width - size : width - size + count])
    start = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return least[start], start, np.diff(np.r_[start, count])


def table(schema: str, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split(" ", 1) for f in schema.split(", ", 3 if schema is PARTS else -1)]
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[n], pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def joined(parts: list[np.ndarray], kind=np.int64) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *parts])


def minimizers(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct minimizers of a document, and how often each occurs in it as a run of words. One run of
    windows may hold one minimizer at several places, so runs themselves don't tell."""
    m, grams = np.unique(runs(tokens)[0]), np.sort(gram_hashes(tokens, GRAM))
    return m, np.searchsorted(grams, m, "right") - np.searchsorted(grams, m, "left")


def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        found = [minimizers(hashes.of(t.as_py())) for t in batch["text"]]
        each = [len(m) for m, _ in found]
        yield table(ANCHORS, m=joined([m for m, _ in found], np.uint64), n=joined([n for _, n in found]), **{c: np.repeat(batch[c].to_numpy(), each) for c in ("ord", "tkey")})


def segments_of(row: np.ndarray, start: np.ndarray, *source: np.ndarray) -> np.ndarray:
    """Where a new segment begins: another row, or a window or source that doesn't follow the last one's.
    source: ord, tkey, start."""
    if not len(row):
        return np.empty(0, np.int64)
    s_ord, s_key, s_start = source
    same = (row[1:] == row[:-1]) & (start[1:] == start[:-1] + 1) & (s_ord[1:] == s_ord[:-1]) & (s_key[1:] == s_key[:-1]) & (s_start[1:] == s_start[:-1] + 1)
    return np.flatnonzero(np.r_[True, ~same])


def earliest(order_by: list[np.ndarray], group_by: list[np.ndarray]) -> np.ndarray:
    """For each item the index of the first of its group; group_by and order_by as columns, the first counts most."""
    n = len(group_by[0])
    order = np.lexsort([*reversed(group_by + order_by)])
    new = np.zeros(n, bool)
    new[:1] = True
    for g in group_by:
        new[1:] |= g[order][1:] != g[order][:-1]
    first = np.empty(n, np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
    return first


def lists(sizes: list[int], values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(values.view(np.int64)))


def marked_runs(batch: pa.RecordBatch, hashes: WordHashes, hot: bool) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """Minimizer, ord, tkey, first window and edges of each run whose minimizer repeats and is hot, or isn't."""
    seen = set()
    for i, (text, marks) in enumerate(zip(batch["text"], batch["marks"], strict=True)):
        place = (batch["ord"][i].as_py(), batch["tkey"][i].as_py())
        if place in seen:
            continue
        seen.add(place)
        known = np.sort(np.array([x["m"] for x in marks.as_py() if x["hot"] == hot], np.int64).view(np.uint64))
        if not len(known):
            continue
        tokens = hashes.of(text.as_py())
        m, start, n = runs(tokens)
        edges = gram_hashes(tokens, WINDOW, seed=0xD6E8FEB86659FD93)
        kept = known[np.minimum(np.searchsorted(known, m), len(known) - 1)] == m
        for j in np.flatnonzero(kept):
            yield m[j], *place, start[j], edges[start[j] : start[j] + n[j]]


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WINDOWS: the runs of windows of the minimizers that aren't hot."""
    hashes = WordHashes()
    for batch in batches:
        found = [*marked_runs(batch, hashes, hot=False)]
        of = lambda k, kind=np.int64, found=found: np.array([x[k] for x in found], kind)
        yield table(WINDOWS, m=of(0, np.uint64), ord=of(1), tkey=of(2), start=of(3), edges=lists([len(x[4]) for x in found], joined([x[4] for x in found], np.uint64)))


def chunks_of(found: Iterator[tuple[int, int, int, int, np.ndarray]]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """ord, tkey, first window, and the minimizer and the edge of each window, of neighbouring runs."""
    own: list[tuple] = []
    for m, *place, start, edges in found:
        if own and ([*own[0][1:3]] != place or own[-1][3] + len(own[-1][4]) != start or not int(m) % CHUNK):
            yield chunk(own)
            own = []
        own.append((m, *place, start, edges))
    if own:
        yield chunk(own)


def chunk(own: list[tuple]) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    return *own[0][1:4], np.repeat(np.array([x[0] for x in own], np.uint64), [len(x[4]) for x in own]), np.concatenate([x[4] for x in own])


def hot_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CHUNKS: the windows of hot minimizers. Each batch gives the windows of a chunk once."""
    hashes = WordHashes()
    for batch in batches:
        found = [*chunks_of(marked_runs(batch, hashes, hot=True))]
        whole = [xxhash.xxh3_128_intdigest(m.tobytes() + e.tobytes()) for *_, m, e in found]
        first = np.zeros(len(found), bool)
        first[[*{w: i for i, w in reversed([*enumerate(whole)])}.values()]] = True
        of = lambda k, found=found: np.array([x[k] for x in found], np.int64)
        once = lambda k, found=found, first=first: pa.array([x[k].view(np.int64) if f else None for x, f in zip(found, first, strict=True)], pa.list_(pa.int64()))
        low, high = (np.array([w >> s & 0xFFFFFFFFFFFFFFFF for w in whole], np.uint64) for s in (0, 64))
        yield table(CHUNKS, chunk=low, chunk2=high, ord=of(0), tkey=of(1), start=of(2), m=once(3), edge=once(4))


def by_minimizer(batches: Iterator[pa.RecordBatch], settle) -> Iterator[pa.RecordBatch]:
    """settle of rows with equal minimizers together, at the ends of batches too."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        got = pa.Table.from_batches([batch])
        got = got if rest is None else pa.concat_tables([rest, got])
        key = got["m"].to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # the last minimizer may go on
        rest = got.slice(cut)
        if cut:
            yield settle(got.slice(0, cut).combine_chunks())
    if rest is not None:
        yield settle(rest.combine_chunks())


def first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of WINDOWS with equal minimizers together: PARTS, the segments that start earlier elsewhere."""
    return by_minimizer(batches, settled)


def first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SOURCES from different runs (WINDOWS with run) with equal minimizers together."""
    return by_minimizer(batches, run_sources)


def sources(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of rows of WINDOWS: its row, its place in the document, its place in the row, and the index of the window that is its source."""
    edges = rows["edges"].combine_chunks() if isinstance(rows["edges"], pa.ChunkedArray) else rows["edges"]
    size = pa.compute.list_value_length(edges).to_numpy()
    row = np.repeat(np.arange(len(size)), size)
    m, ords, keys, start = (rows[c].to_numpy()[row] for c in ("m", "ord", "tkey", "start"))
    i = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    start = start.astype(np.int64) + i
    return row, start, i, earliest([ords, start, keys], [m, edges.flatten().to_numpy()])


def settled(rows: pa.Table) -> pa.RecordBatch:
    keys = [rows[c].to_numpy() for c in ("m", "ord", "start", "tkey")]
    rows = rows.filter(pa.array(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])).combine_chunks()  # repeated rows
    row, start, i, first = sources(rows)
    ords, keys = (rows[c].to_numpy()[row] for c in ("ord", "tkey"))
    later = np.flatnonzero((ords[first] != ords) | (start[first] != start))
    s_ord, s_key, s_start = (x[first[later]] for x in (ords, keys, start))
    begin = segments_of(row[later], start[later], s_ord, s_key, s_start)
    n, head = np.diff(np.r_[begin, len(later)]), later[begin]
    of, count = np.unique(row[head], return_counts=True)
    parts = parts_of(np.cumsum(np.r_[0, count]), i[head], n, s_ord[begin], s_key[begin], s_start[begin])
    return table(PARTS, parts=parts, **{c: rows[c].to_numpy()[of] for c in ("ord", "tkey", "start")})


def parts_of(ends: np.ndarray, *columns: np.ndarray) -> pa.Array:
    """Lists of structs PART, from their columns and where the lists end."""
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["i", "n", "ord", "tkey", "start"]))


def run_sources(rows: pa.Table) -> pa.RecordBatch:
    row, start, i, first = sources(rows)
    ords, keys = (rows[c].to_numpy()[row] for c in ("ord", "tkey"))
    return in_segments(row, i, rows["m"].to_numpy()[row], rows["run"].to_numpy()[row], ords[first], keys[first], start[first])


def in_segments(row, i, m, run, *source) -> pa.RecordBatch:
    """SOURCES of the windows i of runs, in order within each, given each one's source (ord, tkey, start)."""
    begin = segments_of(row, i, *source)
    return table(SOURCES, m=m[begin], run=run[begin], i=i[begin], n=np.diff(np.r_[begin, len(row)]), src_ord=source[0][begin], src_tkey=source[1][begin], src_start=source[2][begin])


def hot_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RUNS of different chunks, each with its chunk's first place; the edges of equal runs once a batch."""
    for batch in batches:
        flat, size = batch["m"].flatten().to_numpy(), pa.compute.list_value_length(batch["m"]).to_numpy()
        edge, row = batch["edge"].flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
        begin = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (flat[1:] != flat[:-1])][: len(row)])
        ends = np.r_[begin[1:], len(row)]
        own = [edge[a:b] for a, b in zip(begin, ends, strict=False)]
        run, seen, lists_of = np.array([xxhash.xxh3_64_intdigest(e.tobytes()) for e in own], np.uint64), set(), []
        for key, e in zip(zip(flat[begin].tolist(), run.tolist(), strict=True), own, strict=True):
            lists_of.append(None if key in seen else e)
            seen.add(key)
        i, row = begin - (np.cumsum(size) - size)[row[begin]], row[begin]
        of = lambda c, batch=batch, row=row: batch[c].to_numpy()[row]
        yield table(RUNS, chunk=of("chunk"), chunk2=of("chunk2"), i=i, m=flat[begin], run=run, ord=of("ord"), tkey=of("tkey"), start=of("start") + i, edges=pa.array(lists_of, pa.list_(pa.int64())))


def window_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """m, run and sources (i, ord, tkey, start of each window) to SOURCES."""
    for batch in batches:
        flat, size = batch["sources"].flatten(), pa.compute.list_value_length(batch["sources"]).to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        i, *source = (x.to_numpy().astype(np.int64) for x in flat.flatten())
        yield in_segments(row, i, *(batch[c].to_numpy()[row] for c in ("m", "run")), *source)


def put_together(parts: Column) -> Column:
    """Segments (i, n, ord, tkey, start) of a chunk, in order: those that go on, in the chunk and in the source, are one."""

    @F.arrow_udf(f"array<{PART}>")
    def merged(column: pa.Array) -> pa.Array:
        size = pa.compute.list_value_length(column).to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        i, n, s_ord, s_key, s_start = (x.to_numpy().astype(np.int64) for x in column.flatten().flatten())
        same = (row[1:] == row[:-1]) & (i[1:] == i[:-1] + n[:-1]) & (s_ord[1:] == s_ord[:-1]) & (s_key[1:] == s_key[:-1]) & (s_start[1:] == s_start[:-1] + n[:-1])
        begin = np.flatnonzero(np.r_[True, ~same][: len(row)])
        total = np.add.reduceat(n, begin) if len(begin) else n
        return parts_of(np.r_[0, np.cumsum(np.bincount(row[begin], minlength=len(size)))], i[begin], total, s_ord[begin], s_key[begin], s_start[begin])

    return merged(parts)


def hot_parts(marked: DataFrame) -> DataFrame:
    """PARTS of the windows of hot minimizers. marked: ord, tkey, text, marks."""
    found = materialize(marked.filter(F.exists("marks", lambda x: x["hot"])).select("ord", "tkey", "text", "marks").mapInArrow(hot_chunks, CHUNKS), "hot-chunks")
    one, where = ["chunk", "chunk2"], F.min(F.struct("ord", "start", "tkey")).alias("first")
    content = F.first(F.when(F.col("edge").isNotNull(), F.struct("m", "edge")), ignorenulls=True).alias("own")
    chunks = found.groupBy(*one).agg(where, content).select(*one, "first.ord", "first.tkey", F.col("first.start").cast("int").alias("start"), "own.m", "own.edge")
    of_chunks = materialize(chunks.mapInArrow(hot_runs, RUNS), "hot-runs")
    runs_ = of_chunks.groupBy("m", "run").agg(where, F.first("edges", ignorenulls=True).alias("edges"))
    runs_ = materialize(runs_.select("m", "run", "first.ord", "first.tkey", "first.start", "edges"), "different-runs")
    many = runs_.groupBy("m").count().withColumn("many", F.col("count") > HOT).select("m", "many")
    runs_ = runs_.join(many, "m")
    few = runs_.filter(~F.col("many")).drop("many").repartition("m").sortWithinPartitions("m", "ord", "start", "tkey").mapInArrow(first_runs, SOURCES)
    windows_ = runs_.filter("many").select("m", "run", "ord", "tkey", "start", F.posexplode("edges").alias("i", "edge"))
    windows_ = windows_.select("m", "run", "i", "edge", F.struct("ord", (F.col("start") + F.col("i")).alias("start"), "tkey").alias("place"))
    first = windows_.groupBy("m", "edge").agg(F.min("place").alias("source"))
    each = windows_.join(first.hint("shuffle_hash"), ["m", "edge"]).groupBy("m", "run").agg(F.sort_array(F.collect_list(F.struct("i", "source.ord", "source.tkey", "source.start"))).alias("sources"))
    of_runs = materialize(few.union(each.mapInArrow(window_sources, SOURCES)), "hot-run-sources")
    parts = of_chunks.select(*one, F.col("i").alias("at"), "m", "run").join(of_runs, ["m", "run"])
    parts = parts.select(*one, F.struct((F.col("at") + F.col("i")).alias("i"), "n", F.col("src_ord").alias("ord"), F.col("src_tkey").alias("tkey"), F.col("src_start").alias("start")).alias("part"))
    own = parts.groupBy(*one).agg(F.sort_array(F.collect_list("part")).alias("parts")).select(*one, put_together(F.col("parts")).alias("parts"))
    own = materialize(own, "hot-chunk-sources")
    return found.select(*one, "ord", "tkey", "start").distinct().join(own.hint("shuffle_hash"), one).select("ord", "tkey", "start", "parts")


def segments_of_parts(parts: DataFrame) -> DataFrame:
    """ord, tkey, start, n, src_ord, src_tkey, src_start: a row for each segment that starts earlier elsewhere."""
    each = parts.select("ord", "tkey", "start", F.explode("parts").alias("s"))
    each = each.select("ord", "tkey", (F.col("start") + F.col("s.i")).alias("start"), "s.n", F.col("s.ord").alias("src_ord"), F.col("s.tkey").alias("src_tkey"), F.col("s.start").alias("src_start"))
    return each.filter((F.col("src_ord") != F.col("ord")) | (F.col("src_start") != F.col("start")))


def paths(segments: DataFrame) -> DataFrame:
    """ord, tkey, start, stop (windows), src_ord, src_start: segments compacted. A segment that no other one
    leads to, in the document and in the source, starts a path; the others go on with it."""
    where = ["ord", "tkey", "src_ord", "src_tkey", "start", "src_start"]
    ends = segments.select("ord", "tkey", "src_ord", "src_tkey", (F.col("start") + F.col("n")).alias("start"), (F.col("src_start") + F.col("n")).alias("src_start")).distinct()
    linked = segments.join(ends.withColumn("led", F.lit(1)), where, "left")
    along = Window.partitionBy("ord", "tkey").orderBy("start", "src_ord", "src_start").rowsBetween(Window.unboundedPreceding, 0)
    numbered = linked.withColumn("path", F.sum(F.when(F.col("led").isNull(), 1).otherwise(0)).over(along))
    return numbered.groupBy("ord", "tkey", "path").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("stop"), F.min("src_ord").alias("src_ord"), F.min("src_start").alias("src_start"))


def without(text: Column, spans: Column) -> Column:
    """struct<n_removed, kept>: the text without the words of the windows in spans (array of start, stop)."""

    @F.arrow_udf("n_removed long, kept string")
    def cut_words(texts: pa.Array, spans: pa.Array) -> pa.Array:
        removed, kept = [], []
        for text, span in zip(texts, spans, strict=True):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            depth = np.zeros(len(words) + 1, np.int64)
            for s in span.as_py() or ():
                depth[s["start"]] += 1
                depth[min(s["stop"] + WINDOW - 1, len(words))] -= 1
            stays = np.cumsum(depth)[:-1] == 0
            removed.append(len(words) - int(stays.sum()))
            kept.append(b" ".join([w for w, k in zip(words, stays, strict=True) if k]).decode("utf-8", "replace"))
        return pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["n_removed", "kept"])

    return cut_words(text, spans)


def dedup(docs: DataFrame, whole: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, spans (array of start, stop, src_ord, src_start; windows), and kept, the
    words that stay, joined by one space; if not whole, kept_sha256 in its place."""
    docs = docs.select("doc_id", "text").withColumns({"ord": order_id(F.col("doc_id")), "tkey": text_key(F.col("text"))})
    # written: the minimizers of a text cost more to find than to read again
    found = materialize(docs.select("ord", "tkey", "text").mapInArrow(anchors, ANCHORS), "anchors")
    counts = found.groupBy("m").agg(F.sum("n").alias("total")).filter("total > 1")
    marks = found.select("m", "ord", "tkey").join(counts, "m").groupBy("ord", "tkey").agg(F.collect_set(F.struct("m", (F.col("total") > HOT).alias("hot"))).alias("marks"))
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.trim(F.regexp_replace(text, rf"[{SPACE}]+", " "))
    # what stays of a text without repeated minimizers is known here; only the others' texts go on
    pending = F.col("marks").isNotNull()
    docs = docs.join(marks, ["ord", "tkey"], "left").select("doc_id", "ord", "tkey", "marks", n_words(text).alias("n_words"), F.when(pending, text).alias("text"), F.when(~pending, plain if whole else F.sha2(plain.cast("binary"), 256)).alias("done"))
    docs = materialize(docs, "marked")
    discard(found)
    marked = docs.filter(pending)
    rows = marked.select("ord", "tkey", "text", "marks").mapInArrow(windows, WINDOWS)
    parts = rows.repartition("m").sortWithinPartitions("m", "ord", "start", "tkey").mapInArrow(first_seen, PARTS)
    if not marked.filter(F.exists("marks", lambda x: x["hot"])).isEmpty():
        parts = parts.union(hot_parts(marked))
    segments = materialize(segments_of_parts(parts), "segments")
    spans = paths(segments).groupBy("ord", "tkey").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "src_ord", "src_start"))).alias("spans"))
    docs = docs.join(spans, ["ord", "tkey"], "left").withColumn("cut", F.when(pending, without(F.col("text"), F.col("spans"))))
    kept = F.coalesce(F.col("cut.kept"), F.col("done")) if whole else F.coalesce(F.sha2(F.col("cut.kept").cast("binary"), 256), F.col("done"))
    return docs.select("doc_id", "n_words", F.coalesce(F.col("cut.n_removed"), F.lit(0)).cast("long").alias("n_removed"), "spans", kept.alias("kept" if whole else "kept_sha256"))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the number of repeated spans, of every document."""
    out = dedup(documents(spark, sf_dir), whole=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", F.coalesce(F.array_size("spans"), F.lit(0)).cast("long").alias("n_spans"))
