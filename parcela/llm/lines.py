"""Line dedup: fuzzy lines by MinHash, one line kept of each component.

Lines end at \\n; a line without a word is left alone. A line's shingles are its runs of SHINGLE
characters (a shorter line is one shingle). One-permutation MinHash fills a bin for each signature place,
empty bins borrowing from the next one; bands of ROWS values find candidates (at similarity 0.8 all but
0.2 % of pairs, at 0.9 all but one in 10 000), exact Jaccard similarity of at least THRESHOLD verifies them,
and union-find joins verified and equal lines. Of a component the first line stays: least doc_id, then
least line number.

A null text has no lines. A null doc_id orders last. Rows equal in doc_id and text are one document; an empty
table gives an empty result. Equal lines are one thing from the start, so ties and thousands of copies cost a row each.
Only doc_id and text are read; a stage's other columns are carried, those whose names begin with _ln_ apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.llm.common import documents, gram_hashes, materialize, mixed, order_id, text_key
from parcela.llm.neardup import BANDS, Bands, Forest, Pairs, band_keys, bucket_edges, by_cell, cells, components

SHINGLE, THRESHOLD, N_BANDS, ROWS = 9, 0.8, 12, 4
#: Characters hashed at once; the arrays then fit a core's cache.
CHUNK_CHARS = 100_000
#: Lines that one is compared with at once.
AT_ONCE = 64
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """Numbers and texts of the lines with a word."""
    return [(i, x) for i, x in enumerate((text or "").split("\n")) if x.strip(" \t\n\x0b\f\r")]


def line_ids(line: str) -> tuple[int, int]:
    """128 bits of hash: by the first 64 lines are compared, by all of them they are told apart."""
    whole = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    return whole & 0xFFFFFFFFFFFFFFFF, whole >> 64


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all lines, and the line of each."""
    size = np.array([len(x) for x in lines], np.int64)
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = np.cumsum(size)
    # a run of characters that begins in the last ones of a line would go on in the next
    whole = np.ones(len(chars), bool)
    whole[np.maximum(end[:, None] - np.arange(1, SHINGLE), (end - size)[:, None]).ravel()] = False
    short = np.flatnonzero(size < SHINGLE)
    ids = np.array([line_ids(lines[i])[0] for i in short], np.uint64)
    runs = gram_hashes(chars, SHINGLE)
    return np.r_[runs[whole[: len(runs)]], ids], np.r_[np.repeat(np.arange(len(lines)), np.maximum(size - SHINGLE + 1, 0)), short]


def signatures(hashes: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """One-permutation MinHash of n things: a row of k values for each."""
    flat = np.full(n * k, NONE)
    bins = ((hashes >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
    np.minimum.at(flat, owner * k + bins.astype(np.int64), hashes)
    out = flat.reshape(n, k)
    # few things have a bin without a hash
    rows = np.flatnonzero((out == NONE).any(axis=1))
    some = out[rows]
    place = np.where(np.concatenate([some, some], axis=1) != NONE, np.arange(2 * k), 4 * k)
    after = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :k]
    empty = after != np.arange(k)
    far = (after - np.arange(k)).astype(np.uint64)
    borrowed = np.take_along_axis(some, np.minimum(after, 2 * k - 1) % k, axis=1)
    out[rows] = np.where(empty, mixed(borrowed + far * np.uint64(0xD6E8FEB86659FD93)), some)
    return out


def parts_of(lines: list[str]) -> Iterator[list[str]]:
    """Lines, so many at once as fit the cache."""
    part, size = [], 0
    for x in lines:
        part.append(x)
        size += len(x)
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def line_keys(lines: list[str]) -> np.ndarray:
    """The band keys of lines."""
    keys = [band_keys(signatures(*shingle_hashes(part), len(part), N_BANDS * ROWS), ROWS) for part in parts_of(lines)]
    return np.concatenate([np.empty((0, N_BANDS), np.uint64), *keys])


def distinct_lines(texts: pa.Array) -> dict[tuple[int, int], str]:
    return {line_ids(x): x for t in texts for _, x in lines_of(t.as_py())}


def longs(values: Sequence[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, id2, ord, tkey, line of every line."""
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        found = [lines_of(t.as_py()) for t in batch["text"]]
        each = [len(x) for x in found]
        # the bits of line_ids(), the higher ones first
        ids = np.frombuffer(b"".join(digest(x.encode("utf-8", "surrogatepass")) for ls in found for _, x in ls), ">i8").reshape(-1, 2).astype(np.int64)
        at = np.array([i for ls in found for i, _ in ls], np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(ids[:, 1]), pa.array(ids[:, 0]), *(pa.array(np.repeat(batch[c].to_numpy(), each)) for c in ("ord", "tkey")), pa.array(at)], names=["id", "id2", "ord", "tkey", "line"])


def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = Bands(N_BANDS)
    for batch in batches:
        own = {i: x for (i, _), x in distinct_lines(batch["text"]).items() if i not in found.seen}
        yield from found.add([*own], line_keys([*own.values()]))
    yield from found.flush()


def line_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, id2, value of the lines of each batch."""
    for batch in batches:
        own = distinct_lines(batch["text"])
        yield pa.RecordBatch.from_arrays([longs([a for a, _ in own]), longs([b for _, b in own]), pa.array([*own.values()], pa.string())], names=["id", "id2", "value"])


def member_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, key of lines (id, value)."""
    for batch in batches:
        keys = line_keys(batch["value"].to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch["id"].to_numpy(), N_BANDS)), pa.array(keys.ravel().view(np.int64))], names=["id", "key"])


EDGES = "a long, a2 long, b long, b2 long"


def prepared(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """The band keys and the shingle hashes of lines (value)."""
    keys, sets = [], []
    for part in parts_of(batch["value"].to_pylist()):
        hashes, owner = shingle_hashes(part)
        keys.append(band_keys(signatures(hashes, owner, len(part), N_BANDS * ROWS), ROWS))
        order = np.argsort(owner, kind="stable")
        sets += np.split(hashes[order], np.cumsum(np.bincount(owner, minlength=len(part)))[:-1])
    return np.concatenate(keys), sets


def distinct_sorted(hashes: np.ndarray) -> np.ndarray:
    out = np.sort(hashes)
    new = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out if new.all() else out[new]


def similarities(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of a set to each of some (sorted, distinct values; none is empty)."""
    values = np.concatenate(others) if len(others) > 1 else others[0]
    at = one.searchsorted(values)
    at[at == len(one)] = 0
    found = one[at] == values
    size = np.array([*map(len, others)])
    common = np.add.reduceat(found, size.cumsum() - size, dtype=np.int64)
    return common / (len(one) + size - common)


def verified(cell: pa.Table, keys: np.ndarray, hashes: list[np.ndarray]) -> pa.RecordBatch | None:
    """EDGES: enough pairs of the cell that share a bucket and are similar to connect all that are."""
    if len(hashes) < 2:
        return None
    pairs, sets = Pairs(cell, keys), [*map(distinct_sorted, hashes)]
    size = np.array([len(x) for x in sets])
    forest, found = Forest(len(sets)), []
    for i in range(len(sets) - 1):
        near = pairs.of(i)
        near = near[np.minimum(size[near], size[i]) >= THRESHOLD * np.maximum(size[near], size[i])]
        for part in range(0, len(near), AT_ONCE):
            # those that i has been joined with meanwhile need no look
            some = [j for j in near[part : part + AT_ONCE].tolist() if forest.root(i) != forest.root(j)]
            if some:
                alike = similarities(sets[i], [sets[j] for j in some]) >= THRESHOLD
                found += [(i, j) for j, same in zip(some, alike.tolist(), strict=True) if same and forest.join(i, j)]
    if not found:
        return None
    ids, more = cell["id"].to_numpy(), cell["id2"].to_numpy()
    a, b = np.array(found).T
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[a], more[a], ids[b], more[b])], names=["a", "a2", "b", "b2"])


def line_components(docs: DataFrame) -> DataFrame:
    """id, id2, comp of the lines that are similar to another one. docs: text."""
    groups = components(bucket_edges(docs.select("text").mapInArrow(bands, BANDS)))
    texts = docs.select("text").mapInArrow(line_texts, "id long, id2 long, value string")
    # groups have one narrow row an id: hashed, they spare sorting the texts
    members = texts.join(groups.hint("shuffle_hash"), "id").groupBy("id", "id2", "comp").agg(F.min("value").alias("value"))
    edges = materialize(cells(members, groups, member_keys, N_BANDS).mapInArrow(by_cell(prepared, verified), EDGES), "similar")
    ids = edges.select(F.col("a").alias("id"), F.col("a2").alias("id2")).union(edges.select("b", "b2")).distinct()
    return components(edges.select("a", "b")).join(ids, "id")


def removed_lines(docs: DataFrame) -> DataFrame:
    """ord, tkey, n_lines, removed (line numbers, from 0) of every document with lines."""
    groups = line_components(docs)
    found = docs.select("ord", "tkey", "text").mapInArrow(places, "id long, id2 long, ord long, tkey long, line int")
    found = found.join(groups.hint("shuffle_hash"), ["id", "id2"], "left")
    # a line that is like no other is its own component, known by all its bits
    found = found.select(F.coalesce("comp", "id").alias("comp"), F.when(F.col("comp").isNull(), F.col("id2")).otherwise(0).alias("comp2"), "ord", "tkey", "line")
    # written, so that the join below reads two plain shuffles, of which Spark can split a hot component's rows
    first = materialize(found.groupBy("comp", "comp2").agg(F.min(F.struct("ord", "line", "tkey")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "firsts")
    found = found.join(first.hint("shuffle_hash"), ["comp", "comp2"], "left").withColumn("again", F.coalesce(F.struct("ord", "line", "tkey") != F.col("first"), F.lit(False)))
    return found.groupBy("ord", "tkey").agg(F.count_distinct("line").alias("n_lines"), F.sort_array(F.collect_set(F.when(F.col("again"), F.col("line")))).alias("removed"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").withColumns({"ord": order_id(F.col("doc_id")), "tkey": text_key(F.col("text"))})


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines of these numbers; a null text stays null."""

    @F.arrow_udf("string")
    def cut_lines(texts: pa.Array, removed: pa.Array) -> pa.Array:
        out = []
        for text, numbers in zip(texts, removed, strict=True):
            gone = set(numbers.as_py() or ())
            out.append(text.as_py() if not gone or not text.is_valid else "\n".join(x for i, x in enumerate(text.as_py().split("\n")) if i not in gone))
        return pa.array(out, pa.string())

    return cut_lines(text, removed)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each with the lines that stay. No document goes, not even one without lines left."""
    gone = removed_lines(keyed(docs)).filter(F.size("removed") > 0).select(F.col("ord").alias("_ln_o"), F.col("tkey").alias("_ln_k"), F.col("removed").alias("_ln_removed"))
    out = docs.join(gone, (order_id(F.col("doc_id")) == F.col("_ln_o")) & (text_key(F.col("text")) == F.col("_ln_k")), "left")
    cut = out.withColumn("text", without_lines(F.col("text"), F.col("_ln_removed")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("_ln_removed").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return cut.select(*docs.columns)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed and the numbers of the lines removed, of every document."""
    docs = keyed(documents(spark, sf_dir))
    out = docs.select("doc_id", "ord", "tkey").join(removed_lines(docs), ["ord", "tkey"], "left")
    none = F.array().cast("array<int>")
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", none).alias("removed"))
