"""N-gram Jaccard join: documents whose word-shingle sets have a Jaccard similarity of THRESHOLD or more.

Shingles are runs of SHINGLE words (a document with fewer words is one shingle, so those without any are
alike). Documents with equal sets are one class from the start. Pairs that share a MinHash band are candidates (at
similarity 0.8 all but one pair in 20 000), in groups of any size. Candidates' MinHash values are then compared STEP at a time: with
m of n equal, the similarity has a Beta(m + 1, n - m + 1) posterior, and a pair goes when its probability of
reaching the threshold falls below TOLERANCE. What is left is verified exactly on the whole sets.

Each document gets the id of its class, the least doc_id that a chain of links leads to, and the number of
other documents linked to it directly. A null text has no words. A null doc_id orders last. Rows equal in
doc_id and text are one document. An empty table gives an empty result. Only doc_id and text are read; the stage carries other
columns, but for _nj_o and _nj_k, which are the operator's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcela.llm.common import LAST_ID, WordHashes, documents, gram_hashes, materialize, mixed, order_id, text_key
from parcela.llm.neardup import BANDS, Bands, Forest, Pairs, band_keys, bucket_edges, by_cell, cells, components

SHINGLE, THRESHOLD, HASHES, ROWS = 5, 0.8, 125, 5
N_BANDS = HASHES // ROWS
STEP, TOLERANCE = 25, 1e-5


def shingles(tokens: np.ndarray) -> np.ndarray:
    """The distinct shingle hashes, in order; never none: no words are one empty shingle."""
    return np.unique(gram_hashes(tokens, min(SHINGLE, len(tokens)))) if len(tokens) else np.zeros(1, np.uint64)


@lru_cache(maxsize=1)
def seeds() -> np.ndarray:
    return mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(own: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of a set of hashes."""
    out = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(own), 2048):
        out = np.minimum(out, (own[a : a + 2048, None] * seeds()).min(axis=0))
    return out


@lru_cache(maxsize=1)
def least_matches() -> dict[int, int]:
    """For each number of values compared, how many must be equal for a pair to stay."""
    grid = np.linspace(0, 1, 20001)[1:-1]
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        out[n] = n + 1
        for m in range(n, -1, -1):
            density = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(density - density.max())
            if density[grid >= THRESHOLD].sum() / density.sum() < TOLERANCE:
                break
            out[n] = m
    return out


def set_ids(own: np.ndarray) -> tuple[int, int]:
    """128 bits of hash: by the first 64 sets are compared, by all of them they are told apart."""
    whole = xxhash.xxh3_128_intdigest(own.tobytes())
    return whole & 0xFFFFFFFFFFFFFFFF, whole >> 64


def longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ord, tkey, id, id2 of every document."""
    hashes = WordHashes()
    for batch in batches:
        ids = [set_ids(shingles(hashes.of(t.as_py()))) for t in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["ord"], batch["tkey"], longs([a for a, _ in ids]), longs([b for _, b in ids])], names=["ord", "tkey", "id", "id2"])


def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, found = WordHashes(), Bands(N_BANDS)
    for batch in batches:
        own: dict[int, np.ndarray] = {}
        for t in batch["text"]:
            x = shingles(hashes.of(t.as_py()))
            i, _ = set_ids(x)
            if i not in own and i not in found.seen:
                own[i] = signature(x)
        yield from found.add([*own], band_keys(np.array([*own.values()], np.uint64).reshape(-1, HASHES), ROWS))
    yield from found.flush()


def member_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, key of documents (id, value)."""
    hashes = WordHashes()
    for batch in batches:
        signs = [signature(shingles(hashes.of(t.as_py()))) for t in batch["value"]]
        keys = band_keys(np.array(signs, np.uint64).reshape(-1, HASHES), ROWS)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch["id"].to_numpy(), N_BANDS)), pa.array(keys.ravel().view(np.int64))], names=["id", "key"])


LINKS = "a long, a2 long, b long, links long"


def prepared(batch: pa.RecordBatch) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The band keys, and the shingles and MinHash values, of documents (value)."""
    hashes = WordHashes()
    sets = [shingles(hashes.of(t.as_py())) for t in batch["value"]]
    signs = np.array([signature(x) for x in sets])
    return band_keys(signs, ROWS), [*zip(sets, signs, strict=True)]


def linked(cell: pa.Table, keys: np.ndarray, own: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
    """Of the similar pairs of a cell: (id, id2, null, documents linked) of each member, and enough pairs
    (a, null, b, null) to connect all that are linked."""
    ids, more, weight = (cell[c].to_numpy() for c in ("id", "id2", "weight"))
    n = len(ids)
    if n < 2:
        return None
    need, near = least_matches(), Pairs(cell, keys)
    sets, signs = [x for x, _ in own], np.array([x for _, x in own])
    size = np.array([len(x) for x in sets])
    links, forest, pairs = np.zeros(n, np.int64), Forest(n), []
    known: dict[int, frozenset] = {}
    for i in range(n - 1):
        left = near.of(i)
        equal, compared = np.zeros(len(left), np.int64), 0
        for a in range(0, HASHES, STEP):
            if not len(left):
                break
            equal += (signs[left, a : a + STEP] == signs[i, a : a + STEP]).sum(axis=1)
            compared += STEP
            stay = equal >= need[compared]
            left, equal = left[stay], equal[stay]
        for j in left:
            for k in (i, j):
                if k not in known:
                    known[k] = frozenset(sets[k].tolist())
            common = len(known[i] & known[j])
            if common >= THRESHOLD * (size[i] + size[j] - common):
                links[i] += weight[j]
                links[j] += weight[i]
                if forest.join(i, int(j)):
                    pairs.append((ids[i], ids[j]))
    has = links > 0
    if not has.any():
        return None
    p = np.array(pairs, np.int64).reshape(-1, 2)
    none = lambda k: pa.nulls(k, pa.int64())
    n_has, n_pairs = int(has.sum()), len(p)
    columns = [
        pa.array(np.r_[ids[has], p[:, 0]]), pa.concat_arrays([pa.array(more[has]), none(n_pairs)]),
        pa.concat_arrays([none(n_has), pa.array(p[:, 1])]), pa.concat_arrays([pa.array(links[has]), none(n_pairs)]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["a", "a2", "b", "links"])


def joined(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with ord, tkey, class_ord, class_tkey and n_links, without the text."""
    docs = docs.select("doc_id", "text").withColumns({"ord": order_id(F.col("doc_id")), "tkey": text_key(F.col("text"))})
    own = materialize(docs.select("ord", "tkey", "text").mapInArrow(classes, "ord long, tkey long, id long, id2 long").distinct(), "classes")
    groups = components(bucket_edges(docs.select("text").mapInArrow(bands, BANDS)))
    sets = own.groupBy("id", "id2").agg(F.count("*").alias("weight"), F.min(F.struct("ord", "tkey")).alias("first"))
    chosen = sets.join(groups, "id").select("id", "id2", "comp", "weight", "first.ord", "first.tkey")
    # one text for each set, however many documents have it
    members = chosen.join(docs.select("ord", "tkey", F.col("text").alias("value")), ["ord", "tkey"]).dropDuplicates(["ord", "tkey"]).select("id", "id2", "comp", "weight", "value")
    found = materialize(cells(members, groups, member_keys, N_BANDS).mapInArrow(by_cell(prepared, linked), LINKS), "links")
    links = found.filter("links is not null").groupBy(F.col("a").alias("id"), F.col("a2").alias("id2")).agg(F.sum("links").alias("links"))
    comps = components(found.filter("b is not null").select("a", "b"))
    # a set without links is its own class, known by all its bits
    sets = sets.join(links.join(comps, "id"), ["id", "id2"], "left")
    sets = sets.select("id", "id2", F.coalesce("comp", "id").alias("comp"), F.when(F.col("comp").isNull(), F.col("id2")).otherwise(0).alias("comp2"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "first")
    heads = sets.groupBy("comp", "comp2").agg(F.min("first").alias("head"))
    sets = sets.join(heads, ["comp", "comp2"]).select("id", "id2", "n_links", F.col("head.ord").alias("class_ord"), F.col("head.tkey").alias("class_tkey"))
    own = own.join(sets, ["id", "id2"]).select("ord", "tkey", "class_ord", "class_tkey", "n_links")
    out = docs.select("doc_id", "ord", "tkey").join(own, ["ord", "tkey"], "left")
    return out.select("doc_id", "ord", "tkey", F.coalesce("class_ord", "ord").alias("class_ord"), F.coalesce("class_tkey", "tkey").alias("class_tkey"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class (least doc_id), with its columns."""
    kept = joined(docs).filter("ord = class_ord and tkey = class_tkey").select(F.col("ord").alias("_nj_o"), F.col("tkey").alias("_nj_k")).distinct()
    keyed = docs.withColumns({"_nj_o": order_id(F.col("doc_id")), "_nj_k": text_key(F.col("text"))})
    return keyed.join(kept, ["_nj_o", "_nj_k"]).dropDuplicates(["_nj_o", "_nj_k"]).select(*docs.columns)


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, class_id and n_links of every document."""
    out = joined(documents(spark, sf_dir))
    return out.select("doc_id", F.when(F.col("class_ord") != LAST_ID, F.col("class_ord")).alias("class_id"), "n_links")
