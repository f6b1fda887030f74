"""What near-duplicate operators share: banding, distributed union-find, and cells of candidates to verify.

Things to compare have a 64-bit id, a hash of their content, so equal things are one. A band's key joins
things whose MinHash values agree in a whole band: they share a bucket. No pairs are emitted: a bucket links its
members to its first one, and buckets that share a member join into a group of candidates. One rule decides which
pairs are looked at, whatever the size of a group: those that share a bucket.

A cell is one unit of work, and cells() deals the members out so that each such pair meets in one cell that answers for it:

* a group is cut into blocks of about BLOCK members; two blocks are a cell, so a member is in as many cells as there are
  blocks. That is the least work until there are more blocks than bands;
* of a group with more blocks than that each bucket of at most BLOCK members is a cell, so groups that chains of buckets
  make large cost as much as their buckets do: a member is in as many cells as there are bands at most;
* larger buckets of such a group are joined into groups again, which are cut into blocks. These are groups of things
  alike in a whole band, in most of which all pairs have to be looked at anyway.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcela.llm.common import discard, materialize, mixed

BANDS = "key long, id long, lead long"
BLOCK = 512


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """signatures: a row of uint64 for each thing. A row of band keys for each."""
    n, k = signatures.shape
    parts = signatures[:, : k - k % rows].reshape(n, -1, rows)
    out = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64) + np.uint64(1), parts.shape[:2]).copy()
    for i in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return out


def band_rows(ids: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """The rows of a task's things (distinct ids), settled as far as the task can: of the things with one
    key, one row goes on with the key, and the others are linked to it (lead) under a key of their own.
    So a key has a row from each batch at most."""
    key, item = keys.ravel(), np.repeat(ids, keys.shape[1])
    order = np.lexsort((item, key))
    key, item = key[order], item[order]
    new = np.r_[True, key[1:] != key[:-1]][: len(key)]
    head = item[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))] if len(key) else item
    links = np.unique(np.stack([item[~new], head[~new]], axis=1), axis=0) if (~new).any() else np.empty((0, 2), item.dtype)
    lead = pa.concat_arrays([pa.nulls(int(new.sum()), pa.int64()), pa.array(links[:, 1].view(np.int64))])
    out_key, out_id = np.r_[key[new], mixed(links[:, 0] ^ np.uint64(0x5851F42D4C957F2D))], np.r_[item[new], links[:, 0]]
    return pa.RecordBatch.from_arrays([pa.array(out_key.view(np.int64)), pa.array(out_id.view(np.int64)), lead], names=["key", "id", "lead"])


class Bands:
    """What a task has found so far, handed on FLUSH things at a time: so a key has a row for each FLUSH things of a
    task at most, and a task holds no more than that."""

    FLUSH = 200_000

    def __init__(self, width: int):
        self.width, self.seen, self.ids, self.keys = width, set(), [], []

    def add(self, ids: list[int], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        """ids that aren't in seen."""
        self.seen.update(ids)
        self.ids.append(np.array(ids, np.uint64))
        self.keys.append(keys)
        if len(self.seen) >= self.FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.seen:
            yield band_rows(np.concatenate(self.ids), np.concatenate(self.keys))
        self.seen, self.ids, self.keys = set(), [], []


def bucket_edges(bands: DataFrame) -> DataFrame:
    """a < b: each member of a bucket with the bucket's first; one pair may come from several buckets. A bucket has a row for each
    task's FLUSH members at most, as tasks settle what repeats within them: 50 000 narrow rows for ten thousand million members."""
    first = F.first("id").over(Window.partitionBy("key").orderBy("id"))
    linked = bands.withColumn("head", F.coalesce("lead", first)).filter("head <> id")
    return linked.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))


def is_settled(edges: DataFrame) -> bool:
    """Whether edges (u, v) are stars: no u has two edges, and none is the v of another."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below > 1 or below + above > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """id, comp (the least id) of every id in edges (a, b), by large and small stars in turn until only stars
    are left. Each step is written to the shared folder, and the tables of the step before are deleted. A node's least
    neighbour is pre-aggregated; written, it meets the edges in a join of two plain shuffles, of which Spark splits a
    node with very many edges. A node's one narrow row is the side to hash, so edges needn't be sorted."""
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while not is_settled(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least.hint("shuffle_hash"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        discard(now, least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least.hint("shuffle_hash"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(large, least)
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(roots.select("id", F.col("id").alias("comp")))


def blocks(members: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """members (comp, id and more) with cell, side and alone: a row for each two blocks of a group that the member's is
    one of. groups: comp, count, of those of more than a block at least."""
    out = members.join(groups, "comp", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int"))
    out = out.withColumn("side", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    out = out.withColumn("cell", F.xxhash64("comp", F.least("side", "other"), F.greatest("side", "other")))
    return out.withColumn("alone", F.col("side") == F.col("other")).drop("count", "blocks", "other", "comp")


#: What cells() adds to members. key: the bucket that the cell is; heavy: the member's buckets that are too large to be cells.
CELL = "cell long, side int, alone boolean, key long, heavy array<long>"


def cells(members: DataFrame, groups: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], bands: int, block: int | None = None) -> DataFrame:
    """members (id, comp and more; a row for each of groups: id, comp) with CELL: a row for each cell that it takes
    part in, and the rows of a cell together, in order of side and id. keys_of: members to rows of id, key, all of its
    buckets; asked only for groups of more blocks than bands. Where few groups have more than a block, Spark broadcasts them."""
    block = block or BLOCK
    none = {"key": F.lit(None).cast("long"), "heavy": F.lit(None).cast("array<long>")}
    large = materialize(groups.groupBy("comp").count().filter(F.col("count") > block), "large-groups")
    chained = large.filter(F.col("count") > block * bands)
    if chained.isEmpty():
        out = blocks(members, large, block).withColumns(none)
    else:
        chained = materialize(chained.select("comp"), "chained-groups")
        out = blocks(members.join(chained, "comp", "left_anti"), large, block).withColumns(none)
        many = members.join(chained, "comp").drop("comp")
        keys = materialize(many.mapInArrow(keys_of, "id long, key long"), "keys")
        counts = materialize(keys.groupBy("key").count().filter("count > 1"), "buckets")
        heavy = keys.join(counts.filter(F.col("count") > block).select("key"), "key")
        heads = heavy.groupBy("key").agg(F.min("id").alias("head"))
        joined = materialize(components(heavy.join(heads, "key").select(F.col("head").alias("a"), F.col("id").alias("b"))), "heavy-groups")
        own = materialize(heavy.groupBy("id").agg(F.collect_set("key").alias("heavy")), "heavy-keys")
        many = many.join(own, "id", "left")
        light = many.join(keys.join(counts.filter(F.col("count") <= block).select("key"), "key"), "id")
        light = light.withColumns({"cell": F.xxhash64("key"), "side": F.lit(0), "alone": F.lit(True)})
        dense = blocks(many.join(joined, "id"), joined.groupBy("comp").count(), block).withColumn("key", none["key"])
        out = out.unionByName(light).unionByName(dense)
    return out.repartition("cell").sortWithinPartitions("cell", "side", "id")


class Pairs:
    """Which pairs of a cell's members it answers for. keys: a row of band keys for each member."""

    def __init__(self, cell: pa.Table, keys: np.ndarray):
        self.keys, self.side, self.alone, self.key = keys, cell["side"].to_numpy(), cell["alone"][0].as_py(), cell["key"][0].as_py()
        self.heavy = None
        if cell["heavy"].null_count < len(cell):
            self.heavy = np.array([np.isin(row, np.array(h.as_py() or [], np.int64).view(np.uint64)) for row, h in zip(keys, cell["heavy"], strict=True)])

    def of(self, i: int) -> np.ndarray:
        """The members after i that share a bucket with it for which this cell answers."""
        common = self.keys[i + 1 :] == self.keys[i]
        near = common.any(axis=1)
        dense = (common & self.heavy[i]).any(axis=1) if self.heavy is not None else np.zeros(len(near), bool)
        if self.key is not None:
            # the first bucket that two members share answers for them, unless they share a heavy one
            near &= ~dense & (self.keys[i][common.argmax(axis=1)] == np.int64(self.key).view(np.uint64))
        else:
            near = dense if self.heavy is not None else near
            if not self.alone:
                near &= self.side[i + 1 :] != self.side[i]
        return np.flatnonzero(near) + i + 1


Prepared = tuple[np.ndarray, list]


def by_cell(prepare: Callable[[pa.RecordBatch], Prepared], work: Callable[[pa.Table, np.ndarray, list], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Calls work with all rows of each cell, their band keys and what else prepare() makes of each row, a batch at a
    time; a cell may go on in the next batch."""

    def whole(parts: list[tuple[pa.Table, np.ndarray, list]]) -> list[pa.RecordBatch]:
        if len(parts) == 1:
            done = work(*parts[0])
        else:
            tables, keys, items = zip(*parts, strict=True)
            done = work(pa.concat_tables(tables), np.concatenate(keys), [x for own in items for x in own])
        return [] if done is None else [done]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple[pa.Table, np.ndarray, list]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            got, cell, done = pa.Table.from_batches([batch]), batch["cell"].to_numpy(), []
            keys, items = prepare(batch)
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), len(cell)]
            if rest and rest[0][0]["cell"][0].as_py() != cell[0]:
                done += whole(rest)
                rest = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rest.append((got.slice(a, b - a), keys[a:b], items[a:b]))
                if b < len(cell):
                    done += whole(rest)
                    rest = []
            # most cells are small: what they give goes on together
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if rest:
            yield from whole(rest)

    return run


class Forest:
    """Union-find over the members of one cell."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def jaccard(a: frozenset, b: frozenset) -> float:
    common = len(a & b)
    return common / (len(a) + len(b) - common) if common else 0.0
