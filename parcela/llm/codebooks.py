"""Product codes of vectors: integer k-means in each part, with nearest entries found through segment-mean lower bounds.

Components become integers floor(scale * x); a vector is cut into equal parts, and each part has a codebook of its own. For each
part of a vector, entries are filtered coarse to fine: a block of components with mean m and residual norm r is at
least width * (m - m')^2 + (r - r')^2 away from an entry's block with m' and r', so sums over few wide blocks, then over more narrow ones, are
lower bounds of the squared distance. Entries whose bound exceeds the distance to one entry already measured can't be
nearest; the others are measured exactly, in integers. Bounds are lowered by more than what doubles round, so that
none is lost, ties included; ties go to the lower index.

Vectors are written once as integers. Each round is a pass over them: codebooks (of at most `entries` vectors' size, whatever the number of
rows) travel with the tasks, and sums of parts by entry are pre-aggregated in a task and then by Spark.

Rows whose vector is null, empty, holds a null or a component that isn't finite, or is of another length than the first kept vector by
vec_id, are left out. If the length isn't a multiple of the parts, zeros fill the last one. Fewer rows than
entries give fewer entries. vec_ids order with null last; equal ids by their components. Repeated rows count as often as they
occur. An empty table gives no rows. Components too large for exact distances in 64 bits (about 260 000 for 64 of them) are an error. vectors must have vec_id, embedding and label; other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcela.llm.common import materialize

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors compared at once: so many times entries are as many bounds in memory.
STEP = 2048
#: Squared distances stay below this, and so are exact in 64 bits.
MOST = 1 << 62


def blocks_of(width: int) -> list[int]:
    """Widths of blocks, coarse to fine: the whole part, then a quarter of it."""
    return [width] + [max(1, width // 4)] * (width >= 8)


def summary(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and residual norms of the blocks of each row of x, each times the square root of what it counts for; the last block may be narrower."""
    starts = np.arange(0, x.shape[1], width)
    sizes = np.diff(np.r_[starts, x.shape[1]])
    sums, squares = np.add.reduceat(x, starts, axis=1), np.add.reduceat(x * x, starts, axis=1)
    return sums / np.sqrt(sizes), np.sqrt(np.maximum(squares - sums * sums / sizes, 0))


class Codebook:
    """Entries (integers) of one part."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.wide = entries, entries.astype(np.float64)
        self.levels = [(w, *summary(self.wide, w)) for w in blocks_of(entries.shape[1])]
        self.norm = float(np.sqrt((self.wide * self.wide).sum(axis=1)).max(initial=0))
        self.kept = self.asked = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry to each row of x (integers)."""
        found = [self.nearest_of(x[i : i + STEP]) for i in range(0, len(x), STEP)]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2

    def nearest_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = x.astype(np.float64)
        # what rounding may add to a bound: far more than doubles lose on numbers of this size
        slack = 1e-9 * (np.sqrt((wide * wide).sum(axis=1)) + self.norm + 1) ** 2
        (_, mean, rest), *finer = self.levels
        own_mean, own_rest = summary(wide, self.levels[0][0])
        bound = sum((own[:, b, None] - theirs[None, :, b]) ** 2 for own, theirs in ((own_mean, mean), (own_rest, rest)) for b in range(theirs.shape[1]))
        most = self.distance(x, bound.argmin(axis=1))
        row, entry = np.nonzero(bound <= (most + slack)[:, None])
        for width, mean, rest in finer:
            own_mean, own_rest = summary(wide, width)
            bound = ((own_mean[row] - mean[entry]) ** 2).sum(axis=1) + ((own_rest[row] - rest[entry]) ** 2).sum(axis=1)
            left = bound <= (most + slack)[row]
            row, entry = row[left], entry[left]
        self.kept, self.asked = self.kept + len(row), self.asked + len(x) * len(self.entries)
        far = self.distance(x[row], entry)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(far, first)
        hit = np.flatnonzero(far == np.repeat(least, np.diff(np.r_[first, len(row)])))
        # rows come in order, and the entries of a row in order: its first hit is the lowest index
        return entry[hit[np.searchsorted(row[hit], np.arange(len(x)))]], least

    def distance(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        off = x - self.entries[entry]
        return (off * off).sum(axis=1)


def integers(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """vec_id, label and v (array<long>, as long as all parts together) of the rows that are kept."""
    x = F.col("embedding")
    kept = vectors.select("vec_id", "label", x).filter(x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))))
    kept = kept.select("vec_id", "label", F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))
    kept = materialize(kept, "vectors")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    n = first["n"] if first else parts
    most = math.isqrt(MOST // (4 * n))
    if kept.filter(F.exists("v", lambda c: F.abs(c) > most)).head(1):
        raise ValueError(f"components times scale must not exceed {most}")
    return kept.filter(F.size("v") == n).withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), -n % parts)))


def first_codebooks(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(part, entry, place): the vectors of the smallest ids, at most `entries` of them."""
    rows = [r["v"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    return np.array(rows, np.int64).reshape(len(rows), parts, len(rows[0]) // parts if rows else 0).transpose(1, 0, 2)


def vectors_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def updated(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry the floored mean of the parts that are nearest to it, or as it was if none is."""
    parts, _, width = books.shape

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in books]
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            x = vectors_of(batch.column(0)).reshape(batch.num_rows, parts, width)
            for p, book in enumerate(own):
                entry, _ = book.nearest(x[:, p])
                np.add.at(sums[p], entry, x[:, p])
                counts[p] += np.bincount(entry, minlength=len(book.entries))
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    tasks = kept.select("v").mapInArrow(assigned, "part long, entry long, n long, sums array<bigint>")
    # one row an entry comes to the driver; tasks' sums are added before the shuffle
    found = tasks.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]).collect()
    books = books.copy()
    for r in found:
        books[r["part"], r["entry"]] = np.array([r[f"s{i}"] for i in range(width)], np.int64) // r["n"]
    return books


def coded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """kept with entries (array<int>, one a part) and error."""
    parts, _, width = books.shape

    @F.arrow_udf("entries array<int>, error long")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = [Codebook(b) for b in books]
        for batch in batches:
            x = vectors_of(batch).reshape(len(batch), parts, width)
            found = [book.nearest(x[:, p]) for p, book in enumerate(own)]
            entry, error = np.stack([e for e, _ in found], axis=1), sum(d for _, d in found)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * parts, pa.int32()), pa.array(entry.astype(np.int32).ravel()))
            yield pa.StructArray.from_arrays([lists, pa.array(error)], ["entries", "error"])

    return kept.withColumn("code", encode("v")).select("vec_id", "label", "code.entries", "code.error")


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, entries and error of the vectors that are kept, and the codebooks (part, entry, place)."""
    kept = integers(vectors, scale, parts)
    books = first_codebooks(kept, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = updated(kept, books)
    if not books.size:
        return kept.select("vec_id", "label", F.lit(None).cast("array<int>").alias("entries"), F.lit(None).cast("long").alias("error")), books
    return coded(kept, books), books


def decoded(entries: list[int], books: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for; components are the middles of what floor() takes together."""
    return (np.concatenate([b[e] for b, e in zip(books, entries, strict=True)]) + 0.5) / scale


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that is kept."""
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    codes = materialize(codes, "codes")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    # summed by label before the shuffle; Spark broadcasts the sums where it finds them small, and splits large labels where not
    errors = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    code = F.lower(F.array_join(F.transform("entries", lambda e: F.lpad(F.hex(e), 2, "0")), ""))
    return codes.join(errors, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
