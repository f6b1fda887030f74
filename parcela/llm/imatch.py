"""Document fingerprints: I-Match over randomised lexicon subsets.

The lexicon is the terms whose document frequency lies within a band (LOW to HIGH of all documents, that is
an inverse document frequency of ln(1 / HIGH) to ln(1 / LOW)). As each document has so many distinct terms
on average, at most average / LOW terms can be in the band, however many documents there are. A lexicon of
up to BROADCAST terms is sent to every task; a larger one is joined with the documents' terms. The
fingerprints are the same either way.

A document's distinct terms are sorted, and for each of SUBSETS random subsets of the lexicon those inside it
are hashed in that order to 64 bits. A subset holds one term in 2 ** level; a document takes the LEVELS levels
at which a quarter of a term to two terms of its own are expected in a subset, so that a text of any length
keeps some hashes when part of it changes. The likeness of two fingerprints is the share of equal hashes,
where either has a term, at the level where it is greatest. Sets of which one has 8 or more times the terms of
the other may share no level; their likeness is the share of subsets in whose order both have the same term first.

All terms of a document are hashed in the same way beside. Two fingerprints are compared on these where the
lexicon has less than THIN of either's terms, as it has of texts with so many copies that their terms pass HIGH.

A document without words (or a null text) has an empty fingerprint; an empty table gives an empty result. Equal
texts have equal fingerprints, and likeness 1. Documents with equal doc_id follow each other in descending order of a
hash of their text; null doc_ids come first in descending order. Rows equal in both follow each other, each with the
next as its next document. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcela.llm.common import WordHashes, documents, materialize, mixed, order_id, text_key

LOW, HIGH, BROADCAST = 1 / 4000, 0.10, 1_000_000
SUBSETS, LEVELS = 64, 3
#: A text with a smaller share of its terms in the lexicon is compared on all terms.
THIN = 0.25
MARKS = b".,;:!?\"'()[]{}*#$%&|<>-_"
SEEDS = mixed(np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
#: Terms and documents hashed at once, and characters of texts that a range of documents is meant to have.
CHUNK_TERMS, CHUNK_DOCS, RANGE_CHARS = 16_384, 1_000, 64_000_000
#: Weights of the places in a sorted sequence of terms.
BASE = 0x9E3779B97F4A7C15
POWERS = np.array([pow(BASE, i, 1 << 64) for i in range(64)], np.uint64)


class TermHashes(WordHashes):
    def of(self, text: str | None) -> np.ndarray:
        """Distinct term hashes in order: words in lower case without marks."""
        plain = (text or "").lower().encode("utf-8", "surrogatepass").translate(None, MARKS)
        return np.unique(self.of_bytes(plain))


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, df: of each batch of documents."""
    hashes = TermHashes()
    for batch in batches:
        found = [np.empty(0, np.uint64), *(hashes.of(t.as_py()) for t in batch["text"])]
        term, df = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(df)], names=["term", "df"])


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """term: the hashes of the terms in the band, written to the shared folder."""
    n = docs.count()
    counts = docs.select("text").mapInArrow(term_counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return materialize(counts.filter(F.col("df").between(max(2, int(np.ceil(low * n))), max(2, int(high * n)))).select("term"), "lexicon")


def sequence_hashes(group: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """group, term: terms in order within each group, groups in order. The groups, and a 64-bit hash (never 0) of
    each one's sequence of terms."""
    if not len(group):
        return group, np.empty(0, np.uint64)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    rank = np.arange(len(group)) - np.repeat(start, size)
    weight = POWERS[np.minimum(rank, len(POWERS) - 1)]
    for i in np.flatnonzero(rank >= len(POWERS)):
        weight[i] = pow(BASE, int(rank[i]), 1 << 64)
    return group[start], mixed(np.add.reduceat(mixed(term) * weight, start)) | np.uint64(1)


class Sets:
    """The hashes of some sets of terms. size: terms of each; level: its first level; rows: LEVELS x SUBSETS hashes
    of each, 0 where the subset has no term; least: of each subset's order, the place of the first term."""

    def __init__(self, size: np.ndarray):
        n = len(size)
        self.size = size
        self.level = np.array([max(0, int(x).bit_length() - 1) for x in size], np.int64)
        self.rows = np.zeros((n, LEVELS, SUBSETS), np.uint64)
        self.least = np.full((n, SUBSETS), 0xFFFFFFFF, np.uint32)
        self.top = ((np.uint64(1) << (np.uint64(32) - self.level.astype(np.uint64))) - np.uint64(1)).astype(np.uint32)
        self.found: list[tuple[np.ndarray, ...]] = []

    def add(self, owner: np.ndarray, term: np.ndarray, order: np.ndarray) -> None:
        """Some terms: their sets (in order), hashes (in order within a set), and places in the order of each subset."""
        if not len(owner):
            return
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])  # terms of a set may go on in the next call
        self.least[owner[start]] = np.minimum(self.least[owner[start]], np.minimum.reduceat(order, start, axis=0))
        row, subset = np.nonzero(order <= self.top[owner][:, None])
        self.found.append((owner[row] * SUBSETS + subset, term[row], order[row, subset]))

    def hash(self) -> None:
        """Once all terms are there."""
        if not self.found:
            return
        group, term, place = (np.concatenate(x) for x in zip(*self.found, strict=True))
        by_group = np.argsort(group, kind="stable")
        group, term, place = group[by_group], term[by_group], place[by_group]
        top = self.top[group // SUBSETS]
        for level in range(LEVELS):
            inside = place <= top >> np.uint32(level)
            found, value = sequence_hashes(group[inside], term[inside])
            self.rows[found // SUBSETS, level, found % SUBSETS] = value

    def text(self, i: int) -> str:
        """The first level; of each level, which subsets have a term, and their hashes; 16 bits of each first term."""
        if not self.size[i]:
            return ""
        parts = [np.packbits(r != 0).tobytes() + r[r != 0].tobytes() for r in self.rows[i]] + [self.least[i].astype(np.uint16).tobytes()]
        return f"{self.level[i]}:" + ":".join(base64.b64encode(x).decode().rstrip("=") for x in parts)

    def likeness(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of each set i with set j. Sets without terms are like nothing."""
        both = (self.size[i] > 0) & (self.size[j] > 0)
        apart = self.level[j] - self.level[i]
        out = np.where(both & (abs(apart) >= LEVELS), (self.least[i].astype(np.uint16) == self.least[j].astype(np.uint16)).mean(axis=1), 0.0)
        for level in range(LEVELS):
            at = np.flatnonzero(both & (level - apart >= 0) & (level - apart < LEVELS))
            a, b = self.rows[i[at], level], self.rows[j[at], (level - apart)[at]]
            out[at] = np.maximum(out[at], ((a == b) & (a != 0)).sum(axis=1) / np.maximum(((a | b) != 0).sum(axis=1), 1))
        return out


class Prints:
    """The fingerprints of texts, given the terms of each and which of them are in the lexicon. kind: b where the
    lexicon has enough of the terms, a where it has few or none, e without terms."""

    def __init__(self, terms: list[np.ndarray], inside: list[np.ndarray]):
        size, known = np.array([len(t) for t in terms], np.int64), np.concatenate([np.empty(0, bool), *inside])
        self.whole, self.own = Sets(size), Sets(np.array([int(x.sum()) for x in inside], np.int64))
        every, owner = np.concatenate([np.empty(0, np.uint64), *terms]), np.repeat(np.arange(len(terms)), size)
        for a in range(0, len(every), CHUNK_TERMS):
            part, who, has = every[a : a + CHUNK_TERMS], owner[a : a + CHUNK_TERMS], known[a : a + CHUNK_TERMS]
            unique, place = np.unique(part, return_inverse=True)
            order = (mixed(unique[:, None] ^ SEEDS) >> np.uint64(32)).astype(np.uint32)[place]
            self.whole.add(who, part, order)
            self.own.add(who[has], part[has], order[has])
        self.whole.hash()
        self.own.hash()
        self.kind = np.where(size == 0, "e", np.where(self.own.size >= THIN * size, "b", "a"))

    def text(self, i: int) -> str:
        return f"{self.kind[i]};{self.own.text(i)};all;{self.whole.text(i)}" if self.kind[i] != "e" else "e"

    def likeness(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """By the terms in the lexicon, or by all where the lexicon has too few of either text's to judge by."""
        a, b = self.kind[i], self.kind[j]
        out = np.where((a == "b") & (b == "b"), self.own.likeness(i, j), self.whole.likeness(i, j))
        return np.where((i == j) | ((a == "e") & (b == "e")), 1.0, out)


def edited(text: str, after: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


@dataclass
class Pair:
    """A document with the next one: what is known of it, and the terms of its text, its edited text and the next text."""

    doc_id: int | None
    n_chars: int
    sha: str
    terms: list[np.ndarray]


def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Pair]]:
    """Rows of a part in order, a guest last: the part, and each document with the next one. Equal texts have one array of
    terms. Of n equal rows, folded into one, all but the last have themselves next."""
    hashes, last = TermHashes(), None

    def pair(doc_id: int | None, text: str, terms: np.ndarray, after: str, after_terms: np.ndarray) -> Pair:
        new = edited(text, after)
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return Pair(doc_id, len(text), sha, [terms, terms if new == text else hashes.of(new), terms if after == text else after_terms])

    for batch in batches:
        for doc_id, part, guest, n, text in zip(*(batch[c] for c in ("doc_id", "part", "guest", "n", "text")), strict=True):
            part, text, doc_id = part.as_py(), text.as_py() or "", doc_id.as_py()
            terms = hashes.of(text)
            if last and last[0] == part and not last[1]:
                yield part, pair(*last[2:], text, terms)
            last = (part, guest.as_py(), doc_id, text, terms)
            for _ in range(0 if last[1] else n.as_py() - 1):
                yield part, pair(doc_id, text, terms, text, terms)


def chunks(pairs: Iterator[tuple[int, Pair]]) -> Iterator[list[tuple[int, Pair]]]:
    own, size = [], 0
    for x in pairs:
        own.append(x)
        size += len(x[1].terms[0]) + len(x[1].terms[1])
        if size >= CHUNK_TERMS or len(own) >= CHUNK_DOCS:
            yield own
            own, size = [], 0
    if own:
        yield own


def finished(pairs: list[Pair], inside: Callable[[np.ndarray], np.ndarray]) -> pa.RecordBatch:
    """FINGERPRINTS. inside: which of an array of terms are in the lexicon. An array that several texts share is hashed once."""
    distinct = {id(t): t for p in pairs for t in p.terms}
    at = {k: i for i, k in enumerate(distinct)}
    prints = Prints([*distinct.values()], [inside(t) for t in distinct.values()])
    own, new, after = (np.array([at[id(p.terms[k])] for p in pairs], np.int64) for k in range(3))
    names = [f.split()[0] for f in FINGERPRINTS.split(", ")]
    columns = [
        [p.doc_id for p in pairs], [p.n_chars for p in pairs], [p.sha for p in pairs], [prints.text(i) for i in own], [prints.text(i) for i in new],
        prints.likeness(own, new), prints.likeness(own, after),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], names=names)


def with_lexicon(words: Broadcast):
    """Rows in order to FINGERPRINTS, with a lexicon (sorted) that every task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for own in chunks(pairs_of(batches)):
            place = lambda t: np.minimum(np.searchsorted(known, t), max(len(known) - 1, 0))
            yield finished([p for _, p in own], lambda t: known[place(t)] == t if len(known) else np.zeros(len(t), bool))

    return run


TERMS = "uid long, doc_id long, n_chars long, sha string, terms array<array<long>>"


def as_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to TERMS. uid: the part and the place in it."""
    part, place = None, 0
    for own in chunks(pairs_of(batches)):
        uids = []
        for p, _ in own:
            part, place = p, place + 1 if p == part else 0
            uids.append(p << 32 | place)
        terms = [[t.view(np.int64) for t in p.terms] for _, p in own]
        columns = [uids, [p.doc_id for _, p in own], [p.n_chars for _, p in own], [p.sha for _, p in own], terms]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["uid", "doc_id", "n_chars", "sha", "terms"])


def from_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """TERMS with known, the terms of all three texts that are in the lexicon, to FINGERPRINTS."""
    for batch in batches:
        rows = zip(*(batch[c] for c in ("doc_id", "n_chars", "sha", "terms", "known")), strict=True)
        known: dict[int, np.ndarray] = {}

        def read(rows=rows, known=known) -> Iterator[tuple[int, Pair]]:
            for doc_id, n_chars, sha, terms, inside in rows:
                own = [t.values.to_numpy().view(np.uint64) for t in terms]
                has = inside.values.to_numpy().view(np.uint64) if inside.is_valid else np.empty(0, np.uint64)
                known.update((id(t), np.isin(t, has)) for t in own)
                own = [t if i == 0 or not np.array_equal(t, own[0]) else own[0] for i, t in enumerate(own)]
                yield 0, Pair(doc_id.as_py(), n_chars.as_py(), sha.as_py(), own)

        for own in chunks(read()):
            yield finished([p for _, p in own], lambda t, known=known: known[id(t)])


def joined_with(words: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows in order to FINGERPRINTS, with a lexicon that no task holds: the terms of all texts meet it in a join."""
    own = materialize(rows.mapInArrow(as_terms, TERMS), "terms")
    every = own.select("uid", F.explode(F.array_distinct(F.flatten("terms"))).alias("term"))
    known = every.join(words, "term", "left_semi").groupBy("uid").agg(F.collect_list("term").alias("known"))
    return own.join(known, "uid", "left").mapInArrow(from_terms, FINGERPRINTS)


def heads_of_ranges(docs: DataFrame, parts: int) -> list[tuple[int, int]]:
    """The greatest (ord, tkey) of each range, in order. Ranges follow each other and have about as many characters each.
    Found from narrow rows; the driver gets a few numbers for each range."""
    narrow = docs.select("ord", "tkey", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    ranged = narrow.repartitionByRange(4 * parts, "ord", "tkey").withColumn("range", F.spark_partition_id())
    found = sorted(ranged.groupBy("range").agg(F.max(F.struct("ord", "tkey")).alias("head"), F.sum("chars").alias("chars")).select("head.ord", "head.tkey", "chars").collect())
    out, size, enough = [], 0, sum(r.chars for r in found) / parts
    for i, r in enumerate(found):
        size += r.chars
        if size >= enough or i == len(found) - 1:
            out.append((r.ord, r.tkey))
            size = 0
    return out


def places(ords: np.ndarray, keys: np.ndarray, heads: list[tuple[int, int]]) -> np.ndarray:
    """The range of each (ord, tkey): the first whose head isn't before it."""
    top, key = (np.array([h[k] for h in heads], np.int64) for k in range(2))
    low, high = np.searchsorted(top, ords, "left"), np.searchsorted(top, ords, "right")
    for a, b in {*zip(low[low < high].tolist(), high[low < high].tolist(), strict=True)}:
        at = np.flatnonzero((low == a) & (high == b))
        low[at] = a + np.searchsorted(key[a:b], keys[at], "left")
    return np.minimum(low, max(len(heads) - 1, 0))


def dealt(heads: list[tuple[int, int]]):
    """doc_id, text, ord, tkey to the same with part, guest and n: rows of a batch that are equal become one, n times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ords, keys = batch["ord"].to_numpy(), batch["tkey"].to_numpy()
            order = np.lexsort((keys, ords))
            new = np.r_[True, (ords[order][1:] != ords[order][:-1]) | (keys[order][1:] != keys[order][:-1])][: len(order)]
            start = np.flatnonzero(new)
            first, n = order[start], np.diff(np.r_[start, len(order)])
            part = places(ords[first], keys[first], heads)
            kept = batch.take(pa.array(first))
            yield pa.RecordBatch.from_arrays([*(kept[c] for c in ("doc_id", "text", "ord", "tkey")), pa.array(part, pa.int32()), pa.array(np.zeros(len(part), bool)), pa.array(n, pa.int32())], names=["doc_id", "text", "ord", "tkey", "part", "guest", "n"])

    return run


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH, broadcast: int = BROADCAST) -> DataFrame:
    """FINGERPRINTS of every document. Documents are dealt into ranges of (doc_id, hash of the text); the first of each
    range is a guest in the range before it in descending order, as the next document of that range's last."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"ord": order_id(F.col("doc_id")), "tkey": text_key(F.col("text"))})
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // RANGE_CHARS)
    heads = heads_of_ranges(docs, parts)
    guests = spark.createDataFrame([(o, k, (i + 1) % len(heads)) for i, (o, k) in enumerate(heads)], "ord long, tkey long, host int")
    visits = docs.join(F.broadcast(guests), ["ord", "tkey"]).select("doc_id", "text", "ord", "tkey", F.col("host").alias("part"), F.lit(True).alias("guest"), F.lit(1).alias("n"))
    own = docs.select("doc_id", "text", "ord", "tkey").mapInArrow(dealt(heads), "doc_id long, text string, ord long, tkey long, part int, guest boolean, n int")
    rows = own.union(visits).repartitionById(max(1, len(heads)), F.col("part")).sortWithinPartitions("part", "guest", F.desc("ord"), F.desc("tkey"))
    rows = rows.select("doc_id", "part", "guest", "n", "text")
    words = lexicon(docs, low, high)
    if words.count() > broadcast:
        return joined_with(words, rows)
    known = np.sort(words.toArrow()["term"].to_numpy().view(np.uint64))
    return rows.mapInArrow(with_lexicon(spark.sparkContext.broadcast(known)), FINGERPRINTS)


def op4_imatch(spark, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
