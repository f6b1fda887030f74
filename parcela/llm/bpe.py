"""BPE encoding and decoding: byte-level, by batched numpy merge rounds.

The words of many texts that have not been met before lie as symbols in one flat array. Each round looks
up the pairs of neighbours in a sorted array of pair keys by binary search, and merges in every word all
pairs of that word's lowest rank. Words of which nothing can merge any more leave the array.

Results are those of the public tokenizers library for the same file (add_special_tokens=False, no
truncation, no padding): strings of special tokens in a text become their ids. A null text has no ids, as
an empty one. Texts are encoded whole and each by itself, so ties, repeated rows and order don't matter.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.llm.common import documents

#: How byte-level tokenizers split a text before they merge.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for texts of characters up to U+00FF, of which classes can be written out; less than half the time.
LETTERS, NUMBERS, BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \x85\xa0"
LATIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
#: Words of more bytes go through a heap: rounds over one long word would take the square of its length.
LONG_WORD = 2048
#: Words that a task keeps the ids of, and characters that it splits at once.
KEPT_WORDS, CHUNK_CHARS = 250_000, 1_000_000


def split_words(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return PATTERN.findall(text)
    return LATIN.findall(text)


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable ones for themselves, the others
    from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Index(dict):
    """Words and their numbers; a word that is looked up and isn't there gets the next one."""

    def __init__(self, *known):
        super().__init__(*known)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        raw = [b""] * self.size
        for token, i in vocab.items():
            raw[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.byte_len = np.array([len(x) for x in raw], np.int64)
        self.byte_start = np.cumsum(self.byte_len) - self.byte_len
        # pairs of symbols are keys; of 32 bits where those do
        self.key_type = np.uint32 if self.size**2 < 1 << 32 else np.int64
        self.of_byte = np.zeros(256, self.key_type)
        for c, b in symbols.items():
            self.of_byte[b] = vocab[c]
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order].astype(self.key_type), order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], self.key_type)
        self.splitter = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.forget()

    def forget(self) -> None:
        # a special token is met as a word of its own only where it was split off: no word that the
        # pattern yields holds both letters and signs
        self.index = Index(zip(self.special, range(len(self.special)), strict=True))
        self.flat = np.array([*self.special.values()], np.int32)
        self.starts, self.lengths = np.arange(len(self.flat)), np.ones(len(self.flat), np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; len(keys) where a pair doesn't merge."""
        key = (left * self.key_type(self.size) + right).astype(self.key_type, copy=False)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.int32(len(self.keys)))

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the words, in any order, where those of each word start, and how many they are."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        short = np.flatnonzero((size > 0) & (size <= LONG_WORD))
        at, found = np.flatnonzero(size > LONG_WORD), []
        for i in at:
            found.append(self.merge_long(words[i]))
        ends, counts = [at], [np.array([len(x) for x in found], np.int64)]
        sym = self.of_byte[np.frombuffer(b"".join(words if len(short) == len(words) else [words[i] for i in short]), np.uint8)]
        word = np.repeat(short.astype(np.int32), size[short])
        none = len(self.keys)
        rank, fresh = np.full(len(sym), none, np.int32), np.arange(len(sym))
        while len(sym):
            fresh = fresh[fresh < len(sym) - 1]
            fresh = fresh[word[fresh] == word[fresh + 1]]
            rank[fresh] = self.rank(sym[fresh], sym[fresh + 1])
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[first, len(sym)])
            least = np.minimum.reduceat(rank, first)
            done = least == none
            goes = np.repeat(done, count)
            ends.append(word[first[done]])
            counts.append(count[done])
            found.append(sym[goes])
            hit = (rank == np.repeat(least, count)) & (rank < none)
            # of overlapping pairs (the same symbol again and again) every second one, from the left
            place = np.arange(len(sym))
            run = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
            hit &= (place - run) % 2 == 0
            sym = np.where(hit, self.merged[np.minimum(rank, none - 1)], sym)
            keep = ~np.r_[False, hit[:-1]] & ~goes
            # only pairs with a merged symbol have another rank
            other = hit | np.r_[hit[1:], False] | np.r_[hit[2:], False, False][: len(hit)]
            rank = np.where(other, np.int32(none), rank)[keep]
            sym, word, fresh = sym[keep], word[keep], np.flatnonzero(other[keep])
        at, count = np.concatenate(ends), np.concatenate(counts)
        starts, lengths = np.zeros((2, len(words)), np.int64)
        starts[at], lengths[at] = np.cumsum(count) - count, count
        return np.concatenate([np.empty(0, np.int32), *found]).astype(np.int32), starts, lengths

    def merge_long(self, text: bytes) -> np.ndarray:
        """The same for one long word: a heap of (rank, place)."""
        sym = self.of_byte[np.frombuffer(text, np.uint8)].tolist()
        n, none = len(sym), len(self.keys)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        first = self.rank(np.array(sym[:-1]), np.array(sym[1:]))
        heap = [(int(r), i, sym[i], sym[i + 1]) for i, r in enumerate(first) if r < none]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = int(self.merged[r]), -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0:
                    pair = (sym[x], sym[y])
                    if pair not in known:
                        known[pair] = int(self.rank(np.array(pair[:1]), np.array(pair[1:]))[0])
                    if known[pair] < none:
                        heapq.heappush(heap, (known[pair], x, *pair))
        return np.array([s for s in sym if s >= 0], np.int64)

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.merge_words([w.encode("utf-8", "surrogatepass") for w in words])

    def learn(self) -> None:
        """Finds the ids of the words that the index has got since the last time."""
        new, self.index.new = self.index.new, []
        if new:
            flat, starts, lengths = self.ids_of(new)
            self.starts = np.r_[self.starts, len(self.flat) + starts]
            self.lengths = np.r_[self.lengths, lengths]
            self.flat = np.concatenate([self.flat, flat])

    def pieces(self, text: str) -> list[str]:
        """Words of the text; special tokens stand alone, as a tuple would, by their own string."""
        if not self.splitter or not self.splitter.search(text):
            return split_words(text)
        out, at = [], 0
        for m in self.splitter.finditer(text):
            out += split_words(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + split_words(text[at:])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.index) > KEPT_WORDS:
            self.forget()
        split = [self.pieces(t) if t else [] for t in texts]
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64)
        self.learn()
        lengths = self.lengths[at]
        ids = self.flat[gather(self.starts[at], lengths)]
        # each text's ids lie next to each other
        ends = np.r_[0, np.cumsum(lengths)][np.cumsum([0, *map(len, split)])].tolist()
        return [ids[a:b] for a, b in pairwise(ends)]

    def decode(self, ids: np.ndarray) -> str:
        at = self.bytes[gather(self.byte_start[ids], self.byte_len[ids])]
        return at.tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def chunks(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts, so many at a time that their words fit in memory."""
    part, size = [], 0
    for x in texts:
        part.append(x.as_py())
        size += len(part[-1] or "")
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(text: Column, path: str) -> Column:
    """The ids of the text, array<int>; never null. path: the tokenizer's file, on every machine."""

    @F.arrow_udf("array<int>")
    def bpe_encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for batch in batches:
            found = [x.astype(np.int32) for part in chunks(batch) for x in own.encode(part)]
            ends = np.cumsum([0, *(len(x) for x in found)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *found])))

    return bpe_encode(text)


def lists(batch: pa.Array) -> Iterator[np.ndarray]:
    values, ends = batch.values.to_numpy(zero_copy_only=False), batch.offsets.to_numpy()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield values[a:b]


def decode(ids: Column, path: str) -> Column:
    """The text of ids; special tokens become their strings."""

    @F.arrow_udf("string")
    def bpe_decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for batch in batches:
            yield pa.array([own.decode(x) for x in lists(batch)], pa.string())

    return bpe_decode(ids)


def coded(text: Column, path: str) -> Column:
    """struct<ids: binary, decoded: string>: the ids as little-endian unsigned 32-bit integers, and the text
    decoded from them. Both in one Python worker, which holds one vocabulary."""

    @F.arrow_udf("ids binary, decoded string")
    def bpe_code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for batch in batches:
            ids, texts = [], []
            for part in chunks(batch):
                for x in own.encode(part):
                    ids.append(x.astype("<u4").tobytes())
                    texts.append(own.decode(x))
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["ids", "decoded"])

    return bpe_code(text)


def stage(spark, docs: DataFrame, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, lang, source, ids (little-endian unsigned 32-bit), n_tokens, and whether decoding the ids gives
    the text again, of every document. docs must have doc_id, text, lang and source; other columns are left out."""
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    out = docs.select("doc_id", "lang", "source", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("code", coded(F.col("text"), tokenizer))
    return out.select("doc_id", "lang", "source", "code.ids", (F.octet_length("code.ids") / 4).cast("long").alias("n_tokens"), (F.col("code.decoded") == F.col("text")).alias("round_trip"))


def op3_bpe(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them, of every document."""
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    docs = documents(spark, sf_dir).select("doc_id", coded(F.col("text"), tokenizer).alias("code"))
    return docs.select("doc_id", (F.octet_length("code.ids") / 4).cast("long").alias("n_tokens"), F.sha2("code.ids", 256).alias("ids_sha256"), F.sha2(F.col("code.decoded").cast("binary"), 256).alias("decoded_sha256"))
