"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

Pieces are kept apart by reciprocal-capacity classes: class k holds pieces of at most capacity / k tokens, and
each of its sequences takes exactly k of them, so a sequence is full by count and no lengths are compared. A
document longer than the capacity gives whole sequences first. Of what is left, n tokens of class k stay one
piece if k * n is within `slack` of the capacity; else a head of exactly capacity // (k + 1) tokens goes to class
k + 1, which it fits without a gap, and the rest, far shorter, is classed again. Each worker fills classes by
itself while it reads: no shuffle, and never more in memory than one open sequence a class.

What is open when a worker's rows end is laid end to end, class by class, and cut at the capacity; the last of it
becomes sequences of powers of two, which need no padding, unless `powers` is false: then it is one padded sequence.

Ids are those of the tokenizers library for the file (add_special_tokens=False, no truncation, no padding), then
`end`; WordCodec finds them by merge rounds over many words at once. A null text is an empty one: `end` alone. Null and equal ids and repeated rows are packed row by row; ties
don't occur. An empty table gives no pieces. docs must have doc_id and text; other columns are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parcela.llm.bpe import BLANKS, LETTERS, NUMBERS, Codec, byte_symbols, chunks
from parcela.llm.common import documents

CAPACITY, SLACK, END = 2048, 1 / 64, 1
#: Bytes of ids that a task gives back at once.
OUT_BYTES = 4 << 20
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, piece_class int, sequence_id long, offset long"
PIECES_TYPE = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in PIECES.split(", "))])


#: The words of a lower-cased text of characters up to U+00FF.
WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{NUMBERS}]|[^{BLANKS}{LETTERS}{NUMBERS}]+")


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordCodec(Codec):
    """A lower-casing tokenizer whose words end in symbols of their own. The end is a symbol after the word, and the
    pairs of a byte with it come before all others; UTF-8 has no byte 255, which stands for it. Only characters up to
    U+00FF are split and lower-cased here; a run without ASCII white space that has others goes to the library."""

    SUFFIX = "</w>"

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        vocab, end = spec["vocab"], self.size
        ends = [(vocab[c], end, vocab[c + self.SUFFIX]) for c in byte_symbols()]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["merges"]]
        left, right, merged = np.array(ends + [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).T
        self.size += 1
        self.key_type = np.uint32 if self.size**2 < 1 << 32 else np.int64
        self.of_byte, self.merged = self.of_byte.astype(self.key_type), merged.astype(self.key_type)
        self.of_byte[255] = end
        keys = left * self.size + right
        self.ranks = np.argsort(keys)
        self.keys, self.ranks = keys[self.ranks].astype(self.key_type), self.ranks.astype(np.int32)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return super().merge_words([w + b"\xff" for w in words])

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if latin("".join(words)):
            return super().ids_of(words)
        odd = np.array([not latin(w) for w in words])
        starts, lengths = np.zeros((2, len(words)), np.int64)
        flat, starts[~odd], lengths[~odd] = super().ids_of([w for w, o in zip(words, odd, strict=True) if not o])
        found = [np.array(x.ids, np.int32) for x in self.library.encode_batch([w for w, o in zip(words, odd, strict=True) if o], add_special_tokens=False)]
        lengths[odd] = [len(x) for x in found]
        starts[odd] = len(flat) + np.cumsum(lengths[odd]) - lengths[odd]
        return np.concatenate([flat, *found]), starts, lengths

    def words(self, text: str) -> list[str]:
        if latin(text):
            return WORDS.findall(text.lower())
        return [w for x in text.encode("utf-8", "surrogatepass").split() for w in self.chunk(x.decode("utf-8", "surrogatepass"))]

    @staticmethod
    def chunk(text: str) -> list[str]:
        return WORDS.findall(text.lower()) if latin(text) else [text]

    def pieces(self, text: str) -> list[str]:
        if not self.splitter or not self.splitter.search(text):
            return self.words(text)
        out, at = [], 0
        for m in self.splitter.finditer(text):
            out += [*self.words(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.words(text[at:])


@lru_cache(maxsize=4)
def word_codec(path: str) -> WordCodec:
    return WordCodec(path)


@lru_cache(maxsize=1 << 16)
def parts(n: int, capacity: int, slack: float) -> tuple[tuple[int, int], ...]:
    """(class, length) of the pieces of n < capacity tokens."""
    if not n:
        return ()
    k = capacity // n
    if k * n >= capacity * (1 - slack):
        return ((k, n),)
    head = capacity // (k + 1)
    return ((k + 1, head), *parts(n - head, capacity, slack))


class Worker:
    """One task's open sequences, by class."""

    def __init__(self, task: int, capacity: int, slack: float, powers: bool):
        self.capacity, self.slack, self.powers = capacity, slack, powers
        self.next = task << 36
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []
        self.size = 0

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, tokens, k in pieces:
            length = len(ids) // 4
            self.rows.append((doc_id, start, length, ids, tokens, k, self.next, offset))
            offset += length
        self.next += 1
        self.size += 4 * offset

    def add(self, doc_id: int | None, ids: bytes) -> None:
        tokens, start = len(ids) // 4, 0
        for k, length in (*((1, self.capacity),) * (tokens // self.capacity), *parts(tokens % self.capacity, self.capacity, self.slack)):
            pieces = self.open.setdefault(k, [])
            pieces.append((doc_id, start, ids[4 * start : 4 * (start + length)], tokens, k))
            start += length
            if len(pieces) == k:
                self.close(self.open.pop(k))

    def end(self) -> None:
        """Closes what is open: end to end, and cut where sequences end. Pieces of it have class 0."""
        rest = [p for k in sorted(self.open) for p in self.open.pop(k)]
        left = sum(len(p[2]) // 4 for p in rest)
        pieces, room = [], 0
        for doc_id, start, ids, tokens, _ in rest:
            while ids:
                if not room:
                    room = self.capacity if left >= self.capacity or not self.powers else 1 << (left.bit_length() - 1)
                cut = ids[: 4 * room]
                pieces.append((doc_id, start, cut, tokens, 0))
                ids, n = ids[len(cut) :], len(cut) // 4
                start, room, left = start + n, room - n, left - n
                if not room:
                    self.close(pieces)
                    pieces = []
        if pieces:
            self.close(pieces)

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True)
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PIECES_TYPE.types, strict=True)], schema=PIECES_TYPE)
        self.rows, self.size = [], 0
        return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, slack: float = SLACK, end: int | None = END, powers: bool = True) -> DataFrame:
    """PIECES: a row for each piece of a document: where it starts in the document's ids, its ids, how many ids the
    document has, its class (0: laid end to end), its sequence and where it lies in it. Of a document's ids each lies
    in one piece. tokenizer: the file's path, on every machine. A document without ids (end is None) has no piece."""
    last = b"" if end is None else end.to_bytes(4, "little")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, worker = word_codec(tokenizer), Worker(TaskContext.get().partitionId(), capacity, slack, powers)
        for batch in batches:
            doc_ids = iter(batch.column(0).to_pylist())
            for texts in chunks(batch.column(1)):
                for ids in own.encode(texts):
                    worker.add(next(doc_ids), ids.astype("<u4").tobytes() + last)
                    if worker.size >= OUT_BYTES:
                        yield worker.batch()
        worker.end()
        if worker.rows:
            yield worker.batch()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(packed, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length and ids of each sequence, without padding: at most capacity ids are brought together."""
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_own"), F.sum("length").alias("length"))
    return whole.select("sequence_id", "length", F.aggregate("_own", F.lit(b""), lambda out, x: F.concat(out, x["ids"])).alias("ids"))


def op11_harmonic_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece of every document."""
    pieces = pack(documents(spark, sf_dir), tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
