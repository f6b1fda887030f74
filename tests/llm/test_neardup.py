import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from parcela.llm import jaccard, lines, neardup
from tests.llm import brute
from tests.llm.conftest import prose


@pytest.mark.parametrize("kind", ["chain", "star", "random", "loops", "none"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {
        "chain": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 200)], "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)],
        "loops": [(1, 1), (2, 3), (3, 2), (2, 3)], "none": [],
    }[kind]
    keys = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.id: r.comp for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: c for k, c in brute.groups(range(300), edges).items() if k in keys}


def test_a_key_has_one_row_a_batch():
    keys = np.array([[1, 2], [1, 3], [1, 2]], np.uint64)
    rows = neardup.band_rows(np.array([30, 10, 20], np.uint64), keys).to_pydict()
    open_ = [(k, i) for k, i, lead in zip(*rows.values(), strict=True) if lead is None]
    assert sorted(open_) == [(1, 10), (2, 20), (3, 10)]
    assert sorted((i, lead) for i, lead in zip(rows["id"], rows["lead"], strict=True) if lead is not None) == [(20, 10), (30, 10), (30, 20)]


def keys_of(of):
    """Rows of id, key for each member, by a plain function."""

    def run(batches):
        for batch in batches:
            rows = [(i, k) for i in batch["id"].to_pylist() for k in of(i)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.int64()) for n in range(2)], names=["id", "key"])

    return run


def cell_rows(spark, n, of, block, bands=2):
    members = spark.createDataFrame([(i, 0) for i in range(n)], "id long, comp long")
    return neardup.cells(members, members.select("id", "comp"), keys_of(of), bands, block).collect()


def test_a_long_chain_of_buckets_costs_what_its_buckets_do(spark):
    got = cell_rows(spark, 2000, lambda i: (i, i + 1), 50)
    assert len(got) == 2 * 2000 - 2 and {r.key for r in got} == {*range(1, 2000)} and all(r.alone for r in got)


def test_each_pair_that_shares_a_bucket_meets_in_one_cell_that_answers_for_it(spark):
    rng = random.Random(4)
    # buckets of every size: one of half of all members, some of a few, many of one
    keys = {i: sorted({*([1] if rng.random() < 0.5 else []), 10 + i // 7, 1000 + rng.randrange(40), 5000 + i}) for i in range(120)}
    want = Counter({(a, b): 1 for a in keys for b in keys if a < b and {*keys[a]} & {*keys[b]}})
    for block, bands in ((16, 2), (16, 100), (500, 2)):
        cells = {}
        for r in cell_rows(spark, 120, lambda i: keys[i], block, bands):
            cells.setdefault(r.cell, []).append(r)
        got = Counter()
        for own in cells.values():
            own = sorted(own, key=lambda r: (r.side, r.id))
            kinds = {"id": pa.int64(), "side": pa.int32(), "alone": pa.bool_(), "key": pa.int64(), "heavy": pa.list_(pa.int64())}
            cell = pa.table({c: pa.array([r[c] for r in own], k) for c, k in kinds.items()})
            aligned = np.zeros((len(own), 60), np.uint64)  # a column for each bucket that several have, as bands have
            places = {k: n for n, k in enumerate(sorted({k for r in own for k in keys[r.id] if k < 5000}))}
            for n, r in enumerate(own):
                aligned[n] = 10**7 + 1000 * r.id + np.arange(60)
                for k in keys[r.id]:
                    if k in places:
                        aligned[n, places[k]] = k
            pairs = neardup.Pairs(cell, aligned)
            got.update(tuple(sorted((own[i].id, own[j].id))) for i in range(len(own)) for j in pairs.of(i))
        assert got == want


@pytest.mark.parametrize("kind", ["lines", "documents"])
def test_recall_of_bands(kind):
    """Of pairs with a similarity of 0.8 to 0.9, the share that have a band in common: nearly all."""
    rng, met, n = random.Random(6), 0, 0
    while n < 300:
        words = prose(rng, rng.randrange(30, 90)).split()
        other = [*words]
        for _ in range(rng.randrange(1, 4)):
            other[rng.randrange(len(other))] = prose(rng, 1)
        a, b = " ".join(words), " ".join(other)
        if kind == "lines":
            sets = [{x[i : i + lines.SHINGLE] for i in range(len(x) - lines.SHINGLE + 1)} for x in (a, b)]
            keys = lines.line_keys([a, b])
        else:
            sets = [brute.shingle_set(a), brute.shingle_set(b)]
            signs = [jaccard.signature(jaccard.shingles(jaccard.WordHashes().of(x))) for x in (a, b)]
            keys = neardup.band_keys(np.array(signs), jaccard.ROWS)
        if 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) <= 0.9:
            n += 1
            met += bool((keys[0] == keys[1]).any())
    assert met >= 0.99 * n


def test_cells_of_a_batch_are_answered_together():
    """Small cells give one batch of edges, and the same edges as comparing every pair of sets does."""
    rng = random.Random(5)
    rows = []
    for cell in range(60):
        line = "".join(rng.choice("abcdefgh ") for _ in range(120))
        for k in range(2 + cell % 3):
            rows.append((cell, line[: 120 - 2 * k] if cell % 4 else "".join(rng.choice("xyz") for _ in range(40 + k))))
    ids = [lines.line_ids(x) for _, x in rows]
    signed = [lines.longs([i[n] for i in ids]) for n in (0, 1)]
    n = len(rows)
    batch = pa.RecordBatch.from_arrays(
        [*signed, pa.array([x for _, x in rows]), pa.array([c for c, _ in rows], pa.int64()), pa.array([0] * n, pa.int32()), pa.array([True] * n), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))],
        names=["id", "id2", "value", "cell", "side", "alone", "key", "heavy"],
    )
    got = [*neardup.by_cell(lines.prepared, lines.verified)(iter([batch]))]
    assert len(got) <= 2
    found = {(r["a"], r["b"]) for b in got for r in b.to_pylist()}
    grams = lambda x: {x[i : i + lines.SHINGLE] for i in range(len(x) - lines.SHINGLE + 1)}
    want, (keys, _) = set(), lines.prepared(batch)
    for c in range(60):
        own = [i for i in range(n) if rows[i][0] == c]
        forest = neardup.Forest(n)
        for i in own:
            for j in own:
                a, b = grams(rows[i][1]), grams(rows[j][1])
                if i < j and (keys[i] == keys[j]).any() and len(a & b) >= lines.THRESHOLD * len(a | b) and forest.join(i, j):
                    want.add((signed[0][i].as_py(), signed[0][j].as_py()))
    assert found == want and len(want) > 50
