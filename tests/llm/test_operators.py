"""The ten operators against plain statements, on the small tables and on edge cases."""

import cProfile
import hashlib
import math
import pstats
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parcela.llm import bpe, classifier, codebooks, imatch, importance, licenses, mixing, neardup, packing, quality, substrings, urls
from parcela.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import brute
from tests.llm.conftest import WORDS, edge_vectors, prose, write

OPS = [*QUERIES]


def docs_of(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def run(spark, number, sf_dir):
    name = next(n for n in OPS if n.startswith(f"op{number}_"))
    return QUERIES[name](spark, sf_dir).collect()


@pytest.mark.parametrize("name", OPS)
def test_whole_results_on_edge_cases_and_empty_tables(spark, edge, empty, name):
    rows, path = edge
    got = QUERIES[name](spark, path).collect()
    if name.startswith("op13"):
        assert Counter(r.vec_id for r in got) == Counter([*range(400), 5, 5, 5, 5, None, 500])
    elif name.startswith("op11"):  # a row a piece, a first piece a document
        assert Counter(r.doc_id for r in got if not r.start) == Counter(d for d, _, _ in rows)
    elif name.startswith("op8"):
        assert len(got) == 17
    else:
        assert Counter(r.doc_id for r in got) == Counter(d for d, _, _ in rows)
    assert QUERIES[name](spark, empty).collect() == []


def test_substring_dedup(spark, sf_dir, edge, monkeypatch):
    for hot in (substrings.HOT, 3):
        monkeypatch.setattr(substrings, "HOT", hot)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, 1, sf_dir)}
        assert got == brute.substring_dedup(docs_of(spark, sf_dir))
        assert any(n for _, n, _ in got.values())
    rows, path = edge
    single = {d: t for d, t, _ in rows if d not in (30, 31, None)}
    # ids of their own only: 30 and 31 come first where their texts repeat later
    plain = brute.substring_dedup([(d, t) for d, t, _ in rows if d is not None and d not in (31,) and (d != 30)] + [(30, next(t for d, t, _ in rows if d == 30))] + [(31, "\n".join(t for d, t, _ in rows if d == 31))])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, 1, path) if r.doc_id in single}
    assert got == {d: plain[d] for d in single}
    three = [(r.n_words, r.n_removed) for r in run(spark, 1, path) if r.doc_id == 30]
    assert three == [(400, 400)] * 3  # equal rows, equal results: document 4 has the text first


@pytest.mark.parametrize("hot", [4096, 3])
def test_substring_dedup_whatever_is_hot(spark, sf_dir, tmp_path, monkeypatch, hot):
    """The SQL's result, spans included, on a table of many files."""
    monkeypatch.setattr(substrings, "HOT", hot)
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(9).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    names = ("doc_id", "n_words", "n_removed", "kept_sha256", "n_spans")
    want = con.execute(f"select {', '.join(names)} from ({ORACLE_SQL['op1_substring_dedup']})").fetchall()
    assert sorted(tuple(r[n] for n in names) for r in run(spark, 1, str(tmp_path))) == sorted(want)


@pytest.mark.parametrize("hot", [4096, 3, 1])
def test_substring_dedup_of_rows_that_share_an_id(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = random.Random(8)
    passage = prose(rng, 30)
    others = [(d, " ".join([passage, *(f"w{i}_{k}" for k in range(20 + i))])) for i, d in enumerate([None] * 6 + [7] * 3)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(1, f"{prose(rng, 12)} {passage}")], "doc_id long, text string").write.parquet(path)
    spark.createDataFrame(others + others[:1], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    got = run(spark, 1, str(tmp_path))
    assert Counter((r.doc_id, r.n_removed, r.n_spans) for r in got) == {(1, 0, 0): 1, (None, 30, 1): 7, (7, 30, 1): 3}


def test_line_dedup(spark, sf_dir, monkeypatch):
    want = brute.line_dedup(docs_of(spark, sf_dir))
    for block in (512, 2):
        monkeypatch.setattr(neardup.cells, "__defaults__", (block,))
        assert {r.doc_id: r.removed for r in run(spark, 2, sf_dir)} == want
    assert any(want.values())


def test_line_dedup_on_edge_cases(spark, edge):
    got = {r.doc_id: r for r in run(spark, 2, edge[1]) if r.doc_id not in (30, 31, None)}
    assert (got[20].n_lines, got[21].n_lines, got[22].n_lines) == (0, 0, 0)
    assert got[82].n_lines == 500 and got[82].removed == [*range(1, 500)]
    # the common line stays once, in the first of the documents that have it
    assert got[60].removed == [2, 5] and all(got[60 + i].removed == [1, 2, 5] for i in range(1, 15))


def test_bpe(spark, sf_dir, edge):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for path in (sf_dir, edge[1]):
        want = Counter()
        for d, t in docs_of(spark, path):
            ids = own.encode(t or "", add_special_tokens=False).ids
            want[d, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), brute.sha(own.decode(ids, skip_special_tokens=False))] += 1
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, 3, path)) == want


@pytest.mark.parametrize("text", ["", "a<|endoftext|>b", "  \n\n \t x\x1c\x85y\u3000 z", "日本語🎉", "é" * 3000, "ab" * 4000, "aaaa" * 3000, "½²³ ⅷ don't I'LL"])
def test_bpe_words(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, codec = Tokenizer.from_file(path), bpe.Codec(path)
    assert codec.encode([text])[0].tolist() == own.encode(text, add_special_tokens=False).ids
    assert codec.decode(codec.encode([text])[0]) == text


def checked_fingerprints(rows, got):
    """Every document with the next one of a plain list. got: rows of op4, any order."""
    fingerprint = {t or "": None for _, t in rows}
    signed64 = lambda t: 42 if t is None else (h - (1 << 64) if (h := xxhash.xxh64_intdigest(t.encode(), seed=42)) >> 63 else h)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, signed64(r[1])), reverse=True)
    want = Counter()
    for (d, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        n = len(t) // 3
        want[d, len(t), brute.sha(t[: len(t) - n] + after[:n])] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    by_id = {d: t or "" for d, t in rows if sum(x == d for x, _ in rows) == 1}
    for r in got:
        if r.doc_id in by_id:
            t = by_id[r.doc_id]
            assert fingerprint[t] in (None, r.fingerprint)
            fingerprint[t] = r.fingerprint
    return got


def test_fingerprints(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    got = checked_fingerprints(docs, run(spark, 4, sf_dir))
    near, far = ([getattr(r, k) for r in got] for k in ("near_edited", "near_next"))
    assert sum(near) / len(near) > 0.3 and sum(far) / len(far) < 0.05
    assert imatch.edited("abcdefg", "x") == "abcdex"


def test_fingerprints_with_null_and_equal_ids(spark, edge, tmp_path):
    rows, path = edge
    checked_fingerprints([(d, t) for d, t, _ in rows], run(spark, 4, path))
    # two in five without an id, some rows equal in id, some in both
    rng = random.Random(9)
    rows = [(None if i % 5 < 2 else i, prose(rng, rng.randrange(0, 60)), "s") for i in range(200)] + [(7, prose(rng, 30), "s") for _ in range(9)]
    rows += [(None, "uno dos tres cuatro cinco seis", "s")] * 40 + [(3, "siete ocho nueve diez once doce", "s")] * 7
    checked_fingerprints([(d, t) for d, t, _ in rows], run(spark, 4, write(spark, rows, tmp_path)))


def test_fingerprints_are_the_same_whatever_the_size_of_the_lexicon(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = lambda r: r.doc_id
    assert sorted(imatch.fingerprints(docs).collect(), key=key) == sorted(imatch.fingerprints(docs, broadcast=0).collect(), key=key)


def test_fingerprints_hash_sorted_terms():
    group, term = np.array([0, 0, 0, 1, 2, 2]), np.array([3, 5, 9, 3, 3, 5], np.uint64)
    found, value = imatch.sequence_hashes(group, term)
    assert found.tolist() == [0, 1, 2] and len(set(value.tolist())) == 3 and value.dtype == np.uint64
    again = imatch.sequence_hashes(np.array([4, 4]), np.array([3, 5], np.uint64))[1]
    assert again[0] == value[2] != imatch.sequence_hashes(np.array([4, 4]), np.array([5, 3], np.uint64))[1][0]
    long = imatch.sequence_hashes(np.zeros(200, np.int64), np.arange(200, dtype=np.uint64))[1]
    assert long[0] != imatch.sequence_hashes(np.zeros(199, np.int64), np.arange(199, dtype=np.uint64))[1][0]


def test_fingerprints_of_copies(spark, tmp_path):
    rng = random.Random(3)
    copied = prose(rng, 90)
    rows = [(i, copied if i % 3 == 0 else " ".join(f"w{rng.randrange(2000)}" for _ in range(90)), "s") for i in range(300)]
    got = {r.doc_id: r for r in run(spark, 4, write(spark, rows, tmp_path))}
    # a third of the rows are copies, none of whose terms can be in the lexicon; their edited texts have some that are
    assert all(got[i].near_edited > 0.25 for i in range(0, 300, 3))
    assert all(got[i].near_next < 0.2 for i in range(300))


def test_fingerprints_of_any_two_texts_compare():
    of = lambda text: imatch.TermHashes().of(text)
    lexicon_terms = of("rare " + " ".join(f"x{i}" for i in range(640)))

    def likeness(a, b):
        terms = [of(a), of(b)]
        prints = imatch.Prints(terms, [np.isin(t, lexicon_terms) for t in terms])
        return prints, prints.likeness(np.array([0]), np.array([1]))[0]

    text = " ".join(f"w{i}" for i in range(60))
    assert likeness(text, text + " rare")[1] > 0.8  # a near copy with one rare word
    assert likeness("", text)[1] == 0 and likeness("", None)[1] == 1
    # eight times the terms: no level is shared
    prints, found = likeness(*(" ".join(f"x{i}" for i in range(n)) for n in (80, 640)))
    assert abs(prints.own.level[0] - prints.own.level[1]) >= imatch.LEVELS and 0.02 < found < 0.3


def test_quality(spark, sf_dir, edge):
    for path in (sf_dir, edge[1]):
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in run(spark, 5, path))
        assert got == Counter((d, *brute.quality_counts(t)) for d, t in docs_of(spark, path))
        assert not any(r.kept and r.base_failed for r in run(spark, 5, path))
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = [(known[r.doc_id], r.kept) for r in run(spark, 5, sf_dir) if r.doc_id in known and not r.base_failed]
    assert sum((q == 1) == k for q, k in judged) >= 0.95 * len(judged)


def test_label_model_is_plain_expectation_maximisation(spark):
    rng = random.Random(5)
    for worst, kinds in ((-1, [[0], [1], [2]]), (-2, [[0, 2], [1]])):
        rows = [tuple(rng.choice((1, 1, 1, 0, -1, worst)) for i in range(3)) for _ in range(120)] + [(-1, worst, 1)] * 20
        df = spark.createDataFrame(rows, "a int, b int, c int")
        first = quality.LabelModel.start("abc", kinds)
        strong = [[quality.STRONG[s] if worst < -1 else None for s in row] for row in quality.LabelModel.sorts(3, kinds)]
        want = brute.label_model(rows, (first.share, first.objects), strong, quality.WEIGHT, 15)
        for most in (quality.PATTERNS, 3):  # on the driver, and by Spark
            model = quality.fit_labels(df, ["a", "b", "c"], kinds, graded=worst < -1, rounds=15, most=most)
            assert model.share == pytest.approx(want[0], abs=1e-6)
            assert [x for row in model.objects for x in row] == pytest.approx([x for row in want[1] for x in row], abs=1e-6)


def made(rng, kind):
    """The text of a document of a kind; letters of one word each, so that nothing repeats by chance."""
    lines = [[f"{rng.choice(WORDS)}{rng.choice(WORDS)}" for _ in range(12)] for _ in range(8)]
    end = "" if kind == "list" else "."
    if kind == "symbols":
        lines = [[w + "$$" if rng.random() < 0.6 else w for w in x] for x in lines]
    if kind == "shouts":
        lines, end = [[w.upper() for w in x] for x in lines], "!!!!!!!!"
    return "\n".join(" ".join(x) + end for x in lines)


def test_rates_of_made_documents_are_found(spark):
    """One good document in six is a list, whose lines end without a mark: the rule's rate is found, and outvoted. Junk that
    only one rule finds is dropped all the same, and so at any size."""
    rng = random.Random(6)
    for n in (300, 3000):
        kinds = ["symbols" if i % 12 == 0 else "shouts" if i % 15 == 1 else "list" if i % 6 == 2 else "plain" for i in range(n)]
        docs = spark.createDataFrame([(i, made(rng, k)) for i, k in enumerate(kinds)], "doc_id long, text string")
        got = {r.doc_id: r[quality.P + "kept"] for r in quality.judged(docs, ["doc_id"]).collect()}
        assert got == {i: k in ("list", "plain") for i, k in enumerate(kinds)}
        names = [quality.P + "v_" + k for k in quality.votes()]
        df = quality.with_counts(docs).withColumns(dict(zip(names, quality.votes().values(), strict=True)))
        places = {rule: i for i, rule in enumerate(quality.votes())}
        model = quality.fit_labels(df, names, [[places[x] for x in kind] for kind in quality.KINDS])
        good = [k for k in kinds if k in ("list", "plain")]
        true, known = good.count("list") / len(good), quality.WEIGHT["good"]
        # START counts as some documents, so the rate of a small table leans towards it
        assert abs(model.objects[0][places["line_ends"]] - true) < 0.02 + true * known / (len(good) + known)
        assert abs(model.share[0] - len(good) / n) < 0.03
        assert all(model.objects[0][places[x]] <= quality.START["alarm"] for x in ("symbols", "shouts", "repeats"))


def test_verdicts_are_those_of_plain_counts_and_estimation(spark, sf_dir):
    """kept of the whole table, from plain votes, plain expectation-maximisation and a plain posterior."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [quality.P + "v_" + k for k in quality.votes()]
    df = quality.with_counts(docs).withColumns(dict(zip(names, quality.votes().values(), strict=True)))
    votes = {r["doc_id"]: tuple(r[c] for c in names) for r in df.select("doc_id", *names).collect()}
    places = {rule: i for i, rule in enumerate(quality.votes())}
    kinds = [[places[x] for x in kind] for kind in quality.KINDS]
    first = quality.LabelModel.start(names, kinds)
    strong = [[quality.STRONG[s] for s in row] for row in quality.LabelModel.sorts(len(names), kinds)]
    share, objects = brute.label_model([*votes.values()], (first.share, first.objects), strong, quality.WEIGHT, 60)
    for r in run(spark, 5, sf_dir):
        assert r.kept == (not r.base_failed and brute.posterior(votes[r.doc_id], share, objects, strong)[0] >= 0.5)


def test_votes_are_weighed(spark):
    """A mild objection that comes alone is outvoted, also that of a rule which finds junk together with another, and also one that
    is frequent; a strong one isn't, nor are two that come together."""
    names = ["a", "b", "c", "d", "e", "f"]
    counts = {(): 900, ((0, -1), (1, -1)): 60, ((2, -1), (3, -2)): 40, ((3, -1),): 3, ((4, -1),): 2, ((4, -2),): 1, ((5, -2),): 60, ((5, -1),): 4}
    rows = [tuple(dict(bad).get(i, 1) for i in range(6)) for bad, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    model = quality.fit_labels(df, names, [[0, 1], [2, 3], [4], [5]])
    got = df.distinct().withColumn("p", model.posterior({n: F.col(n) for n in names})).collect()
    p = {tuple((i, r[n]) for i, n in enumerate(names) if r[n] < 0): r.p for r in got}
    assert min(p[()], p[(3, -1),], p[(4, -1),]) > 0.5 > 0.2 > max(p[(0, -1), (1, -1)], p[(2, -1), (3, -2)], p[(5, -2),])


def test_rates_of_the_rules_are_estimates(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = [quality.P + "v_" + k for k in quality.votes()]
    df = quality.with_counts(docs).withColumns(dict(zip(names, quality.votes().values(), strict=True)))
    places = {rule: i for i, rule in enumerate(quality.votes())}
    kinds = [[places[x] for x in kind] for kind in quality.KINDS]
    model = quality.fit_labels(df, names, kinds)
    first = quality.LabelModel.start(names, kinds)
    assert 0.7 < model.share[0] < 0.95 and all(0 < x < 1 for row in model.objects for x in row)
    assert all(x not in row for row, xs in zip(first.objects, model.objects, strict=True) for x in xs)
    # no kind of junk is counted twice: no two have the same rates
    assert len({tuple(round(x, 6) for x in row) for row in model.objects}) == len(model.objects)


def test_mixing(spark, sf_dir, edge):
    for path in (sf_dir, edge[1]):
        source = {(r.doc_id, r.text): r.source for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
        sizes = Counter()
        for r in spark.read.parquet(f"{path}/documents.parquet").collect():
            sizes[r.source] += len(brute.words(r.text))
        want, got = brute.targets(sizes), run(spark, 6, path)
        assert {round(r.target, 6) for r in got} == {round(x, 6) for x in want.values()}
        assert all(r.taken <= 3 * r.size and r.taken == r.size * r.copies for r in got)
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, run(spark, 6, path)), key=repr)
        assert source
    taken = Counter()
    own = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = run(spark, 6, sf_dir)
    for r in got:
        taken[own[r.doc_id]] += r.taken
    assert 0.7 * sum(r.size for r in got) < sum(taken.values()) < 1.3 * sum(r.size for r in got)


def test_each_source_comes_near_its_target(spark):
    path = "/root/testdata/sf0.1"
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "source").collect()}
    taken, target = Counter(), {}
    for r in run(spark, 6, path):
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(0.8 * x <= taken[s] <= 1.25 * x for s, x in target.items())


def test_capped_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 0}
    got = mixing.source_targets(spark.createDataFrame([*sizes.items()], "source string, size long"))
    assert {r.source: round(r.target, 6) for r in got.collect()} == {k: round(v, 6) for k, v in brute.targets(sizes).items()}


def test_ngram_join(spark, sf_dir, edge, monkeypatch):
    sets = {d: brute.shingle_set(t) for d, t in docs_of(spark, sf_dir)}
    pairs = brute.similar_pairs(sets)
    comp, links = brute.groups(sets, pairs), Counter(x for p in pairs for x in p)
    for block in (512, 2):
        monkeypatch.setattr(neardup.cells, "__defaults__", (block,))
        assert {r.doc_id: (r.class_id, r.n_links) for r in run(spark, 7, sf_dir)} == {d: (comp[d], links[d]) for d in sets}
    got = {r.doc_id: (r.class_id, r.n_links) for r in run(spark, 7, edge[1]) if r.doc_id != 31}
    assert got[20] == got[21] == got[22] == (20, 3) and got[23] == (23, 0)
    assert all(got[40 + i][0] == 5 for i in range(12))


def test_urls(spark, edge):
    from tests.llm.conftest import URLS

    for r in run(spark, 8, edge[1]):
        host, path = brute.url_parts(URLS[r.page_id])
        rules = {h + p: v for h, p, v in urls.RULES}
        fit = max((x for x in rules if brute.fits(x, host, path)), key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, fit)
        assert r.verdict == rules[fit] if fit else r.verdict == ("block" if r.p_unwanted >= 0.5 else "allow")


def test_url_path_is_that_of_the_first_host(spark):
    found = ["http://example.com?u=http://b.com/en/x", "http://example.com#http://b.com/en/x", "http://example.com?u=a://b.com/de/", "http://example.com/en/?u=http://b.com/de/x", "http://://b.com/en/x", "http://example.com"]
    rows = spark.createDataFrame([(u,) for u in found], "url string")
    for r in rows.select("url", urls.host(rows.url).alias("host"), urls.path(rows.url).alias("path"), urls.rule(urls.host(rows.url), urls.path(rows.url))[0].alias("rule")).collect():
        assert (r.host, r.path) == brute.url_parts(r.url)
        assert r.rule == ("example.com/en/" if r.url.startswith("http://example.com/en/") else None)


def test_url_model_on_held_out_urls(spark):
    """Each fifth of the labelled urls judged by a model of the other four."""
    table = urls.labelled_urls(spark).withColumn("part", F.pmod(F.xxhash64("url"), F.lit(5)))
    caught = Counter()
    for part in range(5):
        held = table.filter(F.col("part") == part).withColumnRenamed("label", "y")
        for r in urls.judged(held, table.filter(F.col("part") != part), rules=()).collect():
            caught[r.y, r.judged.verdict] += 1
    assert sum(caught.values()) == table.count() >= 150
    assert caught[1.0, "block"] >= 0.8 * (caught[1.0, "block"] + caught[1.0, "allow"])  # recall
    assert caught[1.0, "block"] >= 0.92 * (caught[1.0, "block"] + caught[0.0, "block"])  # precision


def test_url_columns_of_the_caller_stay(spark):
    rows = spark.createDataFrame([(1, "http://x.net/es/1", "h", "p", "r", "v", "f"), (2, None, "h", "p", "r", "v", "f")], "id int, url string, host string, path string, rule string, verdict string, label string")
    got = sorted(urls.judged(rows, urls.labelled_urls(spark)).collect())
    assert [tuple(r)[:7] for r in got] == sorted(tuple(r) for r in rows.collect())
    assert (got[0].judged.host, got[0].judged.path, got[0].judged.rule, got[0].judged.verdict) == ("x.net", "/es/1", "net/es/", "block")
    assert (got[1].judged.host, got[1].judged.path, got[1].judged.rule) == ("", "", None)


def test_licenses(spark, sf_dir):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES:
        found = scanner.scan(f"some words before\n{text}\nand some after")
        assert [(x["license"], x["coverage"], x["start"]) for x in found] == [(name, 1.0, 3)]
    words = licenses.TEMPLATES[0][1].split()
    changed = scanner.scan(" ".join(words[:20] + ["really"] + words[20:40] + words[41:]))
    assert [x["license"] for x in changed] == ["MIT"] and 0.9 < changed[0]["coverage"] < 1
    assert scanner.scan(None) == scanner.scan("") == scanner.scan("Licensed") == []
    twice = scanner.scan("Released under the MIT License. x Released under the MIT License.")
    assert [(x["start"], x["stop"]) for x in twice] == [(0, 5), (6, 11)]
    lines = [t for _, t in licenses.TEMPLATES if len(t) < 80]
    for r, (d, t) in zip(sorted(run(spark, 9, sf_dir)), sorted(docs_of(spark, sf_dir)), strict=True):
        assert r.doc_id == d and (r.n_licenses > 0) >= any(x in t for x in lines)


def license_words(text):
    marks = licenses.MARKS.decode()
    return [w.strip(marks) or w for w in text.lower().split()]


@pytest.mark.parametrize("share", [0.05, 0.10, 0.15])
def test_licenses_against_a_full_alignment(share):
    """Templates with words changed, left out and put in, in the middle of prose: of those that a full alignment
    finds, at least nine in ten are found, each template by itself."""
    rng, scanner = random.Random(11), licenses.Scanner(licenses.TEMPLATES)
    wanted, found = Counter(), Counter()
    for name, text in licenses.TEMPLATES:
        telling = license_words(licenses.TELLING.get(name, ""))
        for _ in range(40):
            words = []
            for w in text.split():
                kind = rng.random()
                words += [w] if kind >= share else [[], ["otra"], ["otra", w]][rng.randrange(3)]
            own, template = license_words(" ".join(words)), license_words(text)
            if brute.matched(template, own) < 0.8 * len(template) or not set(telling) <= set(own):
                continue
            wanted[text] += 1
            found[text] += name in [x["license"] for x in scanner.scan(f"{prose(rng, 40)} {' '.join(words)} {prose(rng, 40)}")]
    assert all(found[t] >= 0.9 * n for t, n in wanted.items()), {t[:40]: (found[t], n) for t, n in wanted.items() if found[t] < 0.9 * n}
    assert len(wanted) == len(licenses.TEMPLATES)


def test_licenses_with_words_put_in_and_notices_within_licenses():
    scanner, rng = licenses.Scanner(licenses.TEMPLATES), random.Random(2)
    texts = dict(licenses.TEMPLATES)
    for name in ("MIT", "Apache-2.0", "GPL-3.0", "BSD", "ISC"):
        words = texts[name].split()
        middle = len(words) // 2
        got = scanner.scan(" ".join([*words[:middle], *prose(rng, 10).split(), *words[middle:]]))
        assert [(x["license"], x["coverage"], x["start"], x["stop"]) for x in got] == [(name, 1.0, 0, len(words) + 10)]
    # the notice that a license begins with doesn't hide the license, even where that has errors
    words = texts["Apache-2.0"].split()
    changed = [w if i % 9 != 8 else "otra" for i, w in enumerate(words)]
    assert [x["license"] for x in scanner.scan(" ".join(changed))] == ["Apache-2.0"]
    # a notice without its telling word is another one, or none
    for text in ("Licensed under the BSD License.", "Licensed under CC BY-NC-SA 4.0.", "Released under the Old License."):
        assert scanner.scan(text) == []
    # copies of one license after another are reported each
    got = scanner.scan(" ".join([texts["MIT"]] * 3))
    n = len(texts["MIT"].split())
    assert [(x["license"], x["start"], x["stop"]) for x in got] == [("MIT", i * n, (i + 1) * n) for i in range(3)]


def test_classifier(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    known = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    _, model = classifier.fit(docs.filter("doc_id % 2 = 0"))
    got = [(known[r.doc_id], r.kept) for r in classifier.scored(docs.filter("doc_id % 2 = 1"), model).collect() if r.doc_id in known]
    assert sum((q == 1) == k for q, k in got) >= 0.9 * len(got)


def test_classifier_of_texts_without_words_and_clashing_names(spark, tmp_path):
    rows = [(1, None, "s"), (2, "", "s"), (3, " \n ", "s")]
    assert sorted(map(tuple, run(spark, 10, write(spark, rows, tmp_path)))) == [(1, 0.0, False), (2, 0.0, False), (3, 0.0, False)]
    docs = spark.createDataFrame([(i, "uno dos tres cuatro " * 20, "a", "b") for i in range(4)] + [(9, None, "a", "b")], "doc_id int, text string, score string, kept string")
    _, model = classifier.fit(docs)
    out = classifier.scored(docs, model)
    assert out.columns == ["doc_id", "text", "score", "kept"] and dict(out.dtypes)["score"] == "double"
    assert {r.doc_id: r.kept for r in out.collect()}[9] is False


def test_classifier_on_edge_cases(spark, edge):
    got = {r.doc_id: r for r in run(spark, 10, edge[1])}
    assert all((got[i].score, got[i].kept) == (0.0, False) for i in (20, 21, 22))
    assert got[0].score == got[0].score and all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got.values())
    assert len({r.score for r in run(spark, 10, edge[1]) if r.doc_id == 30}) == 1


def pieces_by(rows, key):
    out = {}
    for r in rows:
        out.setdefault(getattr(r, key), []).append(r)
    return out


def test_packing(spark, sf_dir, edge):
    """Every id of every document lies in one piece, sequences have no gaps, and little is padded."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for path in (sf_dir, edge[1]):
        docs = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect() if r.doc_id not in (None, 30, 31)}
        got = run(spark, 11, path)
        for doc, pieces in pieces_by(got, "doc_id").items():
            if doc in docs:
                ids = [*library.encode(docs[doc] or "", add_special_tokens=False).ids, 1]
                at = 0
                for r in sorted(pieces, key=lambda r: r.start):
                    part = np.array(ids[at : at + r.length], "<u4").tobytes()
                    assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part)) and r.length > 0
                    at += r.length
                assert at == len(ids)
        sizes = []
        for own in pieces_by(got, "sequence_id").values():
            at = 0
            for r in sorted(own, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            sizes.append(at)
        padded = sum(2048 - n for n in sizes if n & (n - 1))
        assert max(sizes) <= 2048 and padded <= 0.005 * sum(sizes)


def test_packing_is_harmonic(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3, "doc_id")
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(docs, path, capacity=512, slack=0.05, end=None, powers=False).collect()
    assert {r.doc_id for r in pieces} <= {r.doc_id for r in docs.collect()} and sum(r.piece_class > 0 for r in pieces) > len(pieces) / 2
    lasts = 0
    for own in pieces_by(pieces, "sequence_id").values():
        k = max(r.piece_class for r in own)
        if k:  # as many pieces as the class says, each of its size
            assert len(own) == k and all(512 * 0.95 / k - 1 <= r.length <= 512 / k for r in own)
        else:
            lasts += sum(r.length for r in own) < 512
    assert lasts <= 3  # one that isn't full for each worker
    whole = packing.sequences(spark.createDataFrame(pieces, packing.PIECES)).collect()
    for r in whole:
        own = sorted((p for p in pieces if p.sequence_id == r.sequence_id), key=lambda p: p.offset)
        assert r.ids == b"".join(p.ids for p in own) and r.length == len(r.ids) // 4


@pytest.mark.parametrize("text", ["", "İstanbul ΣΑΣ ﬁn naïve é — “x” 日本語 mixed¡Ñ ½ 10th don't it'LL", "a<|endoftext|>b <|startoftext|>", "x" * 5000, " \x85a\xa0b\x1cc d", "'s 're're ''' $$'s"])
def test_word_codec_is_the_library(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert packing.word_codec(path).encode([text])[0].tolist() == want


def test_importance_resampling_on_edge_cases(spark, edge):
    rows, path = edge
    texts = [r.text for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    want = brute.resampled([(d, t) for d, t, _ in rows], texts)
    got = run(spark, 12, path)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=repr) == sorted((w[:4] for w in want), key=repr)
    # repeated rows tie: which of them comes first is open
    assert sorted((r.rank, r.score) for r in got if r.rank) == sorted((w[4], w[3]) for w in want if w[4])


def test_importance_of_longer_runs(spark, sf_dir, monkeypatch):
    """Runs of up to three words, in blocks of few documents, against plain counts."""
    monkeypatch.setattr(importance, "BLOCK_DOCS", 7)
    monkeypatch.setattr(importance, "HELD", 50)
    docs, target = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute.resampled(docs_of(spark, sf_dir), [r.text for r in target.collect()], n=3, buckets=500)
    got = importance.resample(docs, target, n=3, buckets=500).collect()
    assert sorted((r.doc_id, r.n_features, r.weight, r.score, r.rank or 0) for r in got) == sorted((*w[:4], w[4] or 0) for w in want)


def test_vector_codes_on_edge_cases(spark, edge):
    kept = [r for r in edge_vectors() if r[1] and len(r[1]) == 10 and all(x is not None and math.isfinite(x) for x in r[1])]
    codes, digest = brute.vector_codes(kept)
    got = run(spark, 13, edge[1])
    assert Counter((r.vec_id, r.code, r.error) for r in got) == Counter(codes) and {r.codebooks_sha256 for r in got} == {digest}
    # labels, nulls together: as many different sums as there are, each that of the rows that have it
    sums = Counter()
    for r in got:
        sums[r.label_error] += r.error
    assert all(n == total for total, n in sums.items()) and len(sums) == len({r[2] for r in kept})


def test_bounds_of_segments_lose_nothing():
    """Nearest entries through bounds are those of all distances, ties included, and bounds leave few to measure."""
    rng = np.random.default_rng(3)
    for width, spread in ((16, 300), (3, 2), (7, 1), (64, 1 << 20), (1, 5)):
        entries, x = rng.integers(-spread, spread + 1, (256, width)), rng.integers(-spread, spread + 1, (3000, width))
        entries[100:110] = entries[:10]
        x[:50] = entries[:50]
        entry, far = codebooks.Codebook(entries).nearest(x)
        all_far = np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)
        assert (entry == all_far.argmin(axis=1)).all() and (far == all_far.min(axis=1)).all()
    centres = rng.integers(-3000, 3000, (256, 1)) + rng.integers(-60, 60, (256, 16))
    book = codebooks.Codebook(centres)
    book.nearest(centres[rng.integers(0, 256, 2000)] + rng.integers(-30, 30, (2000, 16)))
    assert book.kept < 0.1 * book.asked


def test_codecs_look_words_up_once():
    """Ids of many texts at once are the library's, also when words come again; a new word costs few calls."""
    odd = ["", None, "Ab ab AB", "日本 ab ñandú", "é" * 3000, "x<|endoftext|>y \x1c\x85z", "don't 12½"]
    some = odd + [" ".join(f"w{i}x{j}" for j in range(2000)) for i in range(5)] + odd[::-1]
    for name, kind in (("word_bpe_49k.json", packing.WordCodec), ("byte_bpe_50k.json", bpe.Codec)):
        path = public_tokenizers.path(name)
        own, codec = Tokenizer.from_file(path), kind(path)
        want = [own.encode(t or "", add_special_tokens=False).ids for t in some]
        for _ in range(2):
            assert [x.tolist() for x in codec.encode(some)] == want
        codec.forget()
        assert [x.tolist() for x in codec.encode(some)] == want
    profile = cProfile.Profile()
    letters = str.maketrans("0123456789", "bcdfghjklm")
    fresh = [" ".join(f"q{i}z{j}".translate(letters) for j in range(2000)) for i in range(5)]
    profile.runcall(packing.word_codec(public_tokenizers.path("word_bpe_49k.json")).encode, fresh)
    assert pstats.Stats(profile).total_calls < 7 * 10_000
