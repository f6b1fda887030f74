"""The stages against plain statements of them, each on its own input."""

from collections import Counter

import corpus_pipeline
from parcela.llm import jaccard, lines, mixing, quality
from tests.llm import brute


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "mix_sources", "bpe"]
    kept = quality.stage(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert {d for d, _ in rows(kept)} == {r.doc_id for r in quality.op5_quality_rules(spark, sf_dir).filter("kept").collect()}
    kept.write.parquet(one := f"{spark.conf.get('spark.checkpoint.dir')}/one")
    kept = spark.read.parquet(one)
    gone = brute.line_dedup(rows(kept))
    cut = lines.stage(spark, kept, sf_dir)
    assert cut.columns == docs.columns
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(gone[d])) for d, t in rows(kept)}
    assert dict(rows(cut)) == want
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    cut.write.parquet(two := f"{spark.conf.get('spark.checkpoint.dir')}/two")
    cut = spark.read.parquet(two)
    one_each = jaccard.stage(spark, cut, sf_dir)
    sets = {d: brute.shingle_set(t) for d, t in rows(cut)}
    comp = brute.groups(sets, brute.similar_pairs(sets))
    assert one_each.columns == docs.columns and sorted(d for d, _ in rows(one_each)) == sorted({*comp.values()})
    mixed = mixing.stage(spark, one_each, sf_dir)
    assert mixed.columns == docs.columns and max(Counter(d for d, _ in rows(mixed)).values()) <= 3


def test_run(spark, sf_dir, edge, empty):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and out.filter("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, edge[1]).filter("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, empty).collect() == []
