"""The corpus pipeline: STAGES in order, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes what a stage returns as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from parcela.llm import bpe, jaccard, lines, mixing, quality
from parcela.llm.common import documents, materialize

STAGES = [
    ("quality_rules", quality.stage),
    ("line_dedup", lines.stage),
    ("ngram_join", jaccard.stage),
    ("mix_sources", mixing.stage),
    ("bpe", bpe.stage),
]

#: SQL has neither MinHash groups nor merges; tests hold the result against plain statements of the stages.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if i == len(STAGES) - 1 else materialize(docs, name)
    return docs
