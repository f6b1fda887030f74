"""Every query that SQL can express against DuckDB; the others run."""

import hashlib

import pytest

import __spark_entry__ as entry
from parcela.queries import ORACLE_SQL, QUERIES
from tests.oracle import duck_rows, spark_rows


@pytest.mark.parametrize("name", [*QUERIES])
def test_query(spark, sf_dir, name):
    rows, names = spark_rows(QUERIES[name](spark, sf_dir))
    assert rows or name == "anti_join_new"
    if name in ORACLE_SQL:
        assert (rows, names) == duck_rows(ORACLE_SQL[name], sf_dir)


def test_key_of_a_whole_text(spark, tmp_path):
    start = "Dirección " * 40
    rows = [(1, start + "a"), (2, start + "b"), (3, start.upper() + "Á!"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.key_md5 for r in QUERIES["fold_key_whole"](spark, str(tmp_path)).collect()}
    assert got[1] == got[3] == hashlib.md5(("direccion_" * 40 + "a").encode()).hexdigest()
    assert got[2] != got[1] and got[4] == hashlib.md5(b"").hexdigest()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert QUERIES.keys() <= entry.queries().keys() and entry.oracle_sql().keys() <= entry.queries().keys()
