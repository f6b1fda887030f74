import hashlib

import pytest

from parcela.jobs import Options, run
from tests.test_portals import CARDS


def test_a_run_and_the_next(spark, tmp_path):
    rows = [("https://h/l1", 1, 200, CARDS), ("https://h/l2", 2, 200, CARDS.replace("MLA-7", "MLA-8")), ("https://h/l3", 3, 404, ""), ("https://h/l4", 4, 200, "<title>Access denied</title>")]
    spark.createDataFrame(rows, "url string, page int, status int, html string").write.parquet(str(tmp_path / "pages"))
    options = Options(str(tmp_path / "pages"), str(tmp_path / "out"), "c", "cards", max_pages=1)
    run(spark, options)
    ids = lambda: sorted(r.item_id for r in spark.read.parquet(str(tmp_path / "out/journal")).collect())
    assert ids() == ["MLA7"]
    run(spark, Options(options.input, options.output, "c", "cards"))
    assert ids() == ["MLA7", "MLA8"]
    assert {r.reason for r in spark.read.json(str(tmp_path / "out/failures")).collect()} == {"not_found", "blocked:titulo:access denied"}
    assert spark.read.json(str(tmp_path / "out/state")).first()["unique_properties"] == 2
    # a run that is repeated changes nothing
    failures = spark.read.json(str(tmp_path / "out/failures")).count()
    run(spark, Options(options.input, options.output, "c", "cards"))
    assert ids() == ["MLA7", "MLA8"] and spark.read.json(str(tmp_path / "out/failures")).count() == failures == 2


def test_a_run_ends_at_empty_pages_and_knows_the_last_completed(spark, tmp_path):
    of = lambda n: CARDS.replace("MLA-7", f"MLA-{n}")
    rows = [(1, 200, of(1)), (2, 200, "<p>nada"), (3, 200, of(3)), (4, 200, "<p>nada"), (5, 200, "<p>nada"), (6, 200, of(6)), (7, 202, "<p>luego")]
    spark.createDataFrame([(f"https://h/l{p}", p, s, h) for p, s, h in rows], "url string, page int, status int, html string").write.parquet(str(tmp_path / "pages"))
    read = lambda name: spark.read.json(str(tmp_path / "out" / name))
    run(spark, Options(str(tmp_path / "pages"), str(tmp_path / "out"), "c", "cards", max_properties=1))
    assert sorted(r.item_id for r in spark.read.parquet(str(tmp_path / "out/journal")).collect()) == ["MLA1"]
    assert read("state").first()["last_completed_page"] == 2  # page 3 has a row left
    run(spark, Options(str(tmp_path / "pages"), str(tmp_path / "out"), "c", "cards"))
    assert sorted(r.item_id for r in spark.read.parquet(str(tmp_path / "out/journal")).collect()) == ["MLA1", "MLA3"]  # page 6 lies beyond two empty ones
    assert read("state").first()["last_completed_page"] == 6 and [r.key for r in spark.read.parquet(str(tmp_path / "out/diagnostics")).collect()] == [hashlib.sha1(b"https://h/l7").hexdigest()[:10]]


@pytest.mark.parametrize("bad", [{"mode": "cards"}, {"portal": "c"}, {"page_start": 0}, {"max_pages": -1}])
def test_options(bad):
    with pytest.raises(ValueError):
        Options("i", "o", **bad)
