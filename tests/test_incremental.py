"""Journals, snapshots, streams and dead letters."""

import time

import pytest
from pyspark.sql import functions as F

from parcela.functions import address
from parcela.operators import incremental as inc
from parcela.operators.observed import Counters, ProgressTable
from parcela.sources import files, snapshots, tables
from parcela.sources.keys import KnownKeys
from parcela.streaming import crawl, journal

LINES = ['{"url":"a","n":1}', '{"url":"b","n":null,"extra":5}', '{"url":"a","n":2}', '{"n":9}', '{"url":"c","n']


def test_journal(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text("\n".join(LINES))
    rows = tables.read_journal(spark, str(tmp_path / "j.jsonl"), "url string, n int", offset="at")
    assert rows.count() == 4
    assert {(r.url, r.n) for r in inc.latest(rows, "url", "at").collect()} == {("a", 2), ("b", None)}
    assert {r.url for r in tables.journal_keys(spark, str(tmp_path / "j.jsonl"), "url").collect()} == {"a", "b"}


def test_snapshot_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'x "y", z'), ("b", None)], "url string, titulo string")
    tables.write_snapshot(rows, str(tmp_path / "s"), ["url", "titulo"], 1)
    assert next((tmp_path / "s").glob("part-*")).read_text().splitlines() == ["url,titulo", 'a,"x ""y"", z"', "b,"]
    tables.append_journal(rows, str(tmp_path / "j"))
    assert '"titulo":null' in "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    assert tables.state(rows.selectExpr("url", "1 as page"), "url", "page").first()[:] == (1, 2)


def test_joins_and_limits(spark):
    found = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "url string, pos int")
    known = spark.createDataFrame([("a",), ("a",), (None,)], "url string")
    assert {r.url for r in inc.new_only(found, known, "url").collect()} == {"b", "c", None}
    good, dead = inc.matched_or_failed(found, known.distinct(), "url", "falta")
    assert [r.url for r in good.collect()] == ["a"] and {(r.url, r.reason) for r in dead.collect()} == {("b", "falta"), ("c", "falta"), (None, "falta")}
    assert [r.pos for r in inc.budget(found, ["pos"], 2).collect()] == [1, 2] and inc.budget(found, ["pos"], -1).count() == 0
    flags = spark.createDataFrame([(1, False), (2, True), (3, False), (4, True), (5, True)], "page int, empty boolean")
    assert inc.stop_page(flags, "page", "empty").first()[0] == 5
    three = spark.createDataFrame([(p, p in (1, 2, 4, 5, 6, 7)) for p in range(9)] + [(1, True)], "page int, empty boolean")
    assert inc.stop_page(three, "page", "empty", 3).first()[0] == 6 and inc.stop_page(three, "page", "empty", 5).first()[0] is None


def test_stream_is_taken_up_again(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run():
        rows = journal.captured_rows(spark, src, "url string, n int")
        journal.write_journal(journal.first_wins(rows, "url"), out, state).awaitTermination()
        return sorted(r.url for r in spark.read.schema("url string, n int").parquet(out).collect())

    spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "url string, n int").coalesce(1).write.mode("append").json(src)
    assert run() == ["a", "b"]
    spark.createDataFrame([("a", 3), ("c", 1)], "url string, n int").coalesce(1).write.mode("append").json(src)
    assert run() == ["a", "b", "c"]


def test_dead_letters(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", None), ("b", "error")], "url string, reason string").coalesce(1).write.option("ignoreNullFields", "false").json(src)
    rows = journal.captured_rows(spark, src, "url string, reason string")
    journal.with_dead_letters(rows, "reason", str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "state")).awaitTermination()
    assert [r.url for r in spark.read.parquet(str(tmp_path / "good")).collect()] == ["a"]
    assert [r.url for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == ["b"]


def test_snapshots_at_a_cadence(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run():
        rows = journal.captured_rows(spark, src, "url string, n int")
        journal.with_snapshots(rows, "url", "n", out, state, every=1).awaitTermination()
        return {r.url: r.n for r in spark.read.option("header", "true").schema("url string, n int, first_seen int").csv(f"{out}/snapshot").collect()}

    spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "url string, n int").coalesce(1).write.mode("append").json(src)
    assert run() == {"a": 2, "b": 1}
    spark.createDataFrame([("a", 3), ("c", 1)], "url string, n int").coalesce(1).write.mode("append").json(src)
    assert run() == {"a": 3, "b": 1, "c": 1}
    got = spark.read.json(f"{out}/state").first()
    assert (got["last"], got["n_keys"]) == (3, 3)


def test_first_contained_in_small_and_large_lookups(spark):
    texts = [("villa luro norte",), ("el retiro",), ("a",), ("",), (None,), ("zz top",), ("el retiro",)]
    lookup = [(3, "retiro", 1), (1, "villa luro", 10), (2, "luro", 7), (5, "a", 5), (4, "zz", 4), (6, "nada de esto", 6)]
    df, table = spark.createDataFrame(texts, "t string"), spark.createDataFrame(lookup, "ord int, k string, v int")
    want = sorted([("villa luro norte", "villa luro", 10), ("el retiro", "retiro", 1), ("el retiro", "retiro", 1), ("a", "a", 5), ("", None, None), (None, None, None), ("zz top", "zz", 4)], key=repr)
    for most in (10, 2):
        assert sorted(map(tuple, address.first_contained(df, "t", table, most).select("t", "k", "v").collect()), key=repr) == want


def test_latest_of_several_appends(spark, tmp_path):
    """Whatever Spark calls the files: the latest line is that of the last append, and of a commit's rows the last."""
    for run in range(3):
        path = str(tmp_path / f"j{run}")
        for n in range(4):
            rows = spark.createDataFrame([("a", 10 * n + i) for i in range(5)] + [(f"k{n}", n)], "url string, n int")
            assert tables.append_journal(rows.repartition(1) if n % 2 else rows, path) == n + 1
        got = {r.url: (r.n, r.first_seen.commit) for r in inc.latest(tables.read_journal(spark, path, "url string, n int", offset="at"), "url", "at").collect()}
        assert got["a"] == (34, 1) and got["k2"] == (2, 3) and len(got) == 5


def test_commits_count_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "j"), spark.createDataFrame([("a", 1)], "url string, n int")
    read = lambda: sorted((r.url, r.n) for r in tables.read_journal(spark, path, "url string, n int").collect())
    tables.append_journal(rows, path)

    def stopped(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(files, "publish", stopped)
        with pytest.raises(KeyboardInterrupt):
            tables.append_journal(spark.createDataFrame([("b", 2)], "url string, n int"), path)
    assert read() == [("a", 1)]
    (tmp_path / "j/came.json").write_text('{"url":"z","n":0}\n{"url":"torn')  # a file of another writer
    tables.append_journal(spark.createDataFrame([("c", 3)], "url string, n int"), path)
    tables.append_journal(rows.limit(0), path)
    assert read() == [("a", 1), ("c", 3), ("z", 0)]
    # another run takes the number first
    real = files.publish
    with monkeypatch.context() as m:
        m.setattr(files, "publish", lambda s, p, t: real(s, p, "other") and False if p.endswith("3") else real(s, p, t))
        assert tables.append_journal(spark.createDataFrame([("d", 4)], "url string, n int"), path) == 4
    files.delete(spark, f"{path}/_log/0000000003")
    assert ("d", 4) in read()


def test_merged_snapshots(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = lambda *r: spark.createDataFrame([*r], "url string, n int, v string")
    read = lambda: sorted((r.url, r.n, r.v, r.first_seen) for r in snapshots.read(spark, path).collect())
    assert snapshots.read(spark, path) is None
    many = [(f"u{i}", 1, "x") for i in range(200)]
    first = snapshots.merge(rows(*many, ("u0", 0, "early"), (None, 9, "no key")), path, "url", "n", buckets=16, batch=0)
    assert first["count"] == 16 and sum(b["rows"] for b in first["buckets"].values()) == 200
    before = read()
    assert before[0] == ("u0", 1, "x", 0)
    second = snapshots.merge(rows(("u7", 5, "new"), ("u7", 4, "old"), ("u8", 0, "older")), path, "url", "n", batch=3)
    assert {r[0]: r[1:] for r in read()} == {r[0]: r[1:] for r in before} | {"u7": (5, "new", 1), "u8": (1, "x", 0)}
    # only the buckets of the two keys were written
    new = [b for b, x in second["buckets"].items() if x["version"] == 2]
    assert len(new) <= 2 and {x["version"] for x in second["buckets"].values()} == {1, 2}
    assert {int(n.partition("=")[2]) for n in files.names(spark, f"{path}/v=2") if n.startswith("bucket=")} == {int(b) for b in new}
    assert snapshots.merge(rows(("u7", 99, "again")), path, "url", "n", batch=3) == second  # a batch that is run again


def test_a_merge_that_ends_early_leaves_the_snapshot(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    rows = lambda *r: spark.createDataFrame([*r], "url string, n int")
    read = lambda: sorted(map(tuple, snapshots.read(spark, path).collect()))
    snapshots.merge(rows(("a", 1), ("b", 1)), path, "url", "n", buckets=4)

    def stopped(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(files, "publish", stopped)
        with pytest.raises(KeyboardInterrupt):
            snapshots.merge(rows(("a", 2), ("c", 2)), path, "url", "n")
    assert read() == [("a", 1, 1), ("b", 1, 1)]
    snapshots.merge(rows(("a", 3)), path, "url", "n")
    snapshots.merge(rows(("b", 4)), path, "url", "n")
    assert read() == [("a", 3, 1), ("b", 4, 1)]
    snapshots.vacuum(spark, path, keep=1)
    assert read() == [("a", 3, 1), ("b", 4, 1)]


def test_csv_for_spreadsheets_and_in_place(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a", 'x "y", z'), ("b", None)], "url string, titulo string")
    path = tmp_path / "s"
    tables.write_snapshot(rows, str(path), parts=1, excel=True)
    want = '﻿url,titulo\r\na,"x ""y"", z"\r\nb,\r\n'.encode()
    assert next(path.glob("part-*")).read_bytes() == want
    with monkeypatch.context() as m:
        m.setattr(files, "replace", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            tables.write_snapshot(rows.limit(1), str(path), parts=1)
    assert next(path.glob("part-*")).read_bytes() == want
    tables.write_snapshot(rows.limit(1), str(path), parts=1)
    assert next(path.glob("part-*")).read_text().splitlines()[0] == "url,titulo" and not files.exists(spark, f"{path}.old")


def test_crawl_is_taken_up_again(spark, tmp_path):
    crawl.use_rocksdb(spark)
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    pages = {
        1: (True, ["a", "b", "a"]), 2: (True, ["b", "c"]), 3: (False, None), 4: (True, ["d", None, ""]), 5: (True, []),
        6: (False, None), 7: (True, ["e"]), 8: (True, ["f"]),
    }

    def put(*numbers, search="s"):
        rows = [(search, n, *pages[n]) for n in numbers]
        spark.createDataFrame(rows, crawl.PAGES).coalesce(1).write.mode("append").json(src)

    def run():
        events = crawl.crawl(crawl.captured_pages(spark, src))
        events.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.schema(crawl.EVENTS).parquet(out).collect()
        last = max((r for r in got if r.kind == "page" and r.search_url == "s"), key=lambda r: r.page)
        return sorted((r.page, r.url) for r in got if r.kind == "link" and r.search_url == "s"), (last.page, last.last_completed, last.empty_in_a_row, last.n_links, last.ended)

    put(2, 1)  # in one file: sorted
    assert run() == ([(1, "a"), (1, "b"), (2, "c")], (2, 2, 0, 3, False))
    put(2, 3, 4)  # a page that comes again
    assert run() == ([(1, "a"), (1, "b"), (2, "c"), (4, "d")], (4, 4, 0, 4, False))
    put(1, search="t")
    put(5)
    assert run()[1] == (5, 5, 1, 4, False)
    put(6, 7)
    put(8)
    links, last = run()
    assert last == (6, 5, 2, 4, True) and len(links) == 4  # two in a row: the end; what comes later is dropped


def test_known_keys_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "keys")
    known = KnownKeys(spark, path, buckets=8)
    found = spark.createDataFrame([(f"k{i % 50}", i) for i in range(200)] + [(None, -1)], "url string, n int")
    assert known.new_only(found, "url").count() == 201
    known.add(found.filter("n < 20"), "url")
    known.add(found.filter("n < 30"), "url")
    assert sorted(r[0] for r in known.table().collect()) == sorted(f"k{i}" for i in range(30))  # each once
    new = known.new_only(found, "url")
    assert {r.url for r in new.collect()} == {None, *(f"k{i}" for i in range(30, 50))}
    plan = new._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    side = plan[plan.index("known_key") :]
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and "Exchange" not in side[side.index("FileScan") - 200 :].split("FileScan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastExchange" not in plan
    known.compact()
    assert known.new_only(found, "url").count() == new.count() and len(list((tmp_path / "keys").glob("part-*"))) <= 8
    spark.sql(f"DROP TABLE {known.name}")  # a session that doesn't know it yet
    assert KnownKeys(spark, path, buckets=8).new_only(found, "url").count() == new.count()


def test_counters_of_batches_and_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "url string, n int")
    counters = Counters(spark)
    watched = counters.watch(rows, "rows", n_known=F.count("n"), most=F.max("n"))
    watched.write.parquet(str(tmp_path / "out"))
    assert counters.found == {"rows": {"n_rows": 3, "n_known": 2, "most": 3}}
    counters.save(str(tmp_path / "counters"))
    assert spark.read.json(str(tmp_path / "counters")).first()[:] == ('{"most": 3, "n_known": 2, "n_rows": 3}', "rows")
    rows.coalesce(1).write.option("ignoreNullFields", "false").json(str(tmp_path / "in"))
    table = ProgressTable(spark, str(tmp_path / "progress"))
    spark.streams.addListener(table)
    try:
        stream = journal.captured_rows(spark, str(tmp_path / "in"), "url string, n int").observe("seen", F.count("n").alias("n_known"))
        journal.write_journal(stream, str(tmp_path / "journal"), str(tmp_path / "state")).awaitTermination()
        for _ in range(100):
            if any(not n.startswith(".") for n in files.names(spark, table.path)):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(table)
    got = spark.read.json(table.path).first()
    assert (got["n_input"], got["observed"]["seen"]["n_known"]) == (3, 2)
