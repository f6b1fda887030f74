"""Golden values of the scalar functions, as stated in FIXTURES.md."""

import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcela.functions import address, features, numbers, text, urls
from parcela.plans import portals
from parcela.register import register
from parcela.sources.html import PAGE_TYPE, html_page, page_of, parse_html, parse_shown


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", f(F.col("v"))).orderBy("i").collect()]


NUMBERS = {
    "1.250,50": (1250.5, 1250.5), "1,250.50": (1.2505, 1.2505), "1.250": (1250.0, 1250.0), "1.25": (1.25, 1.25), "1.2500": (1.25, 1.25), "1,250": (1250.0, 1.25), "1,25": (1.25, 1.25),
    "-34.603": (-34603.0, 34603.0), "-34.6037": (-34.6037, 34.6037), "120.000.": (120000.0, 120000.0), "5,": (5.0, 5.0), "3.": (3.0, 3.0), "1.250,50,3": (None, None), "1,250,300": (1250300.0, None),
    "1,250,": (1250.0, None), "1.250.000": (1250000.0, 1250000.0), "USD 98.500 + exp": (98500.0, 98500.0), "2 a 4 amb": (2.0, 2.0), "sin precio": (None, None), "": (None, None), None: (None, None),
}


def test_numbers(spark):
    assert column(spark, NUMBERS, numbers.parse_number) == [a for a, _ in NUMBERS.values()]
    assert column(spark, NUMBERS, numbers.parse_card_number) == [b for _, b in NUMBERS.values()]


def notations(value):
    """A number of cents in the notations that have one reading: (text, value)."""
    whole, cents = divmod(value, 100)
    points, commas = f"{whole:,}".replace(",", "."), f"{whole:,}"
    out = [(f"{whole},{cents:02d}", value / 100), (str(whole), float(whole)), (f"{whole}.{cents:02d}", value / 100)]
    if whole >= 1000:
        out += [(f"{points},{cents:02d}", value / 100), (points, float(whole))]
    if whole >= 1_000_000:
        out.append((commas, float(whole)))
    return out


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**10), st.sampled_from(["", "USD ", "$ ", "precio: "]), st.sampled_from(["", " por mes", "-"])), min_size=20, max_size=40))
def test_numbers_of_known_values(spark, found):
    texts = [(before + text + after, value) for n, before, after in found for text, value in notations(n)]
    assert column(spark, [t for t, _ in texts], numbers.parse_number) == [pytest.approx(v) for _, v in texts]


def test_numbers_outside_markup(spark):
    texts = ['<a href="12">5</a>', "&#39;7&#39;", "1.250<b>x</b>", "<!-- 3 --> 4,5 &amp; 6", None]
    assert column(spark, texts, numbers.parse_number) == [5.0, 7.0, 1250.0, 4.5, None]


def test_ranges(spark):
    got = column(spark, ["45 - 60 m²", "2 a 4 ambientes", "3 dormitorios", "45 m2 cubiertos", "ambientes", None], numbers.number_range)
    assert [(r.low, r.high) for r in got] == [(45, 60), (2, 4), (3, 3), (45, 2), (None, None), (None, None)]


def test_money(spark):
    texts = ["USD 120.000", "U$S 120.000", "US$ 120.000", "US$120.000", "USD120.000", "$ 85.000", "85.000 pesos", "5 dólares", "120.000", "", None]
    assert [r.currency for r in column(spark, texts, numbers.parse_money)] == ["USD", "USD", "ARS", "USD", None, "ARS", "ARS", "USD", None, None, None]
    assert [r.currency for r in column(spark, texts, numbers.card_money)] == ["USD", "USD", "USD", "USD", "USD", "ARS", "ARS", "ARS", "ARS", None, None]


def test_keys(spark):
    texts = ["Superficie Total (m²)", "  Baños: ", "Núñez", None]
    assert column(spark, texts, text.normalize_key) == ["superficie_total_m2", "banos", "nunez", ""]
    assert column(spark, texts, text.fold) == ["superficie total (m2)", "  banos: ", "nunez", ""]
    assert text.key_of("vista al río") == "vista_al_rio"
    said = ["Sí", "TRUE", "1", "Apto", "No", "No apto", "sin", "quizás", None]
    assert column(spark, said, text.parse_bool) == [1, 1, 1, 1, 0, 0, 0, None, None]
    assert column(spark, ["a \xa0 b\n", " ", None], text.clean_text) == ["a b", None, None]
    assert column(spark, ["<p>a &amp; b</p>", "1 < 2"], text.plain_text) == ["a & b", "1 < 2"]
    assert column(spark, ["a | | b", None], text.token_count) == [2, 0]


def test_addresses(spark):
    rows = {
        "Gorriti 4500 Piso 3 Depto B": ("Gorriti", "4500", "3", "B"), "Gorriti 4500 P. 3 uf 12": ("Gorriti", "4500", "3", "12"), "Lavalle 1234": ("Lavalle", "1234", None, None),
        "Av. Santa Fe 2.450": ("Av. Santa Fe 2.450", None, None, None), "Av. Pueyrredón 1234": ("Av. Pueyrredón", "1234", "ueyrred", None), "Palermo, Piso 3": ("Palermo", None, "alermo", None),
        "Callao 1000, 2° piso": ("Callao", "1000", "iso", None), "unidades 3": ("unidades", "3", None, "es"), ", Palermo": (None, None, "alermo", None),
    }
    assert [(r.street, r.number, r.floor, r.unit) for r in column(spark, rows, address.parse_address)] == [*rows.values()]
    cards = column(spark, ["Gorriti 4500, Palermo", "Gorriti al 4500000", "", None], address.card_address)
    assert [(r.street, r.number) for r in cards] == [("Gorriti", 4500), ("Gorriti al 4500000", None), ("", None), ("", None)]
    assert column(spark, ["Palermo Hollywood", "Núñez", "Floresta", "Paternal", None], address.commune) == [14, 13, 7, None, None]
    places = column(spark, ["Gorriti 1, Palermo, Capital Federal", "Palermo", None], address.place_parts)
    assert [tuple(r) for r in places] == [("Palermo", "Capital Federal", "Capital Federal"), (None, "Palermo", None), (None, None, None)]


def test_urls(spark):
    one = lambda f, *v: column(spark, v, f)
    assert one(lambda c: urls.page_url_a(c, F.lit(5)), "https://h/venta/x/pagina-3/") == ["https://h/venta/x/pagina-5"]
    assert one(lambda c: urls.page_url_b(c, F.lit(4)), "https://h/a-x-pagina-2.html") == ["https://h/a-x-pagina-4.html"]
    assert one(lambda c: urls.page_url_c(c, F.lit(1)), "https://h/x/") == ["https://h/x/"]
    assert one(lambda c: urls.page_url_c(c, F.lit(3)), "https://h/x/") == ["https://h/x/_Desde_97_NoIndex_True"]
    assert one(urls.canonical, "http://h/a?b=1#c") == ["http://h/a"]
    b = "https://www.zonaprop.com.ar"
    assert one(urls.is_property_b, f"{b}/x-ambientes-49823017.html", f"{b}/x-ambientes.html") == [True, False]
    assert one(urls.property_type, "https://h/departamentos/venta/z") == ["departamento"]
    assert one(urls.item_id, "https://h/MLA-123-x", "https://h/y") == ["MLA123", "https://h/y"]
    assert one(lambda c: urls.stable_id(c), "abc") == ["a9993e364706816aba3e"]
    base = F.lit("https://h/a/b?x")
    hrefs = {"c": "https://h/a/c", "/c": "https://h/c", "//k/c": "https://k/c", "../c": "https://h/c", "http://k/": "http://k/", "#z": "https://h/a/b#z"}
    assert one(lambda c: urls.resolve(base, c), *hrefs) == [*hrefs.values()]
    assert one(urls.image_id, "https://i/D_NQ_NP_1-MLA2.webp?x") == ["D_NQ_NP_1-MLA2"]
    assert one(urls.image_extension, "https://i/D_NQ_NP_1-MLA2.WEBP?x") == ["webp"]


def test_derived(spark):
    assert column(spark, ["venta en pozo, entrega inmediata", "x"], features.delivery_status) == ["entrega_inmediata", None]
    got = spark.range(1).select(text.rounded(numbers.discount_percent(F.lit(200.0), F.lit(150.0))), text.rounded(numbers.per_unit(F.lit(100000.0), F.lit(0.0))), text.rounded(features.completeness(*[F.lit(x) for x in (1, "a", 2, None, 3, "", 4)]), 1)).first()
    assert tuple(got) == (25.0, None, 71.4)


@pytest.mark.parametrize("title,visible,html,reason", [("Just a moment...", "", "", "titulo:just a moment"), ("Depto", "lindo", "<script>g-recaptcha", None), ("x", "Verify you are human", "g-recaptcha", "texto_visible:verify you are human")])
def test_block_reason(spark, title, visible, html, reason):
    assert spark.range(1).select(features.block_reason(F.lit(title), F.lit(visible), F.lit(html))).first()[0] == reason


def test_sql_functions(spark):
    assert {"parse_number", "html_links", "jsonld_objects"} <= {*register(spark)}
    assert spark.sql("select parse_number('1.250,50'), item_id('https://h/MLA-1'), canonical_url('http://h/a?b')").first()[:] == (1250.5, "MLA1", "http://h/a")
    assert spark.sql("select html_page('<title>a</title><p>b').title, size(html_page('<p>a<p>b').elements)").first()[:] == ("a", 2)


def test_sql_functions_answer_as_columns_do(spark):
    register(spark)
    texts = ["", None, "  Sí ", "Núñez", "No apto", "US$120.000", "USD 1.250,50", "<a href='12'>5</a>", "&#39;7", "1,25", "\u00a0https://h/MLA-7/\t", "https://h/venta/x/pagina-3/", "https://h/x/_Desde_97_NoIndex_True", "Palermo Hollywood"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    df.createOrReplaceTempView("texts")
    both = {
        "clean_text(s)": text.clean_text("s"), "fold(s)": text.fold("s"), "normalize_key(s)": text.normalize_key("s"), "parse_bool(s)": text.parse_bool("s"), "property_id(s)": urls.stable_id(F.col("s")), "item_id(s)": urls.item_id("s"),
        "parse_number(s)": numbers.parse_number("s"), "parse_card_number(s)": numbers.parse_card_number("s"), "currency(s)": numbers.parse_money("s")["currency"], "commune(s)": address.commune("s"),
        "page_url_a(s, 5)": urls.page_url_a("s", F.lit(5)), "page_url_c(s, 1)": urls.page_url_c("s", F.lit(1)), "page_url_c(s, 3)": urls.page_url_c("s", F.lit(3)),
    }
    got = spark.sql("select " + ", ".join(both) + " from texts").collect()
    want = df.select(*[c.alias(str(i)) for i, c in enumerate(both.values())]).collect()
    for g, w in zip(got, want, strict=True):
        assert tuple(g) == tuple(w)


def test_sql_tables(spark):
    register(spark)
    page = '<a href="/a">x</a><a>y</a><a href="/b">z</a><script type="application/ld+json">{"b": {"c": 1}}</script>'
    spark.createDataFrame([(page,), (None,)], "html string").createOrReplaceTempView("captured")
    assert sorted(map(tuple, spark.sql("select l.pos, l.href from captured, lateral html_links(html) l").collect())) == [(0, "/a"), (1, "/b")]
    assert sorted(map(tuple, spark.sql("select l.pos, l.object from captured, lateral jsonld_objects(html) l").collect())) == [(0, '{"b": {"c": 1}}'), (1, '{"c": 1}')]


def test_sql_names_of_addresses_and_ranges(spark):
    register(spark)
    texts = ["Gorriti 4500 Piso 3 Depto B", "Av. Siempre Viva", " Gorriti 4500, Palermo, Capital Federal", "piso 2", "", None, "2 a 3 ambs.", "45,5 - 1.060 m²", "1.234.567", "a, ,b", "Callao 12 unidad 7", "1.5,x 99.999", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for name, f in (("parse_address", address.parse_address), ("card_address", address.card_address), ("place_parts", address.place_parts), ("number_range", numbers.number_range)):
        rows = df.select("s", F.expr(f"{name}(s)").alias("sql"), f("s").alias("own")).collect()
        assert [(r.s, tuple(r.sql)) for r in rows] == [(r.s, tuple(r.own or (None, None))) for r in rows], name


def test_pairs_in_sql(spark):
    register(spark)
    html = """<table><tr><th>Ambientes</th><td>3</td></tr><tr><td>a</td><td>b</td><td>c</td></tr><tr><td></td><td>x</td></tr></table>
    <dl><dt>Cocheras<dd>1<dd>2<dt>Sin</dl><table><tr><th>Ambientes</th><td> 4  o 5 </td></tr></table>"""
    spark.createDataFrame([(1, html, "x"), (2, None, "y"), (3, "<p>nada</p>", None)], "id int, html string, other string").createOrReplaceTempView("some_pages")
    got = spark.sql("SELECT id, p.* FROM some_pages, LATERAL html_pairs(html) p").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "Ambientes", "3"), (1, 1, "Ambientes", "4 o 5"), (1, 2, "Cocheras", "1")]
    got = spark.sql("SELECT * FROM html_pairs(TABLE(some_pages), 'Ambientes', 'cochéras', 'nada')")
    assert got.columns == ["id", "other", "ambientes", "cocheras", "nada"]
    assert sorted(map(tuple, got.collect())) == [(1, "x", "4 o 5", "1", None), (2, "y", None, None, None), (3, None, None, None, None)]
    plan = portals.table_pairs(F.col("doc.elements"), F.col("doc.texts"))
    own = spark.table("some_pages").select("id", parse_html(F.col("html")).alias("doc")).select("id", F.posexplode(plan)).collect()
    assert sorted((r.id, r.pos, r.col.k, r.col.v) for r in own) == [(1, 0, "Ambientes", "3"), (1, 1, "Ambientes", "4 o 5"), (1, 2, "Cocheras", "1")]


def test_parsing_holds_a_part_of_a_batch():
    """What a worker holds doesn't grow with the pages of a batch."""
    html = '<div class="card"><a href="/a">x</a><p>Depto <b>lindo</b></p></div>' * 200
    peaks, parse = [], html_page().func
    for n in (60, 600):
        batch = pa.array([html] * (n - 2) + [None, ""], pa.string())
        tracemalloc.start()
        rows = sum(len(part) for part in parse(iter([batch, pa.array([], pa.string())])))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert rows == n
    assert peaks[1] < 1.5 * peaks[0]
    some = [html, None, "<p>a"] * 40
    assert [x for part in parse(iter([pa.array(some)])) for x in part.to_pylist()] == pa.array([page_of(x) for x in some], PAGE_TYPE).to_pylist()


def test_classes_need_no_elements(spark):
    """What block_reason() reads is the same without the page's elements, which the plan of classified() doesn't carry."""
    some = ["<title> a  b</title><p>c<noscript>d</noscript>", None, "", "<title></title>x", "<style>a</style><title>b"]
    df = spark.createDataFrame([(1, x) for x in some], "id int, html string")
    for r in df.select(parse_html(F.col("html")).alias("whole"), parse_shown(F.col("html")).alias("shown")).collect():
        assert (r.whole and (r.whole.title, r.whole.visible)) == (r.shown and tuple(r.shown))
    plan = portals.classified(df.withColumn("status", F.lit(200)))._jdf.queryExecution().optimizedPlan().toString()
    assert "html_shown" in plan and "html_page" not in plan
