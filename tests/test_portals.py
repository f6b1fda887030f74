"""Synthetic pages through the three portals' plans."""

import tracemalloc
from html.parser import HTMLParser

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcela import portal_queries
from parcela.functions import numbers
from parcela.functions.address import parse_address
from parcela.functions.text import once
from parcela.plans import portals
from parcela.plans.schema import CARD, LISTING, unified
from parcela.sources.html import Elements, html_page

DETAIL = """<html><head><title>Depto</title><meta property="og:title" content=""><meta name="description" content="Lindo con piscina y luz">
<script type="application/ld+json">{broken</script>
<script type="application/ld+json">{"@graph":[{"@type":"Offer","name":"no"},{"@type":["Thing","Apartment"],"name":"Depto lindo","sku":"abc","offers":[{"price":"98.500","priceCurrency":"USD"}],
"address":{"streetAddress":"Gorriti 4500 Piso 3 Depto B","addressLocality":"Palermo"},"image":["a.jpg","b.jpg"],"x":{"@type":"GeoCoordinates","latitude":"-34.6037"}}]}</script></head>
<body><table><tr><th>Superficie cubierta</th><td>45 m²</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table><dl><dt>Ambientes<dd>3</dl>
<ul><li class="feature">Balcón</li><li class="feature">Apto crédito: No</li><li class="feature">uno dos tres cuatro cinco seis</li></ul></body></html>"""
LIST_A = """<div class="listing__item"><article><a class="card" href="/departamento-en-venta-1?x=1#y"><h2>Uno</h2></a><p class="card__price">USD 98.500</p><p>Expensas $ 45.000</p>
<p class="card__address">Gorriti 4500</p> 3 ambientes 2 dormitorios 45 m² totales 40 m² cubiertos<img src="i.jpg"></article></div>
<div class="listing__item"><article><a class="card" href="/departamento-en-venta-1?z=2"><h2>Otra vez</h2></a></article></div>
<article><a href="/departamento-en-venta-fuera">no</a></article>"""
LIST_B = """<div data-posting-type="PROPERTY"><a data-to-posting="/x-ambientes-49823017.html" href="/x-ambientes-49823017.html">ver</a><div data-qa="POSTING_CARD_PRICE">USD 10</div><div data-qa="POSTING_CARD_EXPENSES">$ 5</div></div>"""
CARDS = """<ol><li class="ui-search-layout__item"><p>sin enlace</p></li>
<li class="x ui-search-layout__item"><a class="poly-component__title" href="https://h/MLA-7-x?p#q">Depto con balcón</a><span class="poly-price__current">US$ 120.000</span>
<span class="poly-component__location">Gorriti 4500, Palermo, Capital Federal</span><ul><li class="poly-attributes_list__item">2 a 3 ambs.</li><li class="poly-attributes_list__item">45 - 60 m² cubiertos</li></ul>
<img src="https://i/D_NQ_NP_1-MLA2.webp"></li><li class="ui-search-layout__item"><a class="poly-component__title" href="https://h/MLA-7-y">Repetido</a></li></ol>"""


def pages(spark, *rows):
    return spark.createDataFrame([(u, s, 1, 200, h) for u, s, h in rows], "url string, search_url string, page int, status int, html string")


def test_detail(spark):
    got = portals.detail(pages(spark, ("https://www.argenprop.com/depto-1", "s", DETAIL), ("u", "s", None)), portals.PORTAL_A)
    assert got.columns == [n for n, _ in LISTING] and len(LISTING) == 95
    row = got.filter("url <> 'u'").first()
    want = {
        "titulo": "Depto lindo", "moneda": "USD", "precio": 98500.0, "calle": "Gorriti", "altura": "4500", "piso": "3", "unidad": "B", "localidad": "Palermo", "latitud": -34.6037, "ambientes": 3, "superficie_cubierta_m2": 45.0,
        "superficie_total_m2": 45.0, "balcon": 1, "apto_credito": 0, "pileta": 1, "electricidad": 1, "terraza": 0, "cantidad_imagenes": 2, "imagen_principal": "a.jpg", "pais": "Argentina", "parse_warnings": None, "precio_m2_calculado": 2188.89,
    }
    assert {k: row[k] for k in want} == want
    assert got.filter("url = 'u'").first()["parse_warnings"] is not None


def test_listing_a(spark):
    rows = portals.listing(pages(spark, ("https://www.argenprop.com/departamentos/venta/palermo", "https://www.argenprop.com/departamentos/venta/palermo", LIST_A)), portals.PORTAL_A).collect()
    assert [r["url"] for r in rows] == ["https://www.argenprop.com/departamento-en-venta-1"]
    r = rows[0]
    assert (r["titulo"], r["precio"], r["moneda"], r["expensas"], r["ambientes"], r["dormitorios"], r["superficie_total_m2"], r["superficie_cubierta_m2"]) == ("Uno", 98500.0, "USD", 45000.0, 3, 2, 45.0, 40.0)
    assert (r["tipo_operacion"], r["tipo_propiedad"], r["calle"], r["imagen_principal"], r["balcon"]) == ("venta", "departamento", "Gorriti", "i.jpg", None)


def test_listing_b(spark):
    rows = portals.listing(pages(spark, ("https://www.zonaprop.com.ar/a-venta-b.html", "https://www.zonaprop.com.ar/a-venta-b.html", LIST_B)), portals.PORTAL_B).collect()
    assert [(r["url"], r["precio"], r["expensas"], r["tipo_operacion"]) for r in rows] == [("https://www.zonaprop.com.ar/x-ambientes-49823017.html", 10.0, 5.0, "venta")]


def test_cards(spark):
    got = portals.cards(pages(spark, ("https://h/l", "https://h/l", CARDS)))
    assert got.columns == [n for n, _ in CARD] and len(CARD) == 60
    (r,) = got.collect()
    want = {
        "item_id": "MLA7", "url": "https://h/MLA-7-x", "posicion_pagina": 2, "moneda": "USD", "precio": 120000.0, "barrio": "Palermo", "comuna": 14, "ambientes_min": 2, "ambientes_max": 3, "superficie_min_m2": 45.0, "superficie_max_m2": 60.0,
        "tipo_superficie": "cubierta", "precio_m2_min": 2000.0, "balcon": 1, "calle": "Gorriti", "altura": 4500, "imagen_id": "D_NQ_NP_1-MLA2", "es_rango_superficie": 1, "cantidad_atributos": 2,
    }
    assert {k: r[k] for k in want} == want
    assert portals.enrich(got).collect() == got.collect()


def test_classified_and_unified(spark):
    p = pages(spark, ("a", "s", "<title>Access denied</title>"), ("b", "s", "<p>hola</p>"), ("c", "s", None))
    assert {r.url: r.response for r in portals.classified(p).collect()} == {"a": "blocked", "b": "ok", "c": "missing"}
    detail = portals.detail(pages(spark, ("https://www.argenprop.com/depto-1", "s", DETAIL)), portals.PORTAL_A)
    both = unified(detail, portals.cards(pages(spark, ("https://h/l", "https://h/l", CARDS))))
    assert dict(both.dtypes)["altura"] == "string" and both.count() == 2


@pytest.mark.parametrize("name, pages_of", [("portal_listing", portal_queries.results_a), ("portal_b_listing", portal_queries.results_b)])
def test_listing_pages_in_bounded_memory(spark, sf_dir, name, pages_of):
    """A worker of the query parses its pages once, and holds no more of a batch of ten times the pages but their text."""
    plan = portal_queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    html = [r.html for r in pages_of(spark, sf_dir).filter(F.length("html") < 40_000).limit(15).collect()]
    assert len(html) == 15
    peaks, parse = [], html_page().func
    for times in (4, 40):
        batch, rows = pa.array(html * times, pa.string()), 0
        tracemalloc.start()
        for part in parse(iter([batch])):
            rows += len(part)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert rows == len(batch)
    assert peaks[1] < 1.3 * peaks[0]


@pytest.mark.parametrize("name", ["portal_b_listing", "portal_listing"])
def test_listing_is_dealt_over_the_cores(spark, sf_dir, name):
    """Pages of one small file are work for every core."""
    assert portal_queries.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_texts_are_read_once(spark):
    """What is worked out of a text inside a lambda is bound, not written out wherever it is named."""
    one, patterns = spark.createDataFrame([("USD 1",)], "s string"), (r"(?U)\s+", "[0-9]")
    for f, most in ((numbers.parse_money, (4, 2)), (parse_address, (2, 4)), (numbers.number_range, (0, 2))):
        plan = one.select(once(f, "s"))._jdf.queryExecution().optimizedPlan().toString()
        assert all(plan.count(p) <= n for p, n in zip(patterns, most, strict=True)), f.__name__


class Plain(Elements):
    """Without matches of simple tags: HTMLParser reads everything."""

    updatepos = HTMLParser.updatepos


def test_simple_tags_are_read_by_one_match(monkeypatch):
    steps, parse = [], HTMLParser.parse_starttag
    monkeypatch.setattr(HTMLParser, "parse_starttag", lambda self, i: steps.append(i) or parse(self, i))
    pieces = [
        DETAIL, LIST_A, LIST_B, CARDS, "<p>a < b & c &amp; d\xa0\x1c e</p >", "<a b='1' c=2 d>x</a b=\">\">", "<div\xa0class='x'><div\x0bid=\"y\">", "<!-- a > b --><!doctype html><?pi ?><![CDATA[x]]>", "<script>if (a<b) {'</p>'}</script><style>a>b</style>",
        "<TITLE>T &copy <b></title>", "<br/><p/><a / >", '<a b="1"c="2" B="3" b="4"', "</>text</ x><\x00a>&#x41", '<input disabled value="&quot;x>"><p\n\tclass="u  v">', "<template>a</template><noscript>b</noscript>",
    ]
    columns = "tags parents lasts t0s t1s depths ups attrs texts shown scripts".split()
    for i, x in enumerate(pieces):
        for y in ["", *pieces[i:]]:
            got, want = vars(Elements(x + y)), vars(Plain(x + y))
            assert {k: got[k] for k in columns} == {k: want[k] for k in columns}, x + y
    steps.clear()
    assert len(Elements('<div class="card"><a href="/a?b=1&amp;c">Depto <b>lindo</b></a><br></div>' * 100).tags) == 400
    assert len(steps) <= 1


def test_cards_are_dealt_over_the_cores(spark, sf_dir):
    plan = portal_queries.QUERIES["portal_cards"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
