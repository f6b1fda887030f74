"""Queries over the portals' plans: pages of the test tables dressed as a portal's pages, and in SQL what each
plan must read from them. The SQL reads page_id alone, so it is a statement of the result and not of the way to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.functions import features
from parcela.plans import portals
from parcela.plans.schema import CARD, LISTING
from parcela.register import register

SITE_A, SITE_B, SITE_C = "https://www.argenprop.com", "https://www.zonaprop.com.ar", "https://x.example"
SEARCH_A, SEARCH_B = f"{SITE_A}/departamentos/venta/palermo", f"{SITE_B}/departamentos-venta-palermo.html"
#: Cards on a results page.
PER_PAGE = 48
PAGES_SQL = "select page_id as n, page_id::int as page from pages"
CARDS_SQL = f"select page_id as n, page_id::int as page, k from pages, (select unnest(range({PER_PAGE})) as k)"


def text(template: str, **values: Column) -> Column:
    """The template with the values in place of their names in braces."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def repeated(template: str, **of) -> Column:
    """The template for each card of a page. of: values, functions of the card's number k and the page's number n."""
    n = F.col("page_id")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PER_PAGE - 1)), lambda k: text(template, n=n, k=k, **{name: f(k, n) for name, f in of.items()})), "")


def captured(spark, sf_dir: str, url: str, search_url: str, html: Column) -> DataFrame:
    pages = portals.dealt(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html", text(url, n=F.col("page_id")).alias("url")))
    return pages.select("url", F.lit(search_url).alias("search_url"), F.col("page_id").cast("int").alias("page"), F.lit(200).alias("status"), F.concat(html, F.col("html")).alias("html"))


def results_a(spark, sf_dir: str) -> DataFrame:
    card = """<div class="listing__item"><article><a class="card" href="/departamento-en-venta-{n}-{k}?x=1"><h2>Depto {n} {k}</h2></a>{price}<p class="card__address">Gorriti {number} Piso {floor}</p>
        <span class="card__seller">Inmo {seller}</span>{image} {rooms} ambientes {area} m² totales</article></div>"""
    html = repeated(
        card, price=lambda k, n: F.when(k % 8 == 7, "").otherwise(F.concat(F.lit('<p class="card__price">USD '), (k + 90).cast("string"), F.lit(".500</p>"))), number=lambda k, n: k + 4500, floor=lambda k, n: k % 9 + 1, seller=lambda k, n: k % 5,
        image=lambda k, n: F.when(k % 2 == 0, F.concat(F.lit('<img src="https://img.example/'), n.cast("string"), F.lit("-"), k.cast("string"), F.lit('.jpg">'))).otherwise(""), rooms=lambda k, n: k % 5 + 1, area=lambda k, n: k + 40,
    )
    return captured(spark, sf_dir, f"{SITE_A}/departamentos/venta/{{n}}", SEARCH_A, html)


def results_b(spark, sf_dir: str) -> DataFrame:
    card = """<div data-posting-type="PROPERTY"><a data-to-posting="/propiedades/depto-{id}.html" href="/propiedades/depto-{id}.html?n=1"><h3 data-qa="POSTING_CARD_DESCRIPTION">Depto {k}</h3></a>
        <div data-qa="POSTING_CARD_PRICE">USD {price}.000</div><div data-qa="POSTING_CARD_EXPENSES">$ 85.000 Expensas</div><div data-qa="POSTING_CARD_LOCATION">Gorriti {number}, Palermo</div>
        <div data-qa="POSTING_CARD_PUBLISHER">Inmo {seller}</div> {beds} dorm. 1 baño 1 cochera {area} m² cubiertos</div>"""
    html = repeated(card, id=lambda k, n: n * 100 + k + 49_000_000, price=lambda k, n: k + 90, number=lambda k, n: k + 4500, seller=lambda k, n: k % 5, beds=lambda k, n: k % 4 + 1, area=lambda k, n: k + 40)
    return captured(spark, sf_dir, f"{SITE_B}/departamentos-venta-pagina-{{n}}.html", SEARCH_B, html)


def results_c(spark, sf_dir: str) -> DataFrame:
    """One card in ten has no link, and one in six an item that the card before it has."""
    card = """<li class="ui-search-layout__item">{link}{price}<span class="poly-component__location">Gorriti {number}, Palermo, Capital Federal</span>
        <ul><li class="poly-attributes_list__item">2 a 3 ambs.</li><li class="poly-attributes_list__item">{low} - {high} m² cubiertos</li></ul></li>"""
    html = repeated(
        card, link=lambda k, n: F.when(k % 10 == 9, "<p>Depto</p>").otherwise(F.concat(F.lit(f'<a class="poly-component__title" href="{SITE_C}/MLA-'), (n * 100 + k - F.when(k % 6 == 5, 1).otherwise(0)).cast("string"), F.lit('-x?p=1#q">Depto con balcón</a>'))),
        price=lambda k, n: F.when(k % 4 == 0, "").otherwise(F.concat(F.lit('<span class="poly-price__current">US$ '), (k + 100).cast("string"), F.lit(".000</span>"))), number=lambda k, n: k + 4500, low=lambda k, n: k + 45, high=lambda k, n: k + 60,
    )
    return captured(spark, sf_dir, f"{SITE_C}/{{n}}", f"{SITE_C}/venta", F.concat(F.lit("<ol>"), html, F.lit("</ol>")))


def details_a(spark, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    html = text(
        """<script type="application/ld+json">{open}"@type":["Apartment"],"name":"Depto {n}","offers":[{open}"price":"{price}","priceCurrency":"USD"{close}],"geo":{open}"@type":"GeoCoordinates","latitude":"-34.6037"{close}{close}</script>
        <table><tr><th>Superficie total</th><td>{area} m2</td></tr></table><dl><dt>Ambientes</dt><dd>{rooms}</dd></dl><ul><li class="feature">Balcón</li><li class="feature">Apto crédito: Sí</li></ul>""",
        n=n, open=F.lit("{"), close=F.lit("}"), price=n * 1000, area=n % 90 + 20, rooms=n % 5 + 1,
    )
    return captured(spark, sf_dir, f"{SITE_A}/departamento-en-venta-{{n}}", SEARCH_A, html)


def details_b(spark, sf_dir: str) -> DataFrame:
    """Without JSON-LD: everything comes from metas and marked elements."""
    n = F.col("page_id")
    html = text(
        """<meta property="og:title" content="Depto {n} en venta"><div data-qa="POSTING_DETAILS_DESCRIPTION">Lindo con <b>parrilla</b></div><div data-qa="POSTING_CARD_PRICE">USD {price}.500</div>
        <div data-qa="POSTING_CARD_LOCATION">Gorriti {number} Piso {floor}, Palermo</div><div data-qa="SECTION_FEATURES"><ul><li>Dormitorios: {beds}</li><li>Cocheras: 1</li><li>Ascensor</li></ul></div>""",
        n=n, price=n % 10 + 90, number=n + 4500, floor=n % 9 + 1, beds=n % 4 + 1,
    )
    return captured(spark, sf_dir, f"{SITE_B}/propiedades/depto-{{n}}-49000000.html", SEARCH_B, html)


KINDS = {"STRING": "varchar", "INT": "int", "DOUBLE": "double", "TIMESTAMP": "varchar"}


def in_sql(schema: list[tuple[str, str]], source: str, **values: str) -> str:
    """A query of the schema's columns from source, null where no value is given."""
    unknown = values.keys() - {name for name, _ in schema}
    if unknown:
        raise ValueError(f"not in the schema: {sorted(unknown)}")
    return "select " + ", ".join(f'({values.get(name, "null")})::{KINDS[kind]} as "{name}"' for name, kind in schema) + f" from ({source})"


def half_up(x: str, digits: int = 2) -> str:
    return f"floor(({x}) * {10**digits}e0 + 0.5e0) / {10**digits}e0"


def without_time(rows: DataFrame) -> DataFrame:
    """The pages say no time of capture."""
    return rows.withColumn("scraped_at_utc", F.col("scraped_at_utc").cast("string"))


ITEM_SQL = "n * 100 + k - case when k % 6 = 5 then 1 else 0 end"
AREA_A, AREA_B = "(k + 40)::double", "(k + 40)::double"
PRICE_A = "case when k % 8 <> 7 then (k + 90) * 1000.0e0 + 500 end"
NO_FEATURES = {k: "0" for k in features.BINARY_TERMS}

ORACLE_SQL = {
    "portal_links": f"select '{SITE_A}/departamentos/venta/' || n as page_url, page, k::int as pos, '{SITE_A}/departamento-en-venta-' || n || '-' || k as url from ({CARDS_SQL})",
    "portal_b_links": f"select '{SITE_B}/departamentos-venta-pagina-' || n || '.html' as page_url, page, k::int as pos, '{SITE_B}/propiedades/depto-' || (n * 100 + k + 49000000) || '.html' as url from ({CARDS_SQL})",
    "portal_listing": in_sql(
        LISTING, f"select *, '{SITE_A}/departamento-en-venta-' || n || '-' || k as link, {PRICE_A} as amount from ({CARDS_SQL})",
        property_id="substring(sha1(link), 1, 20)", fuente="'Argenprop'", url="link", search_url=f"'{SEARCH_A}'", pagina_origen="page", http_status="200", parse_ok="1", parse_warnings="'modo_listado_sin_ficha_detallada'",
        titulo="'Depto ' || n || ' ' || k", tipo_operacion="'venta'", tipo_propiedad="'departamento'", inmobiliaria="'Inmo ' || k % 5", moneda="case when amount is not null then 'USD' end", precio="amount", precio_texto="case when amount is not null then 'USD ' || (k + 90) || '.500' end",
        direccion_completa="'Gorriti ' || (k + 4500) || ' Piso ' || (k % 9 + 1)", calle="'Gorriti'", altura="k + 4500", piso="k % 9 + 1", ambientes="k % 5 + 1", superficie_total_m2=AREA_A, precio_m2_calculado=half_up(f"amount / {AREA_A}"),
        imagen_principal="case when k % 2 = 0 then 'https://img.example/' || n || '-' || k || '.jpg' end", cantidad_imagenes="case when k % 2 = 0 then 1 end", cantidad_atributos_extra="1",
        atributos_extra_json="""'{"texto_tarjeta":"Depto ' || n || ' ' || k || case when amount is not null then ' USD ' || (k + 90) || '.500' else '' end || ' Gorriti ' || (k + 4500) || ' Piso ' || (k % 9 + 1) || ' Inmo ' || (k % 5) || ' ' || (k % 5 + 1) || ' ambientes ' || (k + 40) || ' m² totales"}'""",
    ),
    "portal_b_listing": in_sql(
        LISTING, f"select *, '{SITE_B}/propiedades/depto-' || (n * 100 + k + 49000000) || '.html' as link, (k + 90) * 1000.0e0 as amount from ({CARDS_SQL})",
        property_id="substring(sha1(link), 1, 20)", fuente="'Zonaprop'", url="link", search_url=f"'{SEARCH_B}'", pagina_origen="page", http_status="200", parse_ok="1", parse_warnings="'modo_listado_sin_ficha_detallada'",
        titulo="'Depto ' || k", tipo_operacion="'venta'", inmobiliaria="'Inmo ' || k % 5", moneda="'USD'", precio="amount", precio_texto="'USD ' || (k + 90) || '.000'", expensas_moneda="'ARS'", expensas="85000", expensas_texto="'$ 85.000 Expensas'",
        direccion_completa="'Gorriti ' || (k + 4500) || ', Palermo'", calle="'Gorriti'", altura="k + 4500", piso="'alermo'", dormitorios="k % 4 + 1", banios="1", cocheras="1", superficie_total_m2=AREA_B, superficie_cubierta_m2=AREA_B, precio_m2_calculado=half_up(f"amount / {AREA_B}"), cantidad_atributos_extra="1",
        atributos_extra_json="""'{"texto_tarjeta":"Depto ' || k || ' USD ' || (k + 90) || '.000 $ 85.000 Expensas Gorriti ' || (k + 4500) || ', Palermo Inmo ' || (k % 5) || ' ' || (k % 4 + 1) || ' dorm. 1 baño 1 cochera ' || (k + 40) || ' m² cubiertos"}'""",
    ),
    "portal_detail": in_sql(
        LISTING, f"select *, '{SITE_A}/departamento-en-venta-' || n as link, (n % 90 + 20)::double as area from ({PAGES_SQL})",
        **NO_FEATURES | {"balcon": "1"}, property_id="substring(sha1(link), 1, 20)", fuente="'Argenprop'", url="link", search_url=f"'{SEARCH_A}'", pagina_origen="page", http_status="200", parse_ok="1", titulo="'Depto ' || n", moneda="'USD'", precio="n * 1000", precio_texto="n * 1000",
        pais="'Argentina'", latitud="-34.6037", ambientes="n % 5 + 1", superficie_total_m2="area", apto_credito="1", precio_m2_calculado=f"case when n > 0 then {half_up('n * 1000 / area')} end", cantidad_atributos_extra="4",
        atributos_extra_json="""'{"Ambientes":"' || (n % 5 + 1) || '","Apto crédito":"Sí","Balcón":"Sí","Superficie total":"' || (n % 90 + 20) || ' m2"}'""",
        jsonld_raw="""'{"@type": ["Apartment"], "geo": {"@type": "GeoCoordinates", "latitude": "-34.6037"}, "name": "Depto ' || n || '", "offers": [{"price": "' || (n * 1000) || '", "priceCurrency": "USD"}]}'""",
    ),
    "portal_b_detail": in_sql(
        LISTING, f"select *, '{SITE_B}/propiedades/depto-' || n || '-49000000.html' as link from ({PAGES_SQL})",
        **NO_FEATURES | {"parrilla": "1", "ascensor": "1"}, property_id="substring(sha1(link), 1, 20)", fuente="'Zonaprop'", url="link", search_url=f"'{SEARCH_B}'", pagina_origen="page", http_status="200", parse_ok="1", titulo="'Depto ' || n || ' en venta'", descripcion="'Lindo con parrilla'",
        moneda="'USD'", precio="(n % 10 + 90) * 1000 + 500", precio_texto="'USD ' || (n % 10 + 90) || '.500'", direccion_completa="'Gorriti ' || (n + 4500) || ' Piso ' || (n % 9 + 1) || ', Palermo'", calle="'Gorriti'", altura="n + 4500", piso="n % 9 + 1",
        pais="'Argentina'", dormitorios="n % 4 + 1", cocheras="1", cantidad_atributos_extra="3", atributos_extra_json="""'{"Ascensor":"Sí","Cocheras":"1","Dormitorios":"' || (n % 4 + 1) || '"}'""", jsonld_raw="'{}'",
    ),
    "portal_cards": in_sql(
        CARD, f"select *, {ITEM_SQL} as item, case when k % 4 <> 0 then (k + 100) * 1000.0e0 end as amount from ({CARDS_SQL}) where k % 10 <> 9 and not (k % 6 = 5 and (k - 1) % 10 <> 9)",
        item_id="'MLA' || item", fuente="'Mercado Libre'", url=f"'{SITE_C}/MLA-' || item || '-x'", search_url=f"'{SITE_C}/venta'", pagina_origen="page", titulo="'Depto con balcón'", tipo_propiedad="'departamento'", tipo_operacion="'venta'", moneda="case when amount is not null then 'USD' end", precio="amount",
        precio_texto="case when amount is not null then 'US$ ' || (k + 100) || '.000' end", desde="0", direccion="'Gorriti ' || (k + 4500) || ', Palermo, Capital Federal'", barrio="'Palermo'", localidad="'Capital Federal'", provincia="'Capital Federal'", ambientes_min="2", ambientes_max="3",
        superficie_min_m2="k + 45", superficie_max_m2="k + 60", tipo_superficie="'cubierta'", destacado="0", emprendimiento="0", atributos_texto="'2 a 3 ambs. | ' || (k + 45) || ' - ' || (k + 60) || ' m² cubiertos'",
        texto_tarjeta="'Depto con balcón' || case when amount is not null then ' US$ ' || (k + 100) || '.000' else '' end || ' Gorriti ' || (k + 4500) || ', Palermo, Capital Federal 2 a 3 ambs. ' || (k + 45) || ' - ' || (k + 60) || ' m² cubiertos'",
        parse_warnings="case when amount is null then 'sin_precio' end", posicion_pagina="k + 1", slug="'MLA-' || item || '-x'", calle="'Gorriti'", altura="k + 4500", comuna="14", precio_m2_min=half_up("amount / (k + 60)"), precio_m2_max=half_up("amount / (k + 45)"), amplitud_superficie_m2="15",
        es_rango_superficie="1", es_rango_ambientes="1", monoambiente="0", apto_credito="0", balcon="1", terraza="0", pileta="0", parrilla="0", cochera_mencionada="0", amenities_mencionadas="0", cantidad_atributos="2", completitud_pct="case when amount is null then 42.9e0 else 57.1e0 end",
    ),
    "portal_pairs": f"select '{SITE_A}/departamento-en-venta-' || n as url, (n % 90 + 20) || ' m2' as superficie_total, (n % 5 + 1)::varchar as ambientes, null::varchar as cochera from ({PAGES_SQL})",
    "portal_blocks": """
select n, case n % 6 when 0 then 'titulo:access denied' when 1 then 'texto_visible:verify you are human' end as reason_a,
  case n % 6 when 0 then 'titulo:access denied' when 1 then 'texto_visible:verify you are human' when 2 then 'texto_visible:checking your browser' end as reason_b, n % 6 = 5 as whole from (select page_id as n from pages)""",
}


def portal_links(spark, sf_dir):
    return portals.links(results_a(spark, sf_dir), portals.PORTAL_A)


def portal_b_links(spark, sf_dir):
    return portals.links(results_b(spark, sf_dir), portals.PORTAL_B)


def portal_listing(spark, sf_dir):
    return without_time(portals.listing(results_a(spark, sf_dir), portals.PORTAL_A))


def portal_b_listing(spark, sf_dir):
    return without_time(portals.listing(results_b(spark, sf_dir), portals.PORTAL_B))


def portal_detail(spark, sf_dir):
    return without_time(portals.detail(details_a(spark, sf_dir), portals.PORTAL_A))


def portal_b_detail(spark, sf_dir):
    return without_time(portals.detail(details_b(spark, sf_dir), portals.PORTAL_B))


def portal_cards(spark, sf_dir):
    return without_time(portals.cards(results_c(spark, sf_dir)))


def portal_pairs(spark, sf_dir):
    """The table function over detail pages, in SQL."""
    register(spark)
    pages = details_a(spark, sf_dir).select("url", "html")
    return spark.sql("SELECT * FROM html_pairs(TABLE(SELECT * FROM {pages}), 'Superficie total', 'ambientes', 'cochera')", pages=pages)


def portal_blocks(spark, sf_dir):
    """Why pages look blocked, to either portal, and whether a response is whole. Six kinds of pages: a title; a text with a
    widget of both, with a widget of the second only, with none; a widget alone; a long page."""
    k = F.col("page_id") % 6
    html = (
        F.when(k == 0, "<title>Access Denied</title>").when(k == 1, '<p>Verify you are human</p><div class="g-recaptcha"></div>').when(k == 2, '<p>Checking your browser</p><div class="px-captcha"></div>')
        .when(k == 3, "<p>Verify you are human</p>").when(k == 4, '<p>Depto</p><div class="h-captcha"></div>').otherwise(F.repeat(F.lit("<p>Depto</p>"), 5000))
    )
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("n"), "url", html.alias("html"), F.lit(200).alias("status"))
    a = portals.classified(pages).select("n", F.col("block_reason").alias("reason_a"), features.whole_response(F.col("status"), F.col("html")).alias("whole"))
    return a.join(portals.classified(pages, features.WIDGETS_B).select("n", F.col("block_reason").alias("reason_b")), "n")


QUERIES = {f.__name__: f for f in (portal_links, portal_b_links, portal_listing, portal_b_listing, portal_detail, portal_b_detail, portal_cards, portal_pairs, portal_blocks)}
