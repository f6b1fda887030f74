"""Three portals: captured pages in, typed tables out.

A captured page is (url, html) with, where known, search_url, page and status; captured_at gives scraped_at_utc.
parse_html() is the only Python step, and it runs once a page; everything after it is Column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.functions import features, numbers, urls
from parcela.functions.address import address_of, card_address, commune, parse_address, place_parts
from parcela.functions.text import clean_text, contains_any, first_filled, flag, fold, found, normalize_key, once, parse_bool, plain_text, rounded, token_count, warnings
from parcela.plans.schema import CARD, LISTING, aligned
from parcela.sources.html import attr, attr_is, attr_like, class_like, closest, first, first_text, has_class, meta, parse_html, parse_shown, subtree, text_of, under

tag = lambda *names: lambda e: e["tag"].isin(*names)
like = lambda part: lambda e: class_like(e, part)
qa = lambda value: lambda e: attr_is(e, "data-qa", value)


@dataclass(frozen=True)
class Portal:
    name: str
    variant: str  # a or b


PORTAL_A, PORTAL_B = Portal("Argenprop", "a"), Portal("Zonaprop", "b")


def dealt(pages: DataFrame) -> DataFrame:
    """pages dealt out by url, a few parts for each core. A table of pages is small beside the work on it, and its files or row groups,
    which are Spark's parts of it, may be fewer than the cores."""
    spark = pages.sparkSession
    return pages.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "url")


def captured(pages: DataFrame, parse=parse_html) -> DataFrame:
    """pages with every column that the plans read, and the parsed page (doc), unless they have it."""
    for name, kind in (("search_url", "string"), ("page", "int"), ("status", "int"), ("captured_at", "timestamp")):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    return pages if "doc" in pages.columns else pages.withColumn("doc", parse(F.col("html")))


def classified(pages: DataFrame, widgets=features.WIDGETS_A, parsed: bool = False) -> DataFrame:
    """pages with block_reason and response (what the capture is), and if asked for with the parsed page."""
    out = captured(pages, parse_html if parsed else parse_shown)
    reason = features.block_reason(F.col("doc.title"), F.col("doc.visible"), F.col("html"), widgets)
    out = out.withColumn("block_reason", reason)
    out = out.withColumn("response", features.response_class(F.col("status"), F.col("block_reason"), F.col("html")))
    return out if parsed else out.drop("doc")


# Links


def link_selectors(portal: Portal, els: Column) -> tuple[list[Column], int]:
    """Elements found by each selector, in order, and how many of the first ones end the search if they find any."""
    a = lambda *tests: lambda e: (e["tag"] == "a") & _all(e, tests)
    href = lambda e: attr(e, "href").isNotNull()
    has = lambda part: lambda e: attr_like(e, "href", part)
    if portal.variant == "a":
        item = lambda e: (e["tag"] == "div") & has_class(e, "listing__item")
        return [under(els, item, a(href, lambda e: has_class(e, "card"))), under(els, item, a(href)), under(els, tag("article"), a(has("/"))), *(F.filter(els, a(has(p))) for p in ("departamento", "casa", "ph-"))], 2
    posting = lambda e: (e["tag"] == "div") & attr(e, "data-posting-type").isNotNull()
    box = lambda name: lambda e: (e["tag"] == "div") & has_class(e, name)
    return [
        under(els, posting, a(lambda e: attr(e, "data-to-posting").isNotNull())), F.filter(els, a(qa("POSTING_CARD_LINK"))), under(els, box("postingCard"), a(href)),
        under(els, box("postingsList"), a(href)), under(els, tag("article"), a(has(".html"))), F.filter(els, a(has(".html"))),
    ], 1


def _all(e: Column, tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t(e)
    return out


def anchors_of(portal: Portal, els: Column, base: Column) -> Column:
    """array<struct<at, href, url, goal>>: where the page's links are, their hrefs and urls, and the urls they may be a property by.
    base: base_parts() of the page's url."""
    b = portal.variant == "b"
    full = lambda x: urls.canonical(urls.resolved(base, x))
    other = lambda e: F.nullif(attr(e, "data-to-posting"), F.lit("")) if b else F.lit(None).cast("string")

    def read(e: Column) -> Column:
        goal = lambda href, url: F.when(href != "", url).otherwise(full(other(e)) if b else F.lit(None).cast("string"))
        whole = lambda href: once(lambda url: F.struct(e["pos"].alias("at"), href.alias("href"), url.alias("url"), goal(href, url).alias("goal")), full(href))
        return once(whole, attr(e, "href"))

    return F.transform(F.filter(els, lambda e: (e["tag"] == "a") & F.coalesce(attr(e, "href"), other(e)).isNotNull()), read)


def property_links(portal: Portal, anchors: Column) -> Column:
    """map<int, string>: where the links to properties are, of a page's anchors_of(), and their urls."""
    is_property = urls.is_property_a if portal.variant == "a" else urls.is_property_b
    return F.map_from_entries(F.transform(F.filter(anchors, lambda x: is_property(x["goal"])), lambda x: F.struct(x["at"], x["goal"])))


def listing_links(portal: Portal, els: Column, known: Column) -> Column:
    """The property urls of a results page, each once, in the order in which the selectors find them. known: property_links()."""
    links = lambda found: F.array_distinct(F.filter(F.transform(found, lambda e: F.try_element_at(known, e["pos"])), lambda u: u.isNotNull()))
    found, ends = link_selectors(portal, els)
    out = F.array_distinct(F.flatten(F.array(*[links(f) for f in found[ends - 1 :]])))
    for f in reversed(found[:ends]):
        # the rest is looked for only where this selector finds none
        out = once(lambda x, out=out: F.when(F.size(x) > 0, x).otherwise(out), links(f))
    return out


def with_links(own: DataFrame, portal: Portal, els: Column, url: Column) -> DataFrame:
    """own with anchors, a page's anchors_of(), and links, its property urls."""
    own = own.withColumn("anchors", once(lambda base: anchors_of(portal, els, base), urls.base_parts(url)))
    return own.withColumn("links", once(lambda known: listing_links(portal, els, known), property_links(portal, F.col("anchors"))))


def links(pages: DataFrame, portal: Portal) -> DataFrame:
    """page's url, pos (from 0) and link, a row for each property link."""
    own = with_links(captured(pages), portal, F.col("doc.elements"), F.col("url"))
    return own.select(F.col("url").alias("page_url"), "page", F.posexplode("links").alias("pos", "url"))


# Listing mode


def listing(pages: DataFrame, portal: Portal) -> DataFrame:
    """LISTING rows from the cards of results pages, without opening the properties' own pages."""
    b = portal.variant == "b"
    own = captured(pages).select("url", "search_url", "page", "status", "captured_at", F.col("doc.elements").alias("els"), F.col("doc.texts").alias("texts"))
    els, texts = F.col("els"), F.col("texts")
    own = with_links(own, portal, els, F.col("url"))
    named = lambda pattern: lambda e: F.coalesce(attr(e, "class").rlike(pattern), F.lit(False))
    tops = [lambda e: attr(e, "data-posting-type").isNotNull(), named("(?i)postingCard|posting-card|card"), tag("article")] if b else [tag("article"), named("(?i)listing__item|card|posting")]

    def card(index: Column, link: Column) -> Column:
        """The card around the first anchor of a link."""
        at = lambda where, x: once(lambda n: F.when(n > 0, n), F.array_position(index[where], x))
        place = F.get(index["at"], F.coalesce(at("href", urls.path(link)), at("href", link), at("url", link)).cast("int") - 1)
        return once(lambda a: F.coalesce(*[closest(els, a, t) for t in tops], F.get(els, a["parent"])), F.get(els, place))

    # each link with its card, cut out of the page before rows are made: no row carries the page
    cut = lambda index: F.transform("links", lambda u: F.struct(u.alias("link"), once(lambda c: subtree(c, els, texts), card(index, u)).alias("sub")))
    index = F.struct(*[F.col("anchors")[name].alias(name) for name in ("at", "href", "url")])
    own = own.withColumn("found", F.filter(once(cut, index), lambda x: x["sub"]["top"].isNotNull()))
    # outer: else Spark infers a filter that works all of this out a second time
    own = own.select("search_url", "page", "status", "captured_at", F.explode_outer("found").alias("found")).filter("found is not null")
    own = own.select("search_url", "page", "status", "captured_at", "found.link", F.col("found.sub.top").alias("card"), "found.sub.els", "found.sub.texts")
    own = own.withColumn("text", F.coalesce(text_of(F.col("card"), texts), F.lit("")))
    value = lambda qa_name, *classes: first_text(F.col("els"), F.col("texts"), *([qa(qa_name)] if b and qa_name else []), *map(like, classes))
    text, lower = F.col("text"), F.col("lower")
    own = own.withColumn("lower", F.lower(text))
    # most texts lack a word that a pattern needs: a plain search for it comes first
    seen = lambda words, pattern, group=0: F.when(contains_any(lower, words), found(text, pattern, group))
    area = lambda pattern: once(numbers.read_number, seen(("m²", "m2"), rf"(?i)([0-9][0-9.,]*)\s*m(?:²|2)\s*{pattern}", 1))
    titles = [*([qa("POSTING_CARD_DESCRIPTION")] if b else []), tag("h2"), tag("h3"), like("title"), like("titulo")]
    amount = r"(?:USD|U\$S|US\$|ARS|\$)\s*"
    own = own.withColumns({
        "title": first_text(els, F.col("texts"), *titles),
        "raw_money": F.coalesce(value("POSTING_CARD_PRICE", "price", "precio"), found(text, f"(?i){amount}[0-9][0-9.,]*")),
        "raw_costs": F.coalesce(value("POSTING_CARD_EXPENSES") if b else F.lit(None).cast("string"), seen(("expensa",), rf"(?i)expensas?\s*(?:{amount})?[0-9][0-9.,]*")),
        "raw_place": value("POSTING_CARD_LOCATION", "address", "direccion", "location", "ubicacion"),
        "seller": value("POSTING_CARD_PUBLISHER", "seller", "inmobiliaria", "publisher"),
        "images": F.filter(els, tag("img")),
        "area": area("(?:totales?|total)?"),
    })
    # these texts are clean: they come from text_of(), or lie in it between two visible characters
    own = own.withColumns({"money": once(numbers.money_of, "raw_money"), "costs": once(numbers.money_of, "raw_costs"), "place": once(address_of, "raw_place")})
    count = lambda pattern, *words: once(numbers.read_number, seen(words, f"(?i)([0-9]+)\\s*(?:{pattern})", 1)).try_cast("int")
    image = first(F.col("images"))
    values = {
        "property_id": urls.stable_id(F.col("link")), "fuente": F.lit(portal.name), "url": F.col("link"), "scraped_at_utc": F.col("captured_at"), "search_url": F.col("search_url"),
        "pagina_origen": F.col("page"), "http_status": F.col("status"), "parse_ok": F.lit(1), "parse_warnings": F.lit("modo_listado_sin_ficha_detallada"), "titulo": F.col("title"),
        "tipo_operacion": urls.operation(F.col("search_url"), "-" if b else "/"), "tipo_propiedad": F.lit(None) if b else urls.property_type(F.col("search_url")), "inmobiliaria": F.col("seller"),
        "moneda": F.col("money.currency"), "precio": F.col("money.amount"), "precio_texto": F.col("money.text"), "expensas_moneda": F.col("costs.currency"), "expensas": F.col("costs.amount"), "expensas_texto": F.col("costs.text"),
        **address_columns(F.col("place")), "ambientes": count(r"ambientes?|amb\b", "amb"), "dormitorios": count(r"dormitorios?|dorm\b", "dorm"), "banios": count("baños?|banos?", "baño", "bano"), "cocheras": count("cocheras?|garages?", "cochera", "garage"),
        "superficie_total_m2": F.col("area"), "superficie_cubierta_m2": F.when(F.contains(lower, F.lit("cubiert")), area("(?:cubiertos?|cubierta)")),
        "imagen_principal": first_filled(attr(image, "src"), attr(image, "data-src"), *([attr(image, "data-flickity-lazyload")] if b else [])), "cantidad_imagenes": F.nullif(F.size("images"), F.lit(0)),
        "cantidad_atributos_extra": F.lit(1), "atributos_extra_json": F.to_json(F.struct(text.alias("texto_tarjeta"))), "precio_m2_calculado": rounded(numbers.per_unit(F.col("money.amount"), F.col("area"))),
    }
    return own.select(*aligned(values, LISTING))


def address_columns(place: Column) -> dict[str, Column]:
    return {"direccion_completa": place["full"], "calle": place["street"], "altura": place["number"], "piso": place["floor"], "unidad": place["unit"]}


# Detail mode


def last_by_key(pairs: Column, later: Column | None = None) -> Column:
    """array<struct<k, v>>: each key once, where it first occurs, with its last value in pairs, or else its
    first in later."""
    every = pairs if later is None else F.concat(pairs, later)
    value = lambda k: F.coalesce(F.try_element_at(F.filter(pairs, lambda p: p["k"] == k), F.lit(-1))["v"], *([] if later is None else [F.get(F.filter(later, lambda p: p["k"] == k), F.lit(0))["v"]]))
    return F.transform(F.array_distinct(F.transform(every, lambda p: p["k"])), lambda k: F.struct(k.alias("k"), value(k).alias("v")))


def pair(k: Column, v: Column) -> Column:
    return F.struct(k.alias("k"), v.alias("v"))


def table_pairs(els: Column, texts: Column) -> Column:
    """Pairs of two-cell table rows, then of dt and the dd that follows it."""
    cells = lambda row: F.filter(els, lambda e: (e["parent"] == row["pos"]) & e["tag"].isin("th", "td"))
    rows = F.filter(F.transform(F.filter(els, tag("tr")), cells), lambda c: F.size(c) == 2)
    rows = F.filter(F.transform(rows, lambda c: pair(text_of(F.get(c, F.lit(0)), texts), text_of(F.get(c, F.lit(1)), texts))), lambda p: p["k"].isNotNull() & p["v"].isNotNull() & (F.length(p["k"]) <= 80))
    after = lambda dt: first(F.filter(els, lambda e: (e["parent"] == dt["parent"]) & (e["pos"] > dt["pos"]) & (e["tag"] == "dd")))
    terms = F.filter(F.transform(F.filter(els, tag("dt")), lambda dt: pair(text_of(dt, texts), text_of(after(dt), texts))), lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    return F.concat(rows, terms)


def feature_pairs(portal: Portal, els: Column, texts: Column) -> Column:
    """Pairs of feature elements: 'k: v', or up to five bare words, which are a feature that is there."""
    li = tag("li")
    of_qa = lambda part: lambda e: attr_like(e, "data-qa", part)
    in_property = under(els, like("property"), li)
    named = lambda *parts: [F.filter(els, like(p)) for p in parts]
    if portal.variant == "a":
        found = [*named("feature", "caracter", "detail", "attribute", "spec"), in_property]
    else:
        found = [*(under(els, of_qa(p), li) for p in ("FEATURES", "FEATURE")), *named("feature", "caracter", "detail", "attribute", "icon-feature"), in_property]
    read = F.filter(F.transform(F.concat(*found), lambda e: text_of(e, texts)), lambda t: t.isNotNull() & (F.length(t) <= 180))
    key, value = (lambda t: F.trim(F.substring_index(t, ":", 1))), (lambda t: F.trim(F.regexp_replace(t, "^[^:]*:", "")))
    whole = F.transform(read, lambda t: F.when(F.contains(t, F.lit(":")), pair(key(t), value(t))).when(F.size(F.split(t, " ")) <= 5, pair(t, F.lit("Sí"))))
    return F.filter(whole, lambda p: p.isNotNull() & (p["v"] != "") & ((F.length(p["k"]).between(2, 80)) | (p["v"] == "Sí")))


# Types of objects, the most wanted first.
JSONLD_TYPES = ("RealEstateListing", "Apartment", "House", "Residence", "Product", "Offer")


def choose_jsonld(objects: Column) -> Column:
    """The object of the most wanted type, then the first; {} if there is none."""
    kind = lambda o: F.get_json_object(o, "$['@type']")
    is_kind = lambda o, k: (kind(o) == k) | (kind(o).startswith("[") & F.contains(kind(o), F.lit(f'"{k}"')))
    wanted = lambda k: lambda o: F.coalesce(is_kind(o, k), F.lit(False))
    return F.coalesce(*[F.get(F.filter(objects, wanted(k)), F.lit(0)) for k in JSONLD_TYPES], F.get(objects, F.lit(0)), F.lit("{}"))


def json_field(data: Column, *paths: str) -> Column:
    return first_filled(*[F.get_json_object(data, p) for p in paths])


def in_list_or_not(name: str, field: str) -> tuple[str, str]:
    return f"$.{name}[0].{field}", f"$.{name}.{field}"


def images_of(data: Column) -> Column:
    raw = F.get_json_object(data, "$.image")
    every = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.startswith("{"), F.array(F.get_json_object(data, "$.image.url"))).otherwise(F.array(raw))
    return F.filter(every, lambda x: x.isNotNull() & (x != ""))


# Column, type, names of the attribute.
ATTRIBUTES = (
    ("tipo_operacion", "text", ("tipo de operacion", "operacion")), ("fecha_publicacion", "text", ("fecha de publicacion", "publicado")), ("barrio", "text", ("barrio",)), ("partido", "text", ("partido",)),
    ("ambientes", "int", ("cantidad de ambientes", "ambientes")), ("dormitorios", "int", ("cantidad de dormitorios", "dormitorios")), ("banios", "int", ("cantidad de banos", "banos")), ("toilettes", "int", ("cantidad de toilettes", "toilettes")),
    ("cocheras", "int", ("cantidad de cocheras", "cocheras", "garage")), ("superficie_total_m2", "number", ("superficie total", "superficie")), ("superficie_cubierta_m2", "number", ("superficie cubierta",)),
    ("superficie_descubierta_m2", "number", ("superficie descubierta",)), ("superficie_semicubierta_m2", "number", ("superficie semicubierta",)), ("superficie_terreno_m2", "number", ("superficie terreno", "superficie del terreno")),
    ("frente_m", "number", ("frente",)), ("fondo_m", "number", ("fondo",)), ("antiguedad_anios", "int", ("antiguedad",)), ("estado_inmueble", "text", ("estado del inmueble", "estado")), ("disposicion", "text", ("disposicion",)),
    ("orientacion", "text", ("orientacion",)), ("luminosidad", "text", ("luminosidad",)), ("cantidad_plantas", "int", ("cantidad de plantas", "plantas")), ("cantidad_pisos_edificio", "int", ("cantidad de pisos", "pisos del edificio")),
    ("departamentos_por_piso", "int", ("departamentos por piso", "unidades por piso")), ("apto_credito", "bool", ("apto credito",)), ("apto_profesional", "bool", ("apto profesional",)), ("permite_mascotas", "bool", ("permite mascotas", "mascotas")),
    ("accesibilidad", "bool", ("acceso para movilidad reducida", "accesibilidad")), ("amoblado", "bool", ("amoblado", "amueblado")), ("video_url", "text", ("video", "video url")), ("tour_virtual_url", "text", ("tour virtual", "recorrido virtual")),
)
# Other columns that attributes fill, and the attributes' names.
SAID = {
    "lat": ("latitud",), "lon": ("longitud",), "money": ("precio", "valor"), "costs": ("expensas", "gastos comunes"), "place": ("direccion", "ubicacion"), "type": ("tipo de propiedad", "tipo de unidad"),
    "town": ("localidad",), "region": ("provincia",), "code": ("codigo postal",),
}


def read_each(own: DataFrame, name: str, f, columns: dict) -> tuple[DataFrame, dict]:
    """own with an array column of that name, f of each of the columns, as one expression; and the columns that are its items."""
    own = own.withColumn(name, F.transform(F.array(*columns.values()), f))
    return own, {key: F.get(name, F.lit(i)) for i, key in enumerate(columns)}


def detail(pages: DataFrame, portal: Portal) -> DataFrame:
    """LISTING rows from properties' own pages."""
    b = portal.variant == "b"
    own = captured(pages).withColumns({"els": F.col("doc.elements"), "texts": F.col("doc.texts"), "objects": F.col("doc.jsonld")}).drop("doc")
    els, texts, data, attrs = (F.col(c) for c in ("els", "texts", "data", "attrs"))
    own = own.withColumns({"data": choose_jsonld(F.col("objects")), "tables": table_pairs(els, texts), "listed": feature_pairs(portal, els, texts)})
    own = own.withColumn("pairs", last_by_key(F.col("tables"), F.col("listed")))
    own = own.withColumn("keyed", F.filter(F.transform("pairs", lambda p: pair(normalize_key(p["k"]), p["v"])), lambda p: p["k"] != ""))
    own = own.withColumn("attrs", last_by_key(F.col("keyed")))
    # one expression finds what all attributes say, one each reads all numbers and all flags of it
    wanted = {name: names for name, _, names in ATTRIBUTES} | SAID | {("feature", t): (t,) for terms in features.BINARY_TERMS.values() for t in terms}
    own = own.withColumn("said", features.attributes(attrs, [*wanted.values()]))
    said = lambda name: F.get("said", F.lit([*wanted].index(name)))
    prop = lambda name: lambda e: (e["tag"] == "meta") & attr_is(e, "property", name)
    of_meta = lambda *tests: meta(els, texts, *[t for t in tests if t])
    qa_b = lambda name: qa(name) if b else None
    geo = F.get(F.filter("objects", lambda o: F.get_json_object(o, "$['@type']") == "GeoCoordinates"), F.lit(0))
    geo_field = lambda name: F.when(F.get_json_object(data, "$.geo").startswith("{"), F.get_json_object(data, f"$.geo.{name}")).otherwise(F.get_json_object(geo, f"$.{name}"))
    address = lambda name: json_field(data, f"$.address.{name}", f"$.location.address.{name}")
    # each text is found once, in a column of its own; what reads a text names it many times
    own = own.withColumns({
        "raw_lat": first_filled(geo_field("latitude"), said("lat")), "raw_lon": first_filled(geo_field("longitude"), said("lon")),
        "title": first_filled(json_field(data, "$.name"), of_meta(prop("og:title"), tag("h1"))),
        "description": plain_text(first_filled(json_field(data, "$.description"), of_meta(lambda e: (e["tag"] == "meta") & attr_is(e, "name", "description"), prop("og:description"), qa_b("POSTING_DETAILS_DESCRIPTION"), like("description")))),
        "raw_money": plain_text(first_filled(json_field(data, *in_list_or_not("offers", "price"), *in_list_or_not("offer", "price")), said("money"), of_meta(prop("product:price:amount"), qa_b("POSTING_CARD_PRICE"), like("price")))),
        "raw_costs": said("costs"), "raw_place": plain_text(first_filled(address("streetAddress"), said("place"), of_meta(qa_b("POSTING_CARD_LOCATION"), like("address"), like("location")))),
        "raw_type": said("type"), "raw_town": said("town"), "raw_region": said("region"), "raw_code": said("code"), "raw_image": of_meta(prop("og:image")),
        "images": images_of(data),
        "listing_words": F.array_join(F.transform(attrs, lambda a: F.concat_ws(" ", a["k"], a["v"])), " "),
    })
    own = own.withColumns({"money": once(numbers.parse_money, "raw_money"), "costs": once(numbers.parse_money, "raw_costs"), "place": once(parse_address, "raw_place"), "haystack": normalize_key(F.concat_ws(" ", "description", "listing_words"))})
    of_kind = lambda *kinds: {name: said(name) for name, kind, _ in ATTRIBUTES if kind in kinds}
    feature = {name: first_filled(*[said(("feature", t)) for t in terms]) for name, terms in features.BINARY_TERMS.items()}
    own, read = read_each(own, "numbers", numbers.parse_number, of_kind("int", "number") | {"latitud": F.col("raw_lat"), "longitud": F.col("raw_lon")})
    own, flags = read_each(own, "flags", parse_bool, of_kind("bool") | {("feature", name): x for name, x in feature.items()})
    values = of_kind("text") | {name: x.try_cast("int") if name in of_kind("int") else x for name, x in read.items()} | {name: flags[name] for name in of_kind("bool")}
    values |= {
        "property_id": urls.stable_id(F.col("url"), json_field(data, "$.sku", "$.productID")), "fuente": F.lit(portal.name), "url": F.col("url"), "scraped_at_utc": F.col("captured_at"), "search_url": F.col("search_url"),
        "pagina_origen": F.col("page"), "http_status": F.col("status"), "parse_ok": F.lit(1), "titulo": plain_text(F.col("title")), "descripcion": F.col("description"), "tipo_propiedad": first_filled(json_field(data, "$.category"), F.col("raw_type")),
        "estado_publicacion": json_field(data, *in_list_or_not("offers", "availability"), *in_list_or_not("offer", "availability")), "inmobiliaria": plain_text(json_field(data, "$.seller.name")), "seller_id": json_field(data, "$.seller.identifier"),
        "moneda": first_filled(json_field(data, *in_list_or_not("offers", "priceCurrency"), *in_list_or_not("offer", "priceCurrency")), F.col("money.currency")), "precio": F.col("money.amount"), "precio_texto": F.col("money.text"),
        "expensas_moneda": F.col("costs.currency"), "expensas": F.col("costs.amount"), "expensas_texto": F.col("costs.text"), **address_columns(F.col("place")),
        "localidad": first_filled(address("addressLocality"), F.col("raw_town")), "provincia": first_filled(address("addressRegion"), F.col("raw_region")), "pais": first_filled(address("addressCountry"), F.lit("Argentina")), "codigo_postal": first_filled(address("postalCode"), F.col("raw_code")),
        "cantidad_imagenes": F.nullif(F.size("images"), F.lit(0)), "imagen_principal": first_filled(json_field(data, "$.primaryImageOfPage.contentUrl"), F.get("images", F.lit(0)), F.col("raw_image")),
        "cantidad_atributos_extra": F.size("pairs"), "atributos_extra_json": F.to_json(F.map_from_entries(F.array_sort("pairs"))), "jsonld_raw": data, **features.binary_features({k: flags["feature", k] for k in features.BINARY_TERMS}, F.col("haystack")),
        "parse_warnings": warnings(titulo_no_encontrado=F.col("title").isNull(), precio_no_encontrado=F.col("money.amount").isNull(), sin_tabla_atributos=F.size("pairs") == 0),
    }
    out = own.select(*aligned(values, LISTING))
    return out.withColumn("precio_m2_calculado", rounded(numbers.per_unit(F.col("precio"), F.col("superficie_total_m2"))))


# Card mode (portal C)


def cards(pages: DataFrame) -> DataFrame:
    """CARD rows of results pages of the third portal: the first card of each item on a page."""
    own = captured(pages).select("url", "search_url", "page", "captured_at", F.col("doc.elements").alias("all"), F.col("doc.texts").alias("texts"))
    items = F.transform(F.filter("all", lambda e: has_class(e, "ui-search-layout__item")), lambda e: subtree(e, F.col("all"), F.col("texts")))
    own = own.select("url", "search_url", "page", "captured_at", F.posexplode_outer(items).alias("position", "sub")).filter("sub is not null")
    own = own.select("url", "search_url", "page", "captured_at", "position", F.col("sub.top").alias("card"), "sub.els", "sub.texts")
    els, texts = F.col("els"), F.col("texts")
    links = lambda test: F.transform(F.filter(els, lambda e: (e["tag"] == "a") & attr(e, "href").isNotNull() & test(e)), lambda e: attr(e, "href"))
    href = F.coalesce(F.get(links(like("poly-component__title")), F.lit(0)), F.get(links(lambda e: attr_like(e, "href", "MLA-")), F.lit(0)))
    own = own.withColumn("item_url", urls.canonical(href)).filter("item_url is not null").withColumn("item_id", urls.item_id("item_url"))
    token = lambda name: first_text(els, texts, lambda e: has_class(e, name))
    own = own.withColumns({
        "title": token("poly-component__title"), "price_text": token("poly-price__current"), "place_text": token("poly-component__location"), "seller": token("poly-component__seller"), "possession": token("poly-component__possession-date"), "units": token("poly-component__available-units"),
        "attributes": F.filter(F.transform(F.filter(els, like("poly-attributes_list__item")), lambda e: text_of(e, texts)), lambda x: x.isNotNull()),
        "images": F.filter(F.transform(F.filter(els, tag("img")), lambda e: F.coalesce(attr(e, "src"), attr(e, "data-src"))), lambda x: x.isNotNull()), "text": F.coalesce(text_of(F.col("card"), texts), F.lit("")),
    })
    slot = lambda pattern: F.get(F.filter("attributes", lambda a: a.rlike(f"(?i){pattern}")), F.lit(0))
    ranges = {name: once(numbers.number_range, slot(p)) for name, p in (("ambientes", "amb"), ("banios", "bañ|ban"), ("dormitorios", "dorm"))}
    # each of these in a column of its own: what reads them names them more than once
    own = own.withColumns(ranges | {"surface": slot("m²|m2"), "money": once(numbers.card_money, "price_text"), "place": once(place_parts, "place_text")})
    own = own.withColumn("area", once(numbers.number_range, "surface"))
    area, money, place = F.col("area"), F.col("money"), F.col("place")
    values = {
        "item_id": F.col("item_id"), "fuente": F.lit("Mercado Libre"), "url": F.col("item_url"), "search_url": F.col("search_url"), "pagina_origen": F.col("page"), "scraped_at_utc": F.col("captured_at"), "titulo": F.col("title"),
        "tipo_propiedad": F.lit("departamento"), "tipo_operacion": F.lit("venta"), "moneda": money["currency"], "precio": money["amount"], "precio_texto": F.col("price_text"), "desde": flag(F.col("text").rlike(r"(?i)\bdesde\b")), "inmobiliaria": F.col("seller"),
        "direccion": F.col("place_text"), "barrio": place["district"], "localidad": place["town"], "provincia": place["province"],
        **{f"{k}_{end}": F.col(k)[side].try_cast("int") for k in ranges for end, side in (("min", "low"), ("max", "high"))}, "superficie_min_m2": area["low"], "superficie_max_m2": area["high"], "tipo_superficie": features.surface_kind(F.col("surface")),
        "imagen_principal": F.get("images", F.lit(0)), "destacado": flag(F.contains("text", F.lit("Destacado"))), "emprendimiento": flag(F.contains(F.upper("text"), F.lit("EMPRENDIMIENTO"))), "posesion": F.col("possession"),
        "unidades_disponibles": numbers.parse_card_number("units"), "atributos_texto": F.array_join("attributes", " | "), "texto_tarjeta": F.col("text"), "parse_warnings": warnings(sin_titulo=F.col("title").isNull(), sin_precio=money["amount"].isNull()),
    }
    own = own.groupBy("url", "item_id").agg(F.min_by(F.struct(*aligned(values | {"posicion_pagina": F.col("position") + 1}, CARD)), "position").alias("row")).select("row.*")
    return enrich(own)


def enrich(rows: DataFrame) -> DataFrame:
    """CARD rows with their derived columns; doing it twice changes nothing."""
    text = fold(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("titulo", "texto_tarjeta", "atributos_texto")]))
    rows = rows.withColumn("_t", text).withColumn("_a", card_address("direccion"))
    low, high, price, t = F.col("superficie_min_m2"), F.col("superficie_max_m2"), F.col("precio"), F.col("_t")
    before = numbers.parse_card_number(found(t, r"(?:antes|precio anterior)\s*(?:us\$|u\$s|\$)?\s*([0-9][0-9.,]*)", 1))
    differ = lambda a, b: (~a.eqNullSafe(b)).cast("int")
    values = {
        "slug": urls.slug("url"), "calle": F.col("_a.street"), "altura": F.col("_a.number"), "comuna": commune("barrio"), "precio_anterior": before, "descuento_pct": rounded(numbers.discount_percent(before, price)),
        "precio_m2_min": rounded(numbers.per_unit(price, high)), "precio_m2_max": rounded(numbers.per_unit(price, low)), "amplitud_superficie_m2": rounded(high - low), "es_rango_superficie": F.when(low.isNotNull() & high.isNotNull(), differ(low, high)),
        "es_rango_ambientes": F.when(F.col("ambientes_min").isNotNull(), differ(F.col("ambientes_min"), F.col("ambientes_max"))), "monoambiente": flag(F.contains(t, F.lit("monoambiente")) | (F.col("ambientes_max") == 1)),
        **features.card_features(t), "estado_entrega": features.delivery_status(t), "cantidad_atributos": token_count("atributos_texto"),
        "completitud_pct": rounded(features.completeness(*[F.col(c) for c in ("precio", "barrio", "ambientes_min", "banios_min", "superficie_min_m2", "inmobiliaria", "imagen_principal")]), 1),
        "imagen_id": urls.image_id("imagen_principal"), "imagen_extension": urls.image_extension("imagen_principal"),
    }
    types = dict(CARD)
    return rows.withColumns({k: v.cast(types[k]) for k, v in values.items()}).drop("_t", "_a").select(*[n for n, _ in CARD])
