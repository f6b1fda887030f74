"""URLs: canonical form, ids, page addresses of three portals, predicates, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcela.functions.text import col, first_filled, found, once

PAGE_SIZE = 48
#: White space, of Unicode too.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Path parts that property pages don't have.
NOT_PROPERTY_A = ("/buscar", "/emprendimientos", "/inmobiliarias", "/blog", "/ayuda")
NOT_PROPERTY_B = ("/desarrollos", "/inmobiliarias", "/blog", "/ayuda", "/mapa", "/emprendimientos")


def canonical(url: Column | str) -> Column:
    return F.regexp_replace(col(url), r"(?s)[?#].*$", "")


def authority(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def base_parts(base: Column | str) -> Column:
    """struct<url, root, scheme, folder, up>: what resolved() needs of a page's url."""
    url = canonical(base)
    folder = F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*$"), F.concat(url, F.lit("/"))).otherwise(F.regexp_replace(url, "[^/]*$", ""))
    root, scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1), F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    return F.struct(url.alias("url"), root.alias("root"), scheme.alias("scheme"), folder.alias("folder"), F.regexp_replace(folder, "[^/]+/$", "").alias("up"))


def resolved(base: Column, href: Column | str) -> Column:
    """href as seen from the page with base_parts() base: absolute, with or without scheme, from the root, a bare query or
    fragment, or relative to the page's folder (leading ./ and ../ too)."""
    return once(lambda x: joined(base, x), F.trim(col(href)))


def joined(base: Column, href: Column) -> Column:
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(base["scheme"], href))
        .when(href.startswith("/"), F.concat(base["root"], href))
        .when(href.rlike("^[?#]"), F.concat(base["url"], href))
        .when(href.startswith("../"), F.concat(base["up"], F.regexp_replace(href, r"^(\.\./)+", "")))
        .otherwise(F.concat(base["folder"], F.regexp_replace(href, r"^(\./)+", "")))
    )


def resolve(base: Column | str, href: Column | str) -> Column:
    """resolved() for a base that is used once."""
    return resolved(base_parts(base), href)


def stable_id(url: Column, external: Column | None = None) -> Column:
    """The first 20 hex digits of the SHA-1 of the id the page gives, or else of its url."""
    source = url if external is None else first_filled(external, url)
    return F.substring(F.sha1(F.btrim(source, F.lit(SPACES))), 1, 20)


# The patterns of page addresses, items and images below.


def page_url_a(url: Column | str, page: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(col(url), "/+$", ""), "/pagina-[0-9]+$", "")
    return F.when(page <= 1, col(url)).otherwise(F.concat(clean, F.lit("/pagina-"), page.cast("string")))


def page_url_b(url: Column | str, page: Column) -> Column:
    clean, n = F.regexp_replace(col(url), r"-pagina-[0-9]+\.html$", ".html"), page.cast("string")
    html = F.concat(F.regexp_replace(clean, r"\.html$", ""), F.lit("-pagina-"), n, F.lit(".html"))
    return F.when(page <= 1, col(url)).when(clean.endswith(".html"), html).otherwise(F.concat(F.regexp_replace(clean, "/+$", ""), F.lit("-pagina-"), n))


def page_url_c(url: Column | str, page: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(col(url), "/+$", ""), "/_Desde_[0-9]+_NoIndex_True/?$", "/")
    offset = (1 + (page - 1) * PAGE_SIZE).cast("string")
    return F.when(page <= 1, F.concat(base, F.lit("/"))).otherwise(F.concat(base, F.lit("/_Desde_"), offset, F.lit("_NoIndex_True")))


def has_part(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def is_property_a(url: Column | str, host: str = "argenprop.com") -> Column:
    return F.contains(authority(url), F.lit(host)) & once(lambda p: ~has_part(F.lower(p), NOT_PROPERTY_A) & (F.length(p) > 12), path(url))


def is_property_b(url: Column | str, host: str = "zonaprop.com.ar") -> Column:
    return F.contains(authority(url), F.lit(host)) & once(lambda p: ~has_part(p, NOT_PROPERTY_B) & p.rlike(r"-[0-9]{6,}\.html?$|/propiedades/.+[0-9]{6,}"), F.lower(path(url)))


def item_id(url: Column | str) -> Column:
    return F.coalesce(F.concat(F.lit("MLA"), found(col(url), "(?i)MLA-?([0-9]+)", 1)), col(url))


def slug(url: Column | str) -> Column:
    return F.nullif(F.substring_index(path(url), "/", -1), F.lit(""))


def property_type(search_url: Column | str) -> Column:
    """The first path segment without the s at its end."""
    return F.rtrim(F.get(F.split(col(search_url), "/"), F.lit(3)), F.lit("s"))


def operation(search_url: Column | str, edge: str = "/") -> Column:
    lower = F.lower(col(search_url))
    return F.when(F.contains(lower, F.lit(f"{edge}venta{edge}")), "venta").when(F.contains(lower, F.lit(f"{edge}alquiler{edge}")), "alquiler")


def image_name(url: Column | str) -> Column:
    return F.substring_index(F.substring_index(F.coalesce(col(url), F.lit("")), "/", -1), "?", 1)


def image_id(url: Column | str) -> Column:
    return found(image_name(url), "(D_NQ[^.]+|[0-9]+-MLA[0-9_]+)", 1)


def image_extension(url: Column | str) -> Column:
    return F.lower(found(image_name(url), r"\.([A-Za-z0-9]+)$", 1))
