"""SQL names for the library's functions: SQL user-defined functions, whose bodies Catalyst inlines, and table functions
over pages, which parse a page as html_page does. html_pairs has two forms:

    SELECT p.* FROM pages, LATERAL html_pairs(html) p                                       -- pos, key, value
    SELECT * FROM html_pairs(TABLE(SELECT url, html FROM pages), 'ambientes', 'cocheras')   -- url, and a column for each key
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from parcela.functions.address import COMMUNES
from parcela.functions.text import NO, YES, folding, key_of
from parcela.sources.html import html_page, page_of, pairs_of


def listed(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


NUMBER = "[0-9][0-9.,]*"
CLEAN = r"nullif(trim(regexp_replace(s, r'(?U)\s+', ' ')), '')"
FOLD = r"lower(translate(regexp_replace(coalesce(s, ''), r'\p{M}+', ''), '%s', '%s'))" % tuple(x.replace("\\", r"\\").replace("'", r"\'") for x in folding())
# tags and comments out, entities decoded, white space collapsed
PLAIN = r"regexp_replace(s, r'(?s)<!--.*?-->|</?[A-Za-z][^>]*>', ' ')"
for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    PLAIN = f"replace({PLAIN}, '{entity}', '{char}')"
FIRST = f"nullif(regexp_extract({PLAIN}, '-?{NUMBER}', 0), '')"
COUNTED = "SELECT n, length(n) - length(replace(n, '.', '')) AS p, length(n) - length(replace(n, ',', '')) AS k"

# The marks of streets, floors and units, as parcela.functions.address has them.
STREET, CARD_STREET = r"r'^(.*?)\s+([0-9]{1,6})(?:\s|$)'", r"r'^(.*?)(?:\s+([0-9]{1,6}))?$'"
FLOOR, UNIT = r"r'(?i)\b(?:piso|p\.?)[\s:]*([A-Za-z0-9-]+)'", r"r'(?i)\b(?:depto|dpto|unidad|uf)[\s:]*([A-Za-z0-9-]+)'"
ENDS_STREET = r"r'(?i),|\bpiso\b|\bdpto\b|\bdepto\b|\bunidad\b'"
# a number of a card, of which x holds nothing else
CARD_NUMBER = (
    "try_cast(CASE WHEN contains(x, ',') THEN replace(replace(x, '.', ''), ',', '.') "
    "WHEN length(x) - length(replace(x, '.', '')) > 1 OR (contains(x, '.') AND length(substring_index(x, '.', -1)) = 3) THEN replace(x, '.', '') ELSE x END AS DOUBLE)"
)

# SQL bodies for the functions whose Column forms are in parcela.functions. Later ones call earlier ones.
BODIES = {
    "clean_text": ("s STRING", "STRING", CLEAN),
    "fold": ("s STRING", "STRING", FOLD),
    "normalize_key": ("s STRING", "STRING", "regexp_replace(regexp_replace(fold(s), '[^a-z0-9]+', '_'), '^_+|_+$', '')"),
    "parse_bool": ("s STRING", "INT", f"CASE WHEN s IS NULL THEN NULL WHEN normalize_key(s) IN ({listed(YES)}) THEN 1 WHEN normalize_key(s) IN ({listed(NO)}) THEN 0 END"),
    "canonical_url": ("u STRING", "STRING", r"regexp_replace(u, r'(?s)[?#].*$', '')"),
    "property_id": ("u STRING", "STRING", r"substring(sha1(regexp_replace(u, r'(?U)^\s+|\s+$', '')), 1, 20)"),
    "item_id": ("u STRING", "STRING", "coalesce(concat('MLA', nullif(regexp_extract(u, '(?i)MLA-?([0-9]+)', 1), '')), u)"),
    "page_url_a": ("u STRING, page INT", "STRING", "CASE WHEN page <= 1 THEN u ELSE concat(regexp_replace(regexp_replace(u, '/+$', ''), '/pagina-[0-9]+$', ''), '/pagina-', page) END"),
    "page_url_c": ("u STRING, page INT", "STRING", "concat(regexp_replace(regexp_replace(u, '/+$', ''), '/_Desde_[0-9]+_NoIndex_True/?$', '/'), CASE WHEN page <= 1 THEN '/' ELSE concat('/_Desde_', 1 + (page - 1) * 48, '_NoIndex_True') END)"),
    "first_number": ("s STRING", "STRING", FIRST),
    "parse_number": (
        "s STRING", "DOUBLE",
        "(SELECT try_cast(CASE WHEN p > 0 AND k > 0 THEN replace(replace(n, '.', ''), ',', '.') WHEN p > 1 THEN replace(n, '.', '') WHEN k > 1 THEN replace(n, ',', '') "
        "WHEN k = 1 THEN CASE WHEN length(substring_index(n, ',', -1)) <= 2 THEN replace(n, ',', '.') ELSE replace(n, ',', '') END "
        "WHEN p = 1 AND length(substring_index(n, '.', -1)) = 3 THEN replace(n, '.', '') ELSE n END AS DOUBLE) "
        f"FROM ({COUNTED} FROM (SELECT {FIRST} AS n)))",
    ),
    "parse_card_number": (
        "s STRING", "DOUBLE",
        "(SELECT try_cast(CASE WHEN k > 0 THEN replace(replace(n, '.', ''), ',', '.') WHEN p > 1 OR (p = 1 AND length(substring_index(n, '.', -1)) = 3) THEN replace(n, '.', '') ELSE n END AS DOUBLE) "
        f"FROM ({COUNTED} FROM (SELECT nullif(regexp_extract(s, '{NUMBER}', 0), '') AS n)))",
    ),
    "currency": ("s STRING", "STRING", r"CASE WHEN lower(clean_text(s)) RLIKE r'\b(usd|u\$s|us\$|d[oó]lares?)\b' THEN 'USD' WHEN lower(clean_text(s)) RLIKE r'\b(ars|pesos?)\b|\$' THEN 'ARS' END"),
    "commune": ("s STRING", "INT", "CASE " + " ".join(f"WHEN contains(fold(s), '{k}') THEN {v}" for k, v in COMMUNES) + " END"),
    "number_range": (
        "s STRING", "STRUCT<low: DOUBLE, high: DOUBLE>",
        f"(SELECT named_struct('low', get(n, 0), 'high', coalesce(get(n, 1), get(n, 0))) FROM (SELECT filter(transform(regexp_extract_all(s, '({NUMBER})', 1), x -> {CARD_NUMBER}), x -> x IS NOT NULL) AS n))",
    ),
    "parse_address": (
        "s STRING", "STRUCT<full: STRING, street: STRING, number: STRING, floor: STRING, unit: STRING>",
        f"(SELECT named_struct('full', full, 'street', CASE WHEN base RLIKE {STREET} THEN trim(regexp_extract(base, {STREET}, 1)) WHEN part <> '' THEN base END, "
        f"'number', CASE WHEN base RLIKE {STREET} THEN regexp_extract(base, {STREET}, 2) END, 'floor', nullif(regexp_extract(full, {FLOOR}, 1), ''), 'unit', nullif(regexp_extract(full, {UNIT}, 1), '')) "
        f"FROM (SELECT full, part, trim(part) AS base FROM (SELECT {CLEAN} AS full, get(split(coalesce({CLEAN}, ''), {ENDS_STREET}, 2), 0) AS part)))",
    ),
    "card_address": (
        "s STRING", "STRUCT<street: STRING, number: INT>",
        f"(SELECT named_struct('street', trim(regexp_extract(a, {CARD_STREET}, 1)), 'number', try_cast(nullif(regexp_extract(a, {CARD_STREET}, 2), '') AS INT)) FROM (SELECT trim(substring_index(coalesce(s, ''), ',', 1)) AS a))",
    ),
    "place_parts": (
        "s STRING", "STRUCT<district: STRING, town: STRING, province: STRING>",
        "(SELECT named_struct('district', CASE WHEN size(p) >= 3 THEN try_element_at(p, -2) END, 'town', CASE WHEN size(p) > 0 THEN try_element_at(p, -1) END, 'province', CASE WHEN contains(lower(s), 'capital federal') THEN 'Capital Federal' END) "
        "FROM (SELECT filter(transform(split(coalesce(s, ''), ','), x -> trim(x)), x -> x <> '') AS p))",
    ),
}


@F.udtf(returnType="pos int, href string")
class HtmlLinks:
    """The links of a page, in order."""

    def eval(self, html: str | None) -> Iterator[tuple[int, str]]:
        found = [dict(r["attrs"]).get("href") for r in (page_of(html) or {"elements": []})["elements"] if r["tag"] == "a"]
        yield from enumerate(h for h in found if h)


@F.udtf(returnType="pos int, object string")
class JsonldObjects:
    """Every object of a page's JSON-LD, outer ones first."""

    def eval(self, html: str | None) -> Iterator[tuple[int, str]]:
        yield from enumerate((page_of(html) or {"jsonld": []})["jsonld"])


class HtmlPairs:
    """Pairs of table rows and of definition lists. Of a text: pos, key, value. Of a table with a column html, and names: the
    table's other columns, and the last value of each name (as normalize_key() has it); null where a page has none."""

    @staticmethod
    def analyze(source: AnalyzeArgument, *names: AnalyzeArgument) -> AnalyzeResult:
        if not source.isTable:
            if names:
                raise ValueError("names are for tables: html_pairs(TABLE(...), 'name', ...)")
            return AnalyzeResult(T.StructType().add("pos", T.IntegerType()).add("key", T.StringType()).add("value", T.StringType()))
        if "html" not in source.dataType.names:
            raise ValueError("the table has no column html")
        if not names or any(n.value is None for n in names):
            raise ValueError("the names must be constants, and one at least")
        kept = [f for f in source.dataType.fields if f.name != "html"]
        return AnalyzeResult(T.StructType(kept + [T.StructField(key_of(n.value), T.StringType()) for n in names]))

    def eval(self, source: Row | str | None, *names: str) -> Iterator[tuple]:
        if not isinstance(source, Row):
            yield from ((i, k, v) for i, (k, v) in enumerate(pairs_of(page_of(source))))
            return
        own = {key_of(k): v for k, v in pairs_of(page_of(source["html"]))}
        yield (*(x for f, x in source.asDict(recursive=False).items() if f != "html"), *(own.get(key_of(n)) for n in names))


TABLES = {"html_pairs": F.udtf(HtmlPairs), "html_links": HtmlLinks, "jsonld_objects": JsonldObjects}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions callable in this session's SQL; returns their names."""
    for name, (args, kind, body) in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    spark.udf.register("html_page", html_page())
    for name, table in TABLES.items():
        spark.udtf.register(name, table)
    return sorted([*BODIES, "html_page", *TABLES])
