"""Queries over the test tables, each with the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela import portal_queries
from parcela.functions import address, features, numbers, text, urls
from parcela.operators import incremental as inc
from parcela.operators.observed import Counters
from parcela.plans import portals
from parcela.sources import snapshots, tables
from parcela.sources.keys import KnownKeys
from parcela.streaming import crawl, journal

QUERIES, ORACLE_SQL = {**portal_queries.QUERIES}, {**portal_queries.ORACLE_SQL}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{tables.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


HREF = '<a [^>]*href="([^"]*)"'
TITLE = "(?s)<title>(.*?)</title>"


@query(f"""
select page_id, regexp_replace(url, '[?#].*$', '') as canonical_url, substring(sha1(regexp_replace(url, '[?#].*$', '')), 1, 20) as property_id,
  nullif(regexp_extract(html, '{TITLE}', 1), '') as title, len(regexp_extract_all(html, '{HREF}', 1))::int as n_links,
  nullif(concat_ws('|', case when regexp_extract(html, '{TITLE}', 1) = '' then 'titulo_no_encontrado' end, case when not contains(lower(html), 'usd') then 'precio_no_encontrado' end), '') as warnings
from pages""")
def page_profile(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    title = text.found(F.col("html"), TITLE, 1)
    return p.select(
        "page_id", urls.canonical("url").alias("canonical_url"), urls.stable_id(urls.canonical("url")).alias("property_id"), title.alias("title"), F.size(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("n_links"),
        text.warnings(titulo_no_encontrado=title.isNull(), precio_no_encontrado=~F.contains(F.lower("html"), F.lit("usd"))).alias("warnings"),
    )


def page_hrefs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("pos", "href"))


LINKS_SQL = f"select page_id, (unnest(range(1, len(a) + 1)) - 1)::int as pos, unnest(a) as href from (select page_id, regexp_extract_all(html, '{HREF}', 1) as a from pages)"


@query(LINKS_SQL)
def page_links(spark, sf_dir):
    return page_hrefs(spark, sf_dir)


@query(f"select page_id, href, min(pos) as pos from ({LINKS_SQL}) group by all")
def page_links_distinct(spark, sf_dir):
    return inc.earliest(page_hrefs(spark, sf_dir), ["page_id", "href"], "pos").select("page_id", "href", "pos")


@query(f"select page_id, pos, row_number() over (partition by page_id order by pos)::int as position from ({LINKS_SQL})")
def link_positions(spark, sf_dir):
    return inc.numbered(page_hrefs(spark, sf_dir), ["page_id"], "pos").select("page_id", "pos", "position")


@query(r"""
select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as authority, p as path, nullif(split_part(p, '/', -1), '') as slug, rtrim(split_part(url, '/', 4), 's') as property_type,
  case when contains(lower(url), '/venta/') then 'venta' when contains(lower(url), '/alquiler/') then 'alquiler' end as operation, length(p) > 6 and not regexp_matches(p, '/blog|/ayuda') as is_property
from (select *, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as p from pages)""")
def url_parts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", urls.authority("url").alias("authority"), urls.path("url").alias("path"), urls.slug("url").alias("slug"), urls.property_type("url").alias("property_type"), urls.operation("url").alias("operation"), ((F.length(urls.path("url")) > 6) & ~urls.has_part(urls.path("url"), ("/blog", "/ayuda"))).alias("is_property"))


@query(r"""
select page_id, page, case when page <= 1 then url else regexp_replace(rtrim(url, '/'), '/pagina-[0-9]+$', '') || '/pagina-' || page end as a,
  case when page <= 1 then url when suffix(url, '.html') then regexp_replace(url, '\.html$', '') || '-pagina-' || page || '.html' else rtrim(url, '/') || '-pagina-' || page end as b,
  case when page <= 1 then rtrim(url, '/') || '/' else rtrim(url, '/') || '/_Desde_' || (1 + (page - 1) * 48) || '_NoIndex_True' end as c
from pages, (select unnest(range(1, 4))::int as page)""")
def page_url_dialects(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page"))
    return p.select("page_id", "page", urls.page_url_a("url", F.col("page")).alias("a"), urls.page_url_b("url", F.col("page")).alias("b"), urls.page_url_c("url", F.col("page")).alias("c"))


STRIP = r"(?is)<(script|style|noscript|template)[^>]*>.*?</(script|style|noscript|template)>"


@query(rf"select page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '{STRIP}', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'), '[\s]+', ' ', 'g'))) as visible_md5 from pages")
def visible_text(spark, sf_dir):
    shown = F.regexp_replace(F.regexp_replace("html", STRIP, " "), "(?s)<!--.*?-->|<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.trim(F.regexp_replace(shown, r"[\s]+", " ")).cast("binary")).alias("visible_md5"))


NUMBER_SQL = """try_cast(case when p > 0 and k > 0 then replace(replace(n, '.', ''), ',', '.') when p > 1 then replace(n, '.', '') when k > 1 then replace(n, ',', '')
  when k = 1 then case when length(split_part(n, ',', -1)) <= 2 then replace(n, ',', '.') else replace(n, ',', '') end when p = 1 and length(split_part(n, '.', -1)) = 3 then replace(n, '.', '') else n end as double)"""
CARD_NUMBER_SQL = "try_cast(case when k > 0 then replace(replace(n, '.', ''), ',', '.') when p > 1 or (p = 1 and length(split_part(n, '.', -1)) = 3) then replace(n, '.', '') else n end as double)"
COUNTS_SQL = "length(n) - length(replace(n, '.', '')) as p, length(n) - length(replace(n, ',', '')) as k"


@query(f"select doc_id, {NUMBER_SQL} as number, trunc({NUMBER_SQL})::bigint as whole from (select *, {COUNTS_SQL} from (select doc_id, nullif(regexp_extract(text, '-?[0-9][0-9.,]*', 0), '') as n from documents))")
def doc_first_number(spark, sf_dir):
    n = numbers.parse_number("text")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("number"), n.try_cast("long").alias("whole"))


@query(f"select doc_id, {CARD_NUMBER_SQL} as number from (select *, {COUNTS_SQL} from (select doc_id, nullif(regexp_extract(text, '[0-9][0-9.,]*', 0), '') as n from documents))")
def doc_card_number(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", numbers.parse_card_number("text").alias("number"))


@query(f"""with found as (select doc_id, unnest(range(1, len(a) + 1)) as i, unnest(a) as n from (select doc_id, regexp_extract_all(text, '[0-9][0-9.,]*') as a from documents)),
  read as (select doc_id, {CARD_NUMBER_SQL} as v, i from (select *, {COUNTS_SQL} from found)), kept as (select doc_id, list(v order by i) as l from read where v is not null group by doc_id)
select doc_id, l[1] as low, coalesce(l[2], l[1]) as high from documents left join kept using (doc_id)""")
def doc_number_range(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", numbers.number_range("text").alias("r")).select("doc_id", "r.low", "r.high")


# c_acctbal as text in different notations, by customer
MONEY = "case c_custkey % 5 when 0 then 'USD ' || t when 1 then 'US$ ' || t when 2 then '$ ' || replace(t, '.', ',') when 3 then t || ' pesos' else t end"
MONEY_SQL = f"select c_custkey, {MONEY} as m from (select c_custkey, cast(cast(c_acctbal as decimal(12, 2)) as varchar) as t from customer)"


@query(f"""select c_custkey, case when regexp_matches(lower(m), '\\b(usd|u\\$s|dolares?)\\b') then 'USD' when regexp_matches(lower(m), '\\b(ars|pesos?)\\b|\\$') then 'ARS' end as currency, {NUMBER_SQL} as amount,
  case when regexp_matches(m, '(?i)US\\$|U\\$S|USD') then 'USD' else 'ARS' end as card_currency, abs({CARD_NUMBER_SQL}) as card_amount
from (select *, length(n) - length(replace(n, '.', '')) as p, length(n) - length(replace(n, ',', '')) as k from (select c_custkey, m, nullif(regexp_extract(m, '-?[0-9][0-9.,]*', 0), '') as n from ({MONEY_SQL})))""")
def money_parse(spark, sf_dir):
    t = F.col("c_acctbal").cast("decimal(12,2)").cast("string")
    k = F.col("c_custkey") % 5
    m = F.when(k == 0, F.concat(F.lit("USD "), t)).when(k == 1, F.concat(F.lit("US$ "), t)).when(k == 2, F.concat(F.lit("$ "), F.replace(t, F.lit("."), F.lit(",")))).when(k == 3, F.concat(t, F.lit(" pesos"))).otherwise(t)
    own = table(spark, sf_dir, "customer").select("c_custkey", numbers.parse_money(m).alias("a"), numbers.card_money(m).alias("b"))
    return own.select("c_custkey", F.col("a.currency").alias("currency"), F.col("a.amount").alias("amount"), F.col("b.currency").alias("card_currency"), F.col("b.amount").alias("card_amount"))


@query("""select doc_id, md5(regexp_replace(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) as key_md5,
  contains(lower(strip_accents(text)), 'sum')::int as has_sum, contains(lower(strip_accents(text)), 'cion')::int as has_cion from documents""")
def fold_key(spark, sf_dir):
    """A digest of the key of the whole text, and whether terms occur in it."""
    folded = text.fold("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_key("text").cast("binary")).alias("key_md5"), text.flag(F.contains(folded, F.lit("sum"))).alias("has_sum"), text.flag(F.contains(folded, F.lit("cion"))).alias("has_cion"))


@query("""select doc_id, md5(regexp_replace(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) as key_md5 from documents""")
def fold_key_whole(spark, sf_dir):
    """The key alone."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_key("text").cast("binary")).alias("key_md5"))


BOOLS = ("Sí", "no", "TRUE", "sin", "No apto", "quizás", "1", "0", "Incluido", "")


@query(f"""select o_orderkey, case when k in ('si', 'true', '1', 'incluido', 'disponible', 'apto') then 1 when k in ('no', 'false', '0', 'sin', 'no_apto') then 0 end::int as flag
from (select o_orderkey, regexp_replace(regexp_replace(lower(strip_accents(list_value({", ".join(f"'{b}'" for b in BOOLS)})[o_orderkey % {len(BOOLS)} + 1])), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as k from orders)""")
def bool_parse(spark, sf_dir):
    said = F.get(F.array(*map(F.lit, BOOLS)), (F.col("o_orderkey") % len(BOOLS)).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.parse_bool(said).alias("flag"))


@query("""select doc_id, case when contains(t, 'ation') then 'a' when contains(t, 'ment') then 'b' when contains(t, 'cion') or contains(t, 'keit') then 'c' end as status,
  contains(t, 'the')::int as f_the, (contains(t, 'der') or contains(t, 'des'))::int as f_der from (select doc_id, lower(strip_accents(text)) as t from documents)""")
def ordered_classes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.fold("text").alias("t"))
    status = features.first_class(F.col("t"), (("a", ("ation",)), ("b", ("ment",)), ("c", ("cion", "keit"))))
    return d.select("doc_id", status.alias("status"), text.flag(F.contains("t", F.lit("the"))).alias("f_the"), text.flag(text.contains_any(F.col("t"), ("der", "des"))).alias("f_der"))


# addresses made of names and keys
@query(r"""select s_suppkey, case when regexp_matches(b, '^(.*?)\s+([0-9]{1,6})(\s|$)') then trim(regexp_extract(b, '^(.*?)\s+([0-9]{1,6})(\s|$)', 1)) when b <> '' then b end as street,
  nullif(regexp_extract(b, '^(.*?)\s+([0-9]{1,6})(\s|$)', 2), '') as number, nullif(regexp_extract(a, '(?i)\b(piso|p\.?)[\s:]*([A-Za-z0-9-]+)', 2), '') as floor,
  trim(regexp_extract(c, '^(.*?)(\s+([0-9]{1,6}))?$', 1)) as card_street, try_cast(nullif(regexp_extract(c, '^(.*?)(\s+([0-9]{1,6}))?$', 3), '') as int) as card_number, case when s_suppkey % 2 = 0 then 'Palermo' end as district, 'Capital Federal' as town
from (select *, trim(split_part(split_part(a, ',', 1), ' Piso', 1)) as b, trim(split_part(a, ',', 1)) as c from (select s_suppkey, 'Calle ' || s_suppkey || ' ' || (s_suppkey * 37) || case when s_suppkey % 3 = 0 then ' Piso ' || (s_suppkey % 9) else '' end || case when s_suppkey % 2 = 0 then ', Palermo' else '' end || ', Capital Federal' as a from supplier))""")
def address_split(spark, sf_dir):
    k = F.col("s_suppkey")
    a = F.concat(F.lit("Calle "), k, F.lit(" "), k * 37, F.when(k % 3 == 0, F.concat(F.lit(" Piso "), k % 9)).otherwise(""), F.when(k % 2 == 0, ", Palermo").otherwise(""), F.lit(", Capital Federal"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", address.parse_address(a).alias("p"), address.card_address(a).alias("c"), address.place_parts(a).alias("l"))
    return s.select("s_suppkey", "p.street", "p.number", "p.floor", F.col("c.street").alias("card_street"), F.col("c.number").alias("card_number"), "l.district", "l.town")


NAMES = (("blue", 1), ("green", 2), ("red", 3), ("re", 4), ("a", 5))


@query(f"""select p_partkey, (select v from (values {", ".join(f"({i}, '{k}', {v})" for i, (k, v) in enumerate(NAMES))}) t(ord, k, v) where contains(lower(p_name), k) order by ord limit 1)::int as v from part""")
def lookup_contains_first(spark, sf_dir):
    lookup = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(NAMES)], "ord int, k string, v int")
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("n"))
    return address.first_contained(p, "n", lookup).select("p_partkey", "v")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def anti_join_new(spark, sf_dir):
    return inc.new_only(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("select doc_id, 'sin_etiqueta' as reason from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def outer_join_dead_letter(spark, sf_dir):
    return inc.matched_or_failed(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", "sin_etiqueta")[1]


@query("select user_id, event_id, event_type, value, first_seen from (select *, row_number() over (partition by user_id order by event_id desc) as r, min(event_id) over (partition by user_id) as first_seen from events) where r = 1")
def latest_by_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return inc.latest(e, "user_id", "event_id")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id) as r from events) where r = 1")
def first_by_key(spark, sf_dir):
    return inc.earliest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("select page_id, url from pages where page_id >= 10 and page_id < 110 order by page_id limit 37")
def budget_limit(spark, sf_dir):
    return inc.budget(inc.page_range(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id", 10, 100), ["page_id"], 37)


@query("select (min(first) + 1)::bigint as stop_page from (select r, min(page_id) as first, count(*) as n from (select page_id, page_id - row_number() over (order by page_id) as r from pages where length(html) % 3 = 0) group by r) where n >= 2")
def stop_after_empty(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", (F.length("html") % 3 == 0).alias("empty"))
    return inc.stop_page(p, "page_id", "empty")


@query("select c_name as name, c_acctbal as acctbal, c_mktsegment as segment, null::bigint as key from customer union all select s_name, s_acctbal, null, s_suppkey from supplier")
def union_missing(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"), F.col("s_suppkey").alias("key"))
    return c.unionByName(s, allowMissingColumns=True)


@query("select count(*) as n_rows, count(distinct user_id) as n_keys from events")
def distinct_counts(spark, sf_dir):
    return inc.counters(table(spark, sf_dir, "events"), "user_id")


@query("select event_id, props->>'k' as k, try_cast(props->>'k' as bigint) as n from events")
def json_extract(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), k.try_cast("long").alias("n"))


@query("""select event_id, '{"event":"' || event_type || '","user":"' || user_id || '"}' as doc from events""")
def json_sorted(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("event"), F.col("event_type")).alias("m"))
    return e.select("event_id", inc.sorted_json("m").alias("doc"))


@query("""select l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice / l_quantity * 100 + 0.5e0) / 100 as unit_price, floor((l_extendedprice - l_extendedprice * (1 - l_discount)) / l_extendedprice * 100 * 100 + 0.5e0) / 100 as discount_pct,
  (l_quantity <> l_linenumber)::int as is_range, floor(l_quantity - l_linenumber * 1e0 + 0e0)::double as span from lineitem""")
def derived_prices(spark, sf_dir):
    price, q, n = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_linenumber")
    now = price * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.rounded(numbers.per_unit(price, q)).alias("unit_price"), text.rounded(numbers.discount_percent(price, now)).alias("discount_pct"), (q != n).cast("int").alias("is_range"), F.floor(q - n).cast("double").alias("span"))


@query("""select doc_id, floor((1 + (lang is not null and lang <> '')::int + (quality is not null)::int + (toxic is not null)::int) / 4.0e0 * 100 * 10e0 + 0.5e0) / 10 as completeness from documents left join labels using (doc_id)""")
def completeness_pct(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", text.rounded(features.completeness(F.col("doc_id"), F.col("lang"), F.col("quality"), F.col("toxic")), 1).alias("completeness"))


@query(r"select page_id, coalesce(len(list_filter(string_split_regex(url, '[/]'), lambda x: trim(x) <> '')), 0)::int as tokens, case when page_id % 7 = 0 then 'intermediate' when page_id % 11 = 0 then 'not_found' when page_id % 13 = 0 then 'http_error' else 'ok' end as response from pages")
def response_classes(spark, sf_dir):
    k = F.col("page_id")
    status = F.when(k % 7 == 0, 202).when(k % 11 == 0, 404).when(k % 13 == 0, 500).otherwise(200)
    p = portals.classified(table(spark, sf_dir, "pages").withColumn("status", status))
    return p.select("page_id", text.token_count(F.replace("url", F.lit("/"), F.lit("|"))).alias("tokens"), "response")


@query("select user_id, max(event_id) as event_id, min(event_id) as first_seen from events group by user_id")
def journal_snapshot(spark, sf_dir):
    path = scratch(spark, "journal")
    table(spark, sf_dir, "events").select("user_id", "event_id", "event_type").write.option("ignoreNullFields", "false").json(path)
    return inc.latest(tables.read_journal(spark, path, "user_id long, event_id long, event_type string"), "user_id", "event_id").select("user_id", "event_id", "first_seen")


@query("select distinct user_id from events")
def stream_dedup(spark, sf_dir):
    base = scratch(spark, "stream")
    table(spark, sf_dir, "events").select("user_id", "event_id").repartition(4).write.parquet(f"{base}/in")
    rows = journal.captured_rows(spark, f"{base}/in", "user_id long, event_id long", files=1, fmt="parquet")
    journal.write_journal(journal.first_wins(rows, "user_id"), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema("user_id long, event_id long").parquet(f"{base}/out").select("user_id")


@query("""select user_id, max(event_id) as event_id, min(event_id) as first_seen from events group by user_id""")
def stream_snapshot(spark, sf_dir):
    """The snapshot that the last micro-batch of a stream left."""
    base = scratch(spark, "snapshots")
    table(spark, sf_dir, "events").select("user_id", "event_id").repartition(4).write.parquet(f"{base}/in")
    rows = journal.captured_rows(spark, f"{base}/in", "user_id long, event_id long", files=1, fmt="parquet")
    journal.with_snapshots(rows, "user_id", "event_id", f"{base}/out", f"{base}/state", every=2).awaitTermination()
    journal.write_state(spark, "user_id", "event_id", f"{base}/out")
    return spark.read.schema("user_id long, event_id long, first_seen long").option("header", "true").csv(f"{base}/out/snapshot")


@query("select user_id, arg_max(event_id, (event_id % 3, event_id)) as event_id, (min(event_id % 3) + 1)::bigint as first_commit from events group by user_id")
def journal_latest(spark, sf_dir):
    """The last line of each key in a journal of three appends, and the first append that had the key."""
    path = scratch(spark, "journal")
    for k in range(3):
        tables.append_journal(table(spark, sf_dir, "events").filter(F.col("event_id") % 3 == k).select("user_id", "event_id").orderBy("event_id"), path)
    last = inc.latest(tables.read_journal(spark, path, "user_id long, event_id long", offset="at"), "user_id", "at")
    return last.select("user_id", "event_id", F.col("first_seen.commit").alias("first_commit"))


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, min(event_id) as first_seen from events group by user_id")
def snapshot_merge(spark, sf_dir):
    """A snapshot that three batches were merged into, out of order."""
    path = scratch(spark, "merged")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    for number, k in enumerate((2, 0, 1)):
        snapshots.merge(events.filter(F.col("event_id") % 3 == k), path, "user_id", "event_id", buckets=16, batch=number)
    return snapshots.read(spark, path)


@query("""
with p as (select page_id // 20 as s, page_id % 20 as page, length(html) % 11 <> 0 as has_html, case when length(html) % 11 <> 0 and length(html) % 5 <> 0 then ['k' || page_id % 37, 'k' || page_id % 11] else [] end as links from pages),
  q as (select *, len(links) = 0 as nothing, lag(len(links) = 0) over (partition by s order by page) as before from p),
  e as (select s, min(page) as stop from q where nothing and before group by s),
  r as (select q.*, coalesce(page = stop, false) as ended from q left join e using (s) where stop is null or page <= stop),
  l as (select s, page, pos, url from (select s, page, unnest(range(len(links))) as pos, unnest(links) as url from r) qualify row_number() over (partition by s, url order by page, pos) = 1),
  n as (select s, page, count(*) as c from l group by s, page),
  t as (select r.s, r.page, ended, max(case when has_html and not ended then r.page end) over w as last_completed, sum(coalesce(c, 0)) over w as n_links from r left join n using (s, page) window w as (partition by r.s order by r.page))
select 'page' as kind, 'https://x.example/' || s as search_url, page::int as page, null::int as pos, null::varchar as url, last_completed::int as last_completed, n_links::bigint as n_links, ended from t
union all select 'link', 'https://x.example/' || s, page::int, pos::int, url, last_completed::int, n_links::bigint, ended from l join t using (s, page)""")
def stream_crawl(spark, sf_dir):
    """The crawl of searches of 20 pages each, stopped and taken up again twice."""
    base, k = scratch(spark, "crawl"), F.col("page_id")
    crawl.use_rocksdb(spark)
    has_html = F.length("html") % 11 != 0
    links = F.when(has_html & (F.length("html") % 5 != 0), F.array(*[F.concat(F.lit("k"), (k % n).cast("string")) for n in (37, 11)]))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("https://x.example/"), F.floor(k / 20).cast("string")).alias("search_url"), (k % 20).cast("int").alias("page"), has_html.alias("has_html"), links.alias("links"))
    for first, last in ((0, 7), (7, 8), (8, 20)):
        pages.filter(F.col("page").between(first, last - 1)).write.mode("append").parquet(f"{base}/in")
        events = crawl.crawl(crawl.captured_pages(spark, f"{base}/in", files=1000, fmt="parquet"))
        events.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(crawl.EVENTS).parquet(f"{base}/out").drop("empty_in_a_row")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_totalprice > 250000)")
def known_keys(spark, sf_dir):
    """Customers without large orders: the large orders' customers are the keys of two earlier runs."""
    known = KnownKeys(spark, scratch(spark, "keys"), "bigint", buckets=16)
    orders = table(spark, sf_dir, "orders").filter("o_totalprice > 250000").select("o_orderkey", "o_custkey")
    for k in (0, 1):
        known.add(orders.filter(F.col("o_orderkey") % 2 == k), "o_custkey")
    return known.new_only(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")


@query("select event_type, count(*) as n_rows, count(value) as n_values, count(distinct user_id) as n_keys from events group by event_type")
def observed_counts(spark, sf_dir):
    """Counters of a run that splits events by type: taken while the parts and their keys are written, in one pass each."""
    counters, base = Counters(spark), scratch(spark, "observed")
    events = table(spark, sf_dir, "events").select("event_type", "user_id", "value")
    types = [r[0] for r in events.select("event_type").distinct().collect()]  # a handful, as the schema says
    per_type = {f"{m}_{i}": F.count(F.when(F.col("event_type") == t, F.col(c))) for i, t in enumerate(types) for m, c in (("rows", "event_type"), ("values", "value"))}
    counters.watch(events, "events", **per_type).write.parquet(f"{base}/events")
    keys = spark.read.schema(events.schema).parquet(f"{base}/events").groupBy("event_type", "user_id").count()
    counters.watch(keys, "keys", **{f"keys_{i}": F.count(F.when(F.col("event_type") == t, 1)) for i, t in enumerate(types)}).write.parquet(f"{base}/keys")
    found = counters.found
    rows = [(t, found["events"][f"rows_{i}"], found["events"][f"values_{i}"], found["keys"][f"keys_{i}"]) for i, t in enumerate(types)]
    return spark.createDataFrame(rows, "event_type string, n_rows long, n_values long, n_keys long")
