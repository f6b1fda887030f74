"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from parcela.llm.bpe import op3_bpe
from parcela.llm.classifier import op10_quality_classifier
from parcela.llm.codebooks import op13_vector_codes
from parcela.llm.imatch import op4_imatch
from parcela.llm.importance import op12_importance_resampling
from parcela.llm.jaccard import op7_ngram_join
from parcela.llm.licenses import op9_license_scan
from parcela.llm.lines import op2_line_dedup
from parcela.llm.mixing import op6_mix_sources
from parcela.llm.packing import op11_harmonic_packing
from parcela.llm.quality import op5_quality_rules
from parcela.llm.substrings import op1_substring_dedup
from parcela.llm.urls import op8_url_filters


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_bpe": op3_bpe,
    "op4_imatch": op4_imatch,
    "op5_quality_rules": op5_quality_rules,
    "op6_mix_sources": op6_mix_sources,
    "op7_ngram_join": op7_ngram_join,
    "op8_url_filters": op8_url_filters,
    "op9_license_scan": op9_license_scan,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_harmonic_packing": op11_harmonic_packing,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_vector_codes": op13_vector_codes,
}

WORDS_SQL = r"select doc_id, unnest(range(1, len(ws) + 1)) as pos, unnest(ws) as w from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents)"
SIZE_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

BYTES_SQL = "list_transform(range(strlen(w)), lambda i: ('0x' || hex(encode(w))[2 * i + 1 : 2 * i + 2])::bigint)"
FEATURES_SQL = r"unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w"
#: One round of k-means: parts and codebook before it in, codebook after it out.
NEAREST_SQL = "select i, p, arg_min(e, (d, e)) as e, min(d) as d from (select x.i, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from parts x join {book} b using (p)) group by i, p"
MEANS_SQL = "select p, e, list(floor(total / n)::bigint order by place) as v from (select p, e, place, sum(c)::double as total, count(*) as n from (select near.p, near.e, unnest(v) as c, unnest(range(len(v))) as place from near{k} near join parts using (i, p)) group by all) group by p, e"
ROUND_SQL = ", near{k} as materialized ({nearest}), book{after} as materialized (select p, e, coalesce(m.v, b.v) as v from book{k} b left join ({means}) m using (p, e))"

#: For ids of their own, as the test tables have. The other operators have no SQL: merges, MinHash groups of lines,
#: expectation-maximisation, models and alignments.
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": f"""
with words as ({WORDS_SQL}),
  windows as (select doc_id, pos, md5(string_agg(w, ' ') over here) as k, count(*) over here as n from words window here as (partition by doc_id order by pos rows between current row and 19 following)),
  again as (select doc_id, pos, k from (select *, row_number() over (partition by k order by doc_id, pos) as r from windows where n = 20) where r > 1),
  firsts as (select k, min(doc_id) as src, arg_min(pos, (doc_id, pos)) as src_pos from windows where n = 20 group by k),
  spans as (select doc_id, count(*) as n_spans from (select doc_id, pos, src, src_pos, lag((src, src_pos + 1, pos + 1)) over (partition by doc_id order by pos) as led from again join firsts using (k)) where led is distinct from (src, src_pos, pos) group by doc_id),
  gone as (select distinct doc_id, unnest(range(pos, pos + 20)) as pos from again),
  kept as (select doc_id, string_agg(w, ' ' order by pos) as t, count(*) as n from words anti join gone using (doc_id, pos) group by doc_id),
  sizes as (select doc_id, {SIZE_SQL} as n_words from documents)
select doc_id, n_words, n_words - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256, coalesce(n_spans, 0) as n_spans from sizes left join kept using (doc_id) left join spans using (doc_id)""",
    "op6_mix_sources": f"""
with sized as (select doc_id, text, source, {SIZE_SQL} as size from documents),
  sources as (select source, sum(size)::bigint as size, [5e0, 2e0, 1e0][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from sized group by source),
  steps as (select *, 3e0 * size / weight as top from sources),
  levels as (select *, ((select sum(size) from sources) - coalesce(sum(3e0 * size) over before, 0)) / sum(weight) over after as level from steps window before as (order by top, source rows between unbounded preceding and 1 preceding), after as (order by top, source rows between current row and unbounded following)),
  targets as (select source, size as source_size, least(3e0 * size, (select level from levels where level <= top order by top, source limit 1) * weight) as target from levels),
  rates as (select doc_id, size, source_size, target, case when source_size > 0 then least(3e0, target / source_size) else 0 end as rate, ('0x' || left(md5('20240611|' || doc_id || '|' || coalesce(text, '')), 13))::bigint / 4503599627370496e0 as draw
    from sized join targets on sized.source is not distinct from targets.source)
select doc_id, size, source_size, target, (size * copies)::bigint as taken, copies from (select *, (floor(rate) + (draw < rate - floor(rate))::int)::int as copies from rates)""",
    "op7_ngram_join": f"""
with recursive words as ({WORDS_SQL}),
  grams as (select doc_id, pos, count(*) over here as n, string_agg(w, ' ') over here as g, count(*) over (partition by doc_id) as size from words window here as (partition by doc_id order by pos rows between current row and 4 following)),
  sets as (select distinct doc_id, g from grams where n = 5 or (pos = 1 and size < 5) union all select doc_id, '' from documents where {SIZE_SQL} = 0),
  sizes as (select doc_id, count(*) as n from sets group by doc_id),
  pairs as (select x, y from (select a.doc_id as x, b.doc_id as y, count(*) as c from sets a join sets b on a.g = b.g and a.doc_id <> b.doc_id group by all) join sizes s on s.doc_id = x join sizes t on t.doc_id = y where c >= 0.8 * (s.n + t.n - c)),
  reach as (select doc_id as x, doc_id as y from documents union select r.x, p.y from reach r join pairs p on p.x = r.y)
select doc_id, min(y) as class_id, (select count(*) from pairs where pairs.x = doc_id) as n_links from documents join reach on reach.x = doc_id group by doc_id""",
    "op12_importance_resampling": f"""
with crcs as (select list_transform(range(256), lambda c: list_reduce(range(8), lambda a, x: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, c::bigint)) as tab),
  words as (select doc_id, {FEATURES_SQL} from documents),
  wanted as (select {FEATURES_SQL} from benchmark),
  spelled as (select w, {BYTES_SQL} as bytes from (select w from words union select w from wanted)),
  buckets as materialized (select w, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, tab[xor(a & 255, x) + 1]), 4294967295::bigint), 4294967295) % 10000 as b from spelled, crcs),
  own as materialized (select doc_id, b from words join buckets using (w)),
  counts as (select b, count(*) filter (mine) as s, count(*) filter (not mine) as t from (select b, true as mine from own union all select b, false from wanted join buckets using (w)) group by b),
  gains as (select b, floor(1000e0 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from counts),
  sums as (select doc_id, count(*) as n, sum(gain) as total from own join gains using (b) group by doc_id),
  weights as (select doc_id, coalesce(n, 0)::bigint as n_features, coalesce(floor(total::double / n), 0)::bigint as weight, ('0x' || left(sha256('2024:' || doc_id), 8))::bigint::double as h from documents left join sums using (doc_id)),
  scores as (select doc_id, n_features, weight, weight + floor(-1000e0 * ln(-ln((h + 0.5e0) / 4294967296e0)))::bigint as score from weights),
  places as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_features >= 20) as among from scores)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= among * 10 // 100 then place end as rank from places""",
    "op13_vector_codes": f"""
with vectors as materialized (select row_number() over (order by vec_id) as i, vec_id, label, list_transform(embedding, lambda x: floor(1024e0 * x)::bigint) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  parts as materialized (select i, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] as v from vectors, (select unnest(range(4)) as p)),
  book0 as (select p, i - 1 as e, v from parts where i <= 256)
  {"".join(ROUND_SQL.format(k=k, after=k + 1, nearest=NEAREST_SQL.format(book=f"book{k}"), means=MEANS_SQL.format(k=k)) for k in range(4))},
  codes as (select i, string_agg(lpad(lower(hex(e)), 2, '0'), '' order by p) as code, sum(d)::bigint as error from ({NEAREST_SQL.format(book="book4")}) group by i)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) from book4) as codebooks_sha256 from vectors join codes using (i)""",
}
