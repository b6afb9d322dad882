"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from branchspark.llm import bpe_codec, contamination, language_id, lm_score, near_dup, quality, secret_scan, token_counts, url_filters, warc
from branchspark.llm.common import ASCII_LOWER, ASCII_UPPER, table


def op1_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op10_bpe_codec(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_codec.encode_digests(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


def op6_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.fit(docs, quality.target_ids(table(spark, sf_dir, "labels")))
    return quality.judge(docs, weights).drop("text")


OP6_SQL = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) as i from d),
words as (select r, count(*) as n_words, sum(length(w)) as word_chars from w group by r),
grams as (select r, i, w, lead(w, 1) over o as w2, lead(w, 2) over o as w3 from w window o as (partition by r order by i)),
counted as (select r, i, count(*) over (partition by r, w, w2, w3) as c from grams where w3 is not null),
repeats as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from counted where c > 1) group by r),
lines as (select r, unnest(string_split(text, chr(10))) as line from d),
dups as (select r, count(*) - count(distinct line) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
t as (select r, unnest(regexp_extract_all(text, '[0-9A-Za-z_\x80-\x{{10FFFF}}]+|[!-/:-@\[-^`{{-~]+')) as t, generate_subscripts(regexp_extract_all(text, '[0-9A-Za-z_\x80-\x{{10FFFF}}]+|[!-/:-@\[-^`{{-~]+'), 1) as i from d),
h as (select r, i, ('0x' || substr(md5(t), 1, 15))::bigint as h from t),
h2 as (select r, h, lead(h) over (partition by r order by i) as n from h),
b as (select r, h % {quality.BUCKETS} as b from h2 union all select r, (h % 1000003 * 1009 + n % 999983) % {quality.BUCKETS} from h2 where n is not null),
trusted as (select doc_id from labels where doc_id is not null group by doc_id having min(quality) = 1 order by md5(doc_id::varchar), doc_id limit {quality.TARGET_BOUND}),
sums as (select b, count(*) as raw, count(*) filter (doc_id in (select doc_id from trusted)) as good from b join d using (r) group by b),
weights as (select b, round(ln((good + 1) / (sum(good) over () + {quality.BUCKETS}) / ((raw + 1) / (sum(raw) over () + {quality.BUCKETS}))) * 1e6)::bigint as weight from sums),
scores as (select r, floor(sum(weight)::double / count(*))::bigint as llr_micros from b join weights using (b) group by r),
base as (select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  coalesce(dups.n, 0)::bigint as n_dup_lines, coalesce(repeats.n, 0)::bigint as n_repeat_words, coalesce(llr_micros, 0)::bigint as llr_micros
  from d left join words using (r) left join repeats using (r) left join dups using (r) left join scores using (r))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and llr_micros >= {quality.THRESHOLD} as kept
from base
"""


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    profiles = language_id.learn(docs.where(~held_out))
    said = language_id.predict(docs.select("doc_id", "text"), profiles)
    return said.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_filters.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def _duck_rule(host: str, path: str) -> str:
    fits = []
    for _, rule in sorted(url_filters.RULES, key=lambda r: (-len(r[1]), r[0] != "allow", r[1])):
        h, p = rule.split("/", 1)
        fits.append(f"when ({host} = '{h}' or {host} like '%.{h}') and starts_with({path}, '/{p}') then '{rule}'")
    return f"case {' '.join(fits)} end"


def _duck_action(rule: str) -> str:
    return f"case {rule} {' '.join(f"when '{r}' then '{a}'" for a, r in url_filters.RULES)} end"


def _duck_lower(x: str) -> str:
    return f"translate({x}, '{ASCII_UPPER}', '{ASCII_LOWER}')"


def _duck_node(url: str) -> str:
    host = _duck_lower(f"regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1)")
    return f"case when {host} <> '' then {host} || regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1) end"


OP8_SQL = rf"""
with recursive p as (select page_id, url, html, coalesce({_duck_lower("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, {_duck_node("url")} as node from pages),
ruled as (select *, {_duck_rule("host", "path")} as rule from p),
links as (select url, node as src, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) as link from p
  union all select url, node, regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), '(?i)\burl\s*=\s*["'']?([^"''\s>;]+)', 1) from p),
full_links as (select src, case when contains(link, '://') then link when starts_with(link, '//') then regexp_extract(url, '(?s)^(.*?:)//', 1) || link
  when starts_with(link, '/') then regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || link
  else regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || case when regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*/)', 1) = '' then '/' else regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*/)', 1) end || link end as u
  from (select url, src, replace(link, '&amp;', '&') as link from links where link <> '')),
edges as (select distinct src, {_duck_node("u")} as dst from full_links),
both_ways as (select src, dst from edges where src is not null and dst is not null and src <> dst union select dst, src from edges where src is not null and dst is not null and src <> dst),
reach as (select src, dst from both_ways union select r.src, b.dst from reach r join both_ways b on r.dst = b.src),
member as (select src as node, dst as other from reach union select src, src from reach),
said as (select node, min({_duck_action(_duck_rule("regexp_extract(other, '^([^/?]*)', 1)", "regexp_extract(other, '(?s)^[^/?]*([^?]*)', 1)"))}) as said from member group by node)
select page_id, host, path, rule, coalesce({_duck_action("rule")}, said, 'allow') as verdict from ruled left join said using (node)
"""


def op9_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


OP9_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as h from pages),
f as (select h, min(page_id) as first from p group by h),
b as (select p.*, first, unhex(h)::bit::varchar as bits from p join f using (h))
select page_id, n::bigint as payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::int + 8 * substr(bits, 5 * i + 2, 1)::int + 4 * substr(bits, 5 * i + 3, 1)::int + 2 * substr(bits, 5 * i + 4, 1)::int + substr(bits, 5 * i + 5, 1)::int, 1) for i in range(32)], 'string_agg', '') as payload_digest,
  case when page_id <> first then 'revisit' else 'response' end as record_type,
  case when page_id <> first then first end as refers_to
from b
"""


def op3_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = contamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP3_SQL = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_duck_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({_duck_lower("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null and text is not null),
windows as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as win from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from windows),
dw as (select r, n, i, array_to_string(w[i : i + n - 1], ' ') as win from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hits as (select r, i, n, item_id from dw join windows using (n, win)),
hit_words as (select r, count(distinct p) as n_hit from (select distinct r, unnest(range(i, i + n)) as p from hits) group by r),
items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, item_id::varchar as item from hits) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words using (r) left join items using (r)
"""


def op4_secret_scan(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.listed(F.col("base_spans")), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def _duck(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _duck_matches(kind: str, pattern: str, group: int) -> str:
    p = _duck(pattern)
    return f"""select r, '{kind}' as kind, {secret_scan.KINDS.index(kind)} as rank, unnest(range(1, len(m) + 1)) as i, m[i] as found, g[i] as part,
  coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)::bigint + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::bigint as start
  from (select r, regexp_extract_all(text, {p}, 0) as m, regexp_extract_all(text, {p}, {group}) as g, string_split_regex(text, {p}) as gaps from d where regexp_matches(text, {p}))"""


OP4_SQL = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
terms as (select {secret_scan.TERMS} as t),
base as (select * from ({_duck_matches("assign", secret_scan.ASSIGN, 2)}) where length(part) >= 12
  union all {_duck_matches("access", secret_scan.ACCESS, 0)} union all {_duck_matches("hex", secret_scan.HEX, 0)}),
candidates as (select *, 3000000 as least from ({_duck_matches(*secret_scan.CLASSES[0][:2], 0)}) where not regexp_matches(found, {_duck(secret_scan.ALLOW)})
  union all select *, 3800000 from ({_duck_matches(*secret_scan.CLASSES[1][:2], 0)}) where not regexp_matches(found, {_duck(secret_scan.ALLOW + "|" + secret_scan.ONLY_HEX)})),
windows as (select r, kind, rank, start, found, least, substr(found, unnest(range(1, length(found) - 18)), 20) as w from candidates),
chars as (select r, kind, rank, start, found, least, w, list_transform(range(1, 21), lambda i: w[i]) as c from windows),
sums as (select r, kind, rank, start, found, least, list_sum(list_transform(list_distinct(c), lambda x: t[len(list_filter(c, lambda y: y = x)) + 1])) as s from chars, terms),
entropy as (select r, kind, rank, start, found from sums group by r, kind, rank, start, found, least having {secret_scan.TERMS[20]} - min(s) >= 20 * least),
said as (select r, kind, rank, start, start + length(found) as stop from base union all select r, kind, rank, start, start + length(found) from entropy),
lists as (select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (rank < 3) as base, string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans from said group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join lists using (r)
"""


def op5_near_duplicates(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=85)


OP5_SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all({_duck_lower("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by x, y),
links as (select x, y from common join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
both_ways as (select x, y from links union select y, x from links),
reach as (select x, y from both_ways union select r.x, b.y from reach r join both_ways b on r.y = b.x),
least_of as (select x, min(y) as m from reach group by x)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id, d.doc_id <= coalesce(m, d.doc_id) as kept
from d left join n on n.doc_id = d.doc_id left join least_of on least_of.x = d.doc_id
"""


def op2_lm_scores(spark, sf_dir):
    return lm_score.lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_duck_lower("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
t as (select r, unnest(range(1, len(w) + 1)) as i, unnest(w) as w from d),
pairs as (select r, i, w, lag(w) over (partition by r order by i) as v from t),
c1 as (select w, count(*) as c, round(ln(count(*)) * 1e6)::bigint as l from t group by w),
c2 as (select v, w, count(*) as c, round(ln(count(*)) * 1e6)::bigint as l from pairs where v is not null group by v, w),
n as (select round(ln(count(*)) * 1e6)::bigint as l from t),
terms as (select r, case when c2.c >= {lm_score.MIN_COUNT} then c2.l - cv.l else c1.l - n.l + case when v is null then 0 else round(ln({lm_score.BACKOFF}) * 1e6)::bigint end end as s,
  v is not null and c2.c < {lm_score.MIN_COUNT} as backed from n, pairs join c1 using (w) left join c2 using (v, w) left join c1 cv on cv.w = pairs.v),
sums as (select r, sum(s)::bigint as s, count(*) filter (backed) as b from terms group by r)
select doc_id, len(w)::bigint as n_words, coalesce(b, 0)::bigint as n_backoff, coalesce(s, 0)::bigint as score_micros from d left join sums using (r)
"""


QUERIES = {"op1_token_counts": op1_token_counts, "op2_lm_scores": op2_lm_scores, "op3_decontamination": op3_decontamination, "op4_secret_scan": op4_secret_scan, "op5_near_duplicates": op5_near_duplicates, "op6_quality_rules": op6_quality_rules, "op7_language_id": op7_language_id, "op8_url_filters": op8_url_filters, "op9_warc": op9_warc, "op10_bpe_codec": op10_bpe_codec}
ORACLES: dict[str, str] = {"op2_lm_scores": OP2_SQL, "op3_decontamination": OP3_SQL, "op4_secret_scan": OP4_SQL, "op5_near_duplicates": OP5_SQL, "op6_quality_rules": OP6_SQL, "op8_url_filters": OP8_SQL, "op9_warc": OP9_SQL}
