"""SQL twins of the queries for DuckDB, written on their own terms."""

from __future__ import annotations

from mapwright.functions import constants as K

TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
SENT = r"list_filter([trim(x, ' ' || chr(9) || chr(10) || chr(13)) for x in string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))], lambda x: x <> '')"


def tok(c: str) -> str:
    return TOK.format(c)


def strip(c: str) -> str:
    return STRIP.format(c)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


BM25 = f"""
docs as (select doc_id, {tok('text')} as t from documents),
dl as (select doc_id, len(t) as dlen from docs),
stat as (select count(*) as n, avg(dlen) as avgdl from dl),
seen as (select term, count(*) as df from (select doc_id, unnest(list_distinct(t)) as term from docs) group by term),
idf as (select term, ln(n - df + 0.5) - ln(df + 0.5) as idf from seen, stat),
floor_ as (select avg(idf) * {K.BM25_EPSILON} as f from idf),
q as (select item_id, term, count(*) as qf from (select item_id, unnest({tok('text')}) as term from benchmark) group by all),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from docs) where term in (select term from q) group by all),
bm as (select item_id, doc_id, sum(qf * case when idf < 0 then f else idf end * tf * {K.BM25_K1 + 1} / (tf + {K.BM25_K1} * ({1 - K.BM25_B} + {K.BM25_B} * dlen / avgdl))) as score
       from tf join q using (term) join idf using (term) join dl using (doc_id), stat, floor_ group by all)"""


def bm25_top(k: int) -> str:
    return f"kw as (select item_id, doc_id, score, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) as rank from bm where score > 0 qualify rank <= {k})"


VEC = f"""
db as (select doc_id, ('0x' || substr(md5(term), 1, 8))::bigint % 256 as b, count(*) as c from (select doc_id, unnest(t) as term from docs) group by all),
ib as (select item_id, ('0x' || substr(md5(term), 1, 8))::bigint % 256 as b, sum(qf) as c from q group by all),
dn as (select doc_id, sqrt(sum(c * c)) as dn from db group by all), inn as (select item_id, sqrt(sum(c * c)) as n from ib group by all),
dots as (select item_id, doc_id, sum(db.c * ib.c) as dot from db join ib using (b) group by all),
cosines as (select i.item_id, d.doc_id, coalesce(dot / (dn.dn * inn.n), 0) as score from (select item_id from benchmark) i cross join (select doc_id from documents) d left join dots using (item_id, doc_id) left join dn using (doc_id) left join inn using (item_id))"""


def vec_top(k: int) -> str:
    return f"vt as (select item_id, doc_id, score, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) as rank from cosines qualify rank <= {k})"


def fused(k: int) -> str:
    return f"""with {BM25}, {bm25_top(2 * k)}, {VEC}, {vec_top(2 * k)},
both_ as (select coalesce(kw.item_id, vt.item_id) as item_id, coalesce(kw.doc_id, vt.doc_id) as doc_id, coalesce(1.0 / ({K.RRF_K} + kw.rank), 0) + coalesce(1.0 / ({K.RRF_K} + vt.rank), 0) as rrf
          from kw full join vt on kw.item_id = vt.item_id and kw.doc_id = vt.doc_id),
fused as (select item_id, doc_id, rrf, least(rrf / (2.0 / {K.RRF_K + 1}), 1.0) as score, row_number() over (partition by item_id order by round(rrf, 9) desc, doc_id) as rank from both_ qualify rank <= {k})"""


MAPPED = f"{fused(3)}, mapped as (select b.item_id, f.doc_id, f.score, f.rank from benchmark b left join (select * from fused where score >= {K.MIN_SCORE}) f using (item_id))"


def vectors(where: str) -> str:
    return f"""with pairs as (select a.vec_id as query_id, b.vec_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as c from embeddings a, embeddings b where a.vec_id % 20 = 0 and {where}),
r as (select *, row_number() over (partition by query_id order by round(c, 9) desc, vec_id) as rank from pairs qualify rank <= 5)
select query_id, vec_id, round(greatest(c, 0), 6) as score, rank from r"""


BLOCKS = """
lines as (select doc_id, unnest(range(len(l))) as pos, unnest(l) as text from (select doc_id, string_split(text, chr(10)) as l from documents)),
blocks as (select doc_id, pos, text, pos // 40 + 1 as page,
  50.0::double + case when doc_id % 3 = 0 and pos % 2 = 1 then 260.4 else 0 end + case when doc_id % 7 = 0 and pos % 5 = 4 then 410 else 0 end as x0,
  60.0::double + (pos % 40) * 16 + case when pos % 40 >= 6 then (doc_id % 4) * 40.0 else 0 end as y0,
  least(length(text) * 2, 240)::double as w from lines)"""

EDGES = "edges as (select distinct doc_id, page, round_even(x0, 0) as x from blocks), gaps as (select *, lag(x) over (partition by doc_id, page order by x) as before from edges)"

VOTES = """
votes as (select user_id, event_id, event_type, case length(event_type) % 3 when 0 then 'fully_compliant' when 1 then 'partially_compliant' else 'non_compliant' end as level, least(floor(abs(value) * 50) / 10000, 1.0) as confidence from events),
ord(level, o) as (values ('fully_compliant', 3), ('partially_compliant', 2), ('non_compliant', 1)),
per as (select user_id, level, count(*) as n_votes from votes group by all),
won as (select user_id, level, n_votes from per join ord using (level) qualify row_number() over (partition by user_id order by n_votes desc, o) = 1),
best as (select v.user_id, v.level, v.confidence, v.event_id, w.n_votes from votes v join won w using (user_id, level) qualify row_number() over (partition by v.user_id order by v.confidence desc, v.event_id) = 1)"""

SUBS = r"""
subs as (select user_id, event_id, '  Req ' || upper(event_type) || '   no' || (event_id % 3) || case when event_id % 2 = 0 then '.;' else ' ' end as requirement, case when event_id % 7 = 0 then null else confidence > 0.4 end as covered from votes),
norm as (select *, regexp_replace(regexp_replace(lower(regexp_replace(requirement, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'), '[.;,]+$', '') as k from subs),
merged as (select user_id, k, coalesce(bool_or(covered), false) as met, arg_min(requirement, event_id) as t, min(event_id) as p from norm where k <> '' group by all),
cov as (select user_id, count(*) as n_total, count_if(met) as n_covered, coalesce(string_agg(t, '; ' order by p) filter (met), '') as covered_texts, coalesce(string_agg(t, '; ' order by p) filter (not met), '') as missing_texts,
        case when count_if(met) = count(*) then 'fully_compliant' when count_if(met) > 0 then 'partially_compliant' else 'non_compliant' end as level from merged group by user_id)"""

ANSWERS = """
good as (select event_id, user_id, event_type, '{"type": "MappingRationale", "is_compliant": ' || case when event_id % 2 = 0 then 'true' else 'false' end || ', "compliance_level": "' || (['fully_compliant', 'partially_compliant', 'non_compliant', 'unknown'])[event_id % 4 + 1]
  || '", "confidence_score": ' || printf('%.2f', least(floor(abs(value) / 2) / 100, 1.0)) || ', "explanation": "' || event_type || '"'
  || case when event_id % 5 = 0 then ', "sub_requirements": [{"requirement": "a", "covered": true}, {"requirement": "b", "covered": ' || case when event_id % 3 = 0 then 'true' else 'false' end || '}]' else '' end || '}' as g,
  round(least(floor(abs(value) / 2) / 100, 1.0), 2) as conf from events),
kinds as (select event_id, user_id, event_type, g, conf, case when event_id % 11 in (0, 1, 2, 8, 9, 10) then 'good' when event_id % 11 = 3 then 'lack' when event_id % 11 = 6 then 'other' else 'bad' end as k,
  case when event_id % 5 = 0 then case when event_id % 3 = 0 then 'fully_compliant' else 'partially_compliant' end
       when event_id % 2 = 0 and event_id % 4 = 2 then 'fully_compliant'
       when event_id % 2 = 0 then 'fully_compliant'
       when event_id % 4 = 1 then 'partially_compliant' else 'non_compliant' end as lv0,
  case when event_id % 5 = 0 then true else event_id % 2 = 0 end as comp0 from good),
told as (select *, case when lv0 = 'fully_compliant' and conf < 0.7 then 'partially_compliant' else lv0 end as lv, case when lv0 = 'fully_compliant' and conf < 0.7 then true else comp0 end as comp from kinds),
verdicts as (select event_id, user_id, k,
  case when k = 'good' and conf > 0 then 'MappingRationale' when k in ('good', 'lack', 'other') then 'InsufficientEvidence' end as kind,
  case when k = 'good' and conf > 0 then comp end as is_compliant, case when k = 'good' and conf > 0 then lv end as compliance_level,
  case when k = 'good' and conf > 0 then conf end as confidence_score, case when k = 'good' and conf > 0 then event_type end as explanation,
  case when k = 'good' and conf = 0 then event_type when k = 'lack' then 'none' when k = 'other' then 'Invalid LLM output: unknown response type.' end as reason,
  case when k = 'good' and conf = 0 then 'Policy text directly addressing the control.' when k = 'lack' then 'more' when k = 'other' then 'Response must be MappingRationale or InsufficientEvidence.' end as required_context from told)"""

FURNITURE = "regexp_matches(t, '^(?i:Page\\s+\\d+|Version\\s+[\\d.]+|Classification:\\s+|CONFIDENTIAL$|This document is the property|Unauthorized\\s+distribut|Effective:\\s+)')"
HEAD = "regexp_matches(t, '^(?i:(?:(?:Section|Chapter|Part)\\s+\\d+|APPENDIX\\s+[A-Z]|\\d+(?:\\.\\d+)*)(?:\\s*[:\\-—]\\s*|\\s{2,})\\S)')"

UID = "regexp_replace(left(sha256({0}), 32), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"

REPORTED = f"""{ANSWERS},
firsts as (select * from verdicts qualify row_number() over (partition by user_id order by event_id) = 1),
seen as (select user_id, event_id from verdicts),
chunked as (select user_id, event_id, 'Event' || chr(10) || event_id || ' ' || repeat('word ', event_id % 60) as raw_text from seen where user_id % 4 <> 0)"""

GOLDEN = f"""{BM25}, {bm25_top(5)},
grams as (select distinct doc_id, array_to_string(list_slice(t, i, i + 7), ' ') as gram from (select doc_id, t, unnest(range(1, len(t) - 6)) as i from docs where len(t) >= 8)),
expd as (select item_id, doc_id from (select item_id, array_to_string(list_slice({tok('text')}, 1, 8), ' ') as gram from benchmark) join grams using (gram)),
scores as (select e.item_id, count(*) as n_exp, count(kw.doc_id) as hits, any_value(r.n) as n_ret from expd e left join kw on kw.item_id = e.item_id and kw.doc_id = e.doc_id left join (select item_id, count(*) as n from kw group by 1) r on r.item_id = e.item_id group by e.item_id)"""


def golden(metric: str, expr: str, threshold: float) -> str:
    return f"with {GOLDEN} select '{metric}' as metric, round(coalesce(avg({expr}), 0), 6) as score, count(*) as n_queries, coalesce(avg({expr}), 0) >= {threshold} as passed from scores"


EXPANSIONS = ", ".join(f"({i}, {quoted(k)}, {quoted(v)})" for i, (k, v) in enumerate(K.EXPANSIONS))

COVER = f"{MAPPED}, cov as (select d.doc_id, d.source, count(m.item_id) as n from documents d left join mapped m using (doc_id) group by all)"

SQL: dict[str, str] = {
    "tokenize_counts": f"select doc_id, len(t) as n_tokens, len(list_distinct(t)) as n_distinct from (select doc_id, {tok('text')} as t from documents)",
    "sentence_split": f"select doc_id, unnest(range(len(s)))::int as pos, unnest(s) as sentence from (select doc_id, {SENT.format('text')} as s from documents)",
    "bm25_topk": f"with {BM25}, {bm25_top(5)} select item_id, doc_id, round(score, 6) as score, rank from kw",
    "vector_topk": vectors("true"),
    "vector_topk_filtered": vectors("b.label = 3"),
    "rrf_fusion": f"{fused(5)} select item_id, doc_id, round(rrf, 6) as rrf, round(score, 6) as score, rank from fused",
    "map_controls": f"{MAPPED} select item_id, doc_id, round(score, 6) as score, rank from mapped",
    "query_expansion": f"""with every as (select item_id, text from benchmark union all values (-1, 'Protect Information at Rest and audit events'), (-2, 'physical access control for visitors'), (-3, 'nothing to add'), (-4, 'Shared user IDs are revoked; flow enforcement is documented')),
q as (select item_id, case when item_id % 2 = 0 then '[Access] ' else '' end || text as q from every), x(o, k, v) as (values {EXPANSIONS}),
a as (select item_id, string_agg(v, '; ' order by o) as v from q join x on contains(lower(q), k) group by all)
select item_id, case when v is null then q else q || ' [' || v || ']' end as query from q left join a using (item_id)""",
    "vote_best_rationale": f"with {VOTES} select user_id, level, case when level = 'fully_compliant' and confidence < 0.7 then 'partially_compliant' else level end as final_level, round(confidence, 4) as confidence, event_id, n_votes from best",
    "subrequirement_coverage": f"with {VOTES}, {SUBS} select * from cov",
    "aggregate_verdicts": f"""with {VOTES}, {SUBS}, f as (select b.user_id, b.level as old, b.confidence, c.level as computed, case when coalesce(c.level, '') = 'fully_compliant' and b.confidence < 0.7 then 'partially_compliant' else coalesce(c.level, b.level) end as level from best b left join cov c using (user_id))
select user_id, level, level <> 'non_compliant' as is_compliant, round(confidence, 4) as confidence, coalesce(computed <> old, false) as changed from f""",
    "sibling_resolution": f"""with {VOTES}, r as (select case when user_id % 3 = 0 then 'AC-' || (user_id % 100) else (user_id % 10) || '.' || user_id end as control_id, user_id % 5 = 0 as is_meta, case when user_id % 13 <> 0 then level end as level, floor(confidence * 200) / 200 as confidence, user_id as pos from best),
f as (select *, case when contains(control_id, '.') then split_part(control_id, '.', 1) when contains(control_id, '-') then split_part(control_id, '-', 1) else control_id end as family from r),
p as (select family, count(*) as n, count_if(level = 'fully_compliant') as nf, count_if(level = 'non_compliant') as nn, list_reduce(list_prepend(0.0::double, list(confidence order by pos)), lambda a, b: a + b) / count(*) as mean, string_agg(control_id, ', ' order by pos) filter (level = 'non_compliant') as ni, string_agg(control_id, ', ' order by pos) filter (level = 'partially_compliant') as pi from f where not is_meta and level is not null group by family),
j as (select f.*, p.* exclude (family), is_meta and n is not null as takes, 100 * (least(mean, 1.0)::double * 1152921504606846976::double)::hugeint as x from f left join p using (family))
select pos, control_id, family, case when not takes then level when nn = n then 'non_compliant' when nf = n then 'fully_compliant' else 'partially_compliant' end as resolved_level,
case when not takes then confidence when nn = n then 0.9 else ((x // 1152921504606846976::hugeint) + case when 2 * (x % 1152921504606846976::hugeint) > 1152921504606846976::hugeint or (2 * (x % 1152921504606846976::hugeint) = 1152921504606846976::hugeint and (x // 1152921504606846976::hugeint) % 2 = 1) then 1 else 0 end)::double / 100 end as resolved_confidence,
case when not takes then null when nn = n then 'Inferred from sibling controls: all ' || n || ' evaluated controls in Requirement ' || family || ' are non-compliant (' || ni || '). This governance requirement cannot be met.'
when nf = n then 'Inferred from sibling controls: all ' || n || ' evaluated controls in Requirement ' || family || ' are compliant. Aggregated confidence from sibling assessments.'
else 'Inferred from sibling controls: ' || nf || ' of ' || n || ' evaluated controls in Requirement ' || family || ' are fully compliant. Gaps remain in ' || concat_ws(', ', ni, pi) || '.' end as explanation from j""",
    "meta_heuristic": r"""select item_id, regexp_matches(text, '(?is)all\s+security\s+policies\s+and\s+operational\s+procedures.*(?:documented|kept\s+up\s+to\s+date|in\s+use|known\s+to\s+all)') or regexp_matches(text, '(?i)roles\s+and\s+responsibilities\s+for\s+performing\s+activities\s+in\s+requirement') as is_meta
from (select item_id, text from benchmark union all values (-1, 'All security policies and operational procedures for Requirement 3 are:' || chr(10) || 'Documented.'), (-2, 'ROLES AND  RESPONSIBILITIES for performing activities in Requirement 8 are known'), (-3, 'all security policies exist'))""",
    "parse_verdicts": f"with {ANSWERS} select event_id, kind, is_compliant, compliance_level, confidence_score, explanation, reason, required_context from verdicts",
    "batch_sub_requirements": """with n as (select *, row_number() over (partition by user_id order by event_id) - 1 as pos, count(*) over (partition by user_id) as total from events)
select user_id, pos::int as pos, event_type as requirement, event_id % 5 <> 0 and event_id % 2 = 0 as covered from n where event_id % 6 >= 3 and user_id % 9 <> 4 and pos < total - user_id % 3""",
    "parse_batch_verdicts": f"""with {ANSWERS}, items as (select *, row_number() over (partition by user_id order by event_id) - 1 as pos, event_id % 11 in (0, 8, 9, 10, 3, 4, 6) as object from verdicts),
n as (select user_id, count(*) + user_id % 3 - 1 as n from items group by user_id), want as (select user_id, unnest(range(n)) as pos from n)
select w.user_id, w.pos::int as pos, coalesce(case when i.object then i.kind end, 'InsufficientEvidence') as kind, case when i.object then i.compliance_level end as compliance_level, case when i.object then i.confidence_score end as confidence_score,
case when i.pos is null then 'Missing batch element in LLM response.' when not i.object then 'Invalid batch element: not a JSON object.' when i.kind is null then 'Failed to parse batch element.' else i.reason end as reason
from want w left join items i using (user_id, pos)""",
    "batch_meta_flags": "with e as (select user_id, min(event_id) as e from events group by all), p as (select user_id, e, unnest(range(4))::int as pos from e) select user_id, pos, e % 7 <> 0 and (pos = 0 or (pos = e % 5 and e % 2 = 0)) as is_meta from p",
    "dedup_chunks": "select doc_id, source, lang from documents qualify row_number() over (partition by source, left(text, 100) order by doc_id) = 1",
    "prefilter_chunks": f"select conv_id, turn from conversations where length({strip('text')}) >= 200",
    "harmonize_clusters": """with recursive e as (select a.vec_id as a, b.vec_id as b from embeddings a, embeddings b where a.vec_id <> b.vec_id and round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) >= 0.40),
r as (select vec_id as v, vec_id as c from embeddings union select e.b, r.c from r join e on e.a = r.v) select v as vec_id, min(c) as cluster from r group by v""",
    "harmonize_controls": """with recursive e as (select a.vec_id as a, b.vec_id as b from embeddings a, embeddings b where a.vec_id <> b.vec_id and round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) >= 0.40),
r as (select vec_id as v, vec_id as c from embeddings union select e.b, r.c from r join e on e.a = r.v), k as (select v as vec_id, min(c) as cluster from r group by v),
t as (select vec_id, cluster, 'About ' || repeat('x', vec_id % 4) || label as description from k join embeddings using (vec_id)),
u as (select cluster, string_agg(description, ' | ' order by length(description) desc, description) as unified_description from (select distinct cluster, description from t) group by cluster)
select 'Title ' || min(vec_id) as theme, any_value(unified_description) as unified_description, string_agg('C-' || vec_id, ',' order by vec_id) as refs, cluster from t join u using (cluster) group by cluster""",
    "detect_layout": f"""with {BLOCKS}, {EDGES}, k as (select doc_id, page, 1 + coalesce(count_if(x - before >= 100), 0) as clusters from gaps group by all), a as (select doc_id, page, avg((x0 + w) - x0) as width from blocks group by all)
select doc_id, page, case when clusters = 1 then 'single_column' when clusters > 2 then 'table' when width < 150 then 'table' else 'dual_column' end as layout from k join a using (doc_id, page)""",
    "classify_margins": f"with {BLOCKS} select doc_id, pos, case when y0 < 70 then 'header' when y0 > 772 then 'footer' else 'body' end as role from blocks",
    "classify_blocks": f"""with {BLOCKS}, a as (select *, regexp_replace(lower({strip('text')}), '[0-9]+', '#', 'g') as sig, round_even(y0 / 20, 0) as yb, (min(y0) over p + max(y0) over p) / 2 as mid from blocks window p as (partition by doc_id, page)),
g as (select doc_id, sig, yb, count(distinct page) as pages, arg_min(case when y0 < mid then 'header' else 'footer' end, pos) as rr from a group by all),
b as (select a.doc_id, a.page, a.pos, a.y0, case when pages >= 2 then rr else 'body' end as r1 from a join g using (doc_id, sig, yb)),
c as (select *, row_number() over o - 1 as i, count(*) over p as n, y0 - lag(y0) over o as up, lead(y0) over o - y0 as down, count_if(r1 = 'body') over p as nb from b window p as (partition by doc_id, page), o as (partition by doc_id, page order by y0, pos)),
sp as (select doc_id, page, list_sort(list(s)) as s from (select doc_id, page, y0 - lag(y0) over (partition by doc_id, page order by y0, pos) as s from b where r1 = 'body') where s is not null group by all),
d as (select c.*, nb >= 2 as able, greatest(4 * s[len(s) // 2 + 1], 50) as gap from c left join sp using (doc_id, page)),
e as (select *, max(case when able and r1 = 'body' and i > 0 and up >= gap then i end) over (partition by doc_id, page) as foot from d),
f as (select *, case when r1 = 'body' and n - foot < foot and i >= foot then 'footer' else r1 end as r2 from e),
h as (select *, min(case when able and r2 = 'body' and i < n - 1 and down >= gap then i end) over (partition by doc_id, page) as head from f)
select doc_id, pos, case when r2 = 'body' and head + 1 < n - head - 1 and i <= head then 'header' else r2 end as role from h""",
    "order_columns": f"""with {BLOCKS}, {EDGES}, s as (select doc_id, page, arg_min((before + x) / 2, x) as sx from gaps where x - before >= 100 group by all)
select doc_id, pos, row_number() over (partition by doc_id order by page, coalesce((x0 >= sx)::int, 0), y0, pos) as place from blocks left join s using (doc_id, page)""",
    "page_text": f"with {BLOCKS} select doc_id, page, md5(string_agg(text, chr(10) order by pos)) as text_md5 from blocks group by doc_id, page having trim(string_agg(text, chr(10) order by pos)) <> ''",
    "boilerplate_repeats": f"""with {BLOCKS}, t as (select doc_id, pos, {strip('text')} as t from blocks)
select doc_id, pos from (select *, count(*) over (partition by doc_id, t) as n from t) where n < 2 and t <> '' and not {FURNITURE}""",
    "structural_sections": f"""with {BLOCKS}, p as (select doc_id, pos, page, case when pos % 6 = 2 then 'Section ' || pos || ': Title' when pos % 11 = 7 then (pos % 9) || '.1  Purpose' else {strip('text')} end as t, pos % 6 = 2 or pos % 11 = 7 as planted from blocks),
k as (select *, planted or {HEAD} as h from p where t <> ''),
n as (select *, sum(h::int) over (partition by doc_id order by pos) as section_no from k),
s as (select doc_id, section_no, any_value(t) filter (h) as header, arg_min(page, pos) as page, flatten(list({SENT.format('t')} order by pos) filter (not h)) as s from n group by all)
select doc_id, section_no, header, page, len(s) as n_sentences, md5(array_to_string(s, '|')) as sentences_md5 from s where len(s) > 0""",
    "semantic_breaks": """with l as (select label, vec_id, embedding::double[] as e, lag(embedding::double[]) over (partition by label order by vec_id) as p from embeddings),
b as (select label, vec_id, sum(case when p is null or list_cosine_similarity(p, e) >= 0.1 then 0 else 1 end) over (partition by label order by vec_id) as pos from l)
select label, pos::int as pos, string_agg(vec_id::varchar, ' ' order by vec_id) as ids from b group by all""",
    "merge_short": f"""with {BLOCKS}, t as (select doc_id, pos, {strip('text')} as t from blocks), f as (select *, row_number() over (partition by doc_id order by pos) as i from t where t <> ''),
g as (select *, sum((i = 1 or length(t) >= 50)::int) over (partition by doc_id order by pos) as g from f), m as (select doc_id, g, string_agg(t, ' ' order by pos) as t from g group by all),
x as (select doc_id, case when g = 2 and first_short then 1 else g end as g2, g, t from (select *, length(max(case when g = 1 then t end) over (partition by doc_id)) < 50 as first_short from m)),
y as (select doc_id, g2, string_agg(t, ' ' order by g) as t from x group by all)
select doc_id, (row_number() over (partition by doc_id order by g2) - 1)::int as pos, md5(t) as text_md5 from y""",
    "fixed_chunks": f"""with {BLOCKS}, w as (select doc_id, string_agg(text, ' ' order by pos) as t, arg_min(page, pos) as page from blocks group by doc_id),
c as (select doc_id, page, unnest(range((length(t) - 1) // 500 + 1)) as i, t from w where length(t) > 0), x as (select doc_id, i::int as ordinal, page, {strip('substr(t, (i * 500 + 1)::bigint, 500)')} as raw_text from c)
select * from x where length(raw_text) >= 10""",
    "chunk_fragments": f"""with {BLOCKS}, l as (select doc_id, pos::int as pos, case when pos % 9 = 3 then 'Approved by the Chief Security Officer' when pos % 9 = 5 then '(' || text else text end as t from blocks)
select doc_id, pos, (contains(lower(t), 'approved by the') and (contains(lower(t), 'security officer') or contains(lower(t), 'ciso') or contains(lower(t), 'executive management')))
or (length(t) < 120 and (regexp_matches(t, '^\\p{{Ll}}') or t[1] = '(' or (contains(lower(t), 'prohibited') and (contains(lower(t), 'reproduction') or contains(lower(t), 'disclosure'))) or contains(lower(t), 'effective as of the date'))) as is_fragment,
regexp_replace(lower({strip('t')}), '[0-9]+', '#', 'g') as comparable from l""",
    "retrieval_precision": golden("precision", "case when n_ret > 0 then hits / n_ret else 0 end", 0.1),
    "retrieval_recall": golden("recall", "hits / n_exp", 0.9),
    "hit_rate": golden("hit", "(hits > 0)::int", 0.9),
    "binary_metrics": """with n as (select count_if(quality = 1 and toxic = 1) as tp, count_if(quality = 1 and toxic = 0) as fp, count_if(quality = 0 and toxic = 1) as fn, count_if(quality = toxic) as ok, count(*) as n from labels),
r as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as r from n)
select tp, fp, fn, round(p, 4) as precision, round(r, 4) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) as f1, round(coalesce(ok / nullif(n, 0), 0), 4) as accuracy from r""",
    "multiclass_accuracy": "select round(coalesce(avg((quality = toxic)::int), 0), 6) as accuracy, count(*) as n from labels",
    "faithfulness": r"""with p as (select a.conv_id, a.turn, list_distinct(list_filter(regexp_extract_all(lower(a.text), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 4)) as w, list_filter(regexp_extract_all(lower(b.text), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 4) || ['policy', 'control'] as s from conversations a join conversations b on a.conv_id = b.conv_id and a.turn = b.turn + 1)
select conv_id, turn, round(case when len(w) > 0 then len(list_filter(w, lambda x: list_contains(s, x))) / len(w) else 0 end, 6) as faithfulness from p""",
    "gap_stats": f"with {VOTES}, l as (select case when user_id % 13 <> 0 then level end as level from best) select count(*) as total, count_if(level = 'fully_compliant') as fully, count_if(level = 'partially_compliant') as partially, count(*) - count_if(level = 'fully_compliant') - count_if(level = 'partially_compliant') as non from l",
    "coverage_stats": f"{COVER} select count(distinct source) as documents, count(*) as chunks, count_if(n > 0) as mapped, count_if(n = 0) as unmapped from cov",
    "coverage_by_document": f"{COVER}, c as (select d.source, string_agg(distinct m.item_id, ',' order by m.item_id) as controls from mapped m join documents d using (doc_id) group by all) select source, count(*) as chunks, count_if(n > 0) as mapped, count_if(n = 0) as unmapped, coalesce(any_value(controls), '') as controls from cov left join c using (source) group by source",
    "unmapped_chunks": f"{COVER} select doc_id, source from cov where n = 0",
    "csv_rows": f"""with {REPORTED} select c.user_id::varchar as control_id, 'F' as framework, 'User ' || c.user_id as title, 'e' || c.event_id as chunk_id, raw_text,
case when kind = 'MappingRationale' then case when is_compliant then 'True' else 'False' end else '' end as is_compliant, case when kind = 'MappingRationale' then compliance_level else '' end as compliance_level,
case when kind = 'MappingRationale' then confidence_score::double::varchar else '' end as confidence_score, case when kind = 'MappingRationale' then explanation when kind = 'InsufficientEvidence' then 'InsufficientEvidence: ' || reason else '' end as rationale from chunked c join firsts f using (user_id)""",
    "verdict_labels": f"""with {REPORTED} select user_id::varchar as control_id, case when compliance_level = 'fully_compliant' then 'Compliant' when compliance_level = 'partially_compliant' then 'Partially Compliant' else 'Non-Compliant' end as report,
case when kind = 'MappingRationale' then case compliance_level when 'fully_compliant' then '✅ Compliant' when 'partially_compliant' then '\U0001f7e1 Partially compliant' else '⚠️ Non-compliant' end || printf(' (%.2f)', confidence_score) when kind = 'InsufficientEvidence' then 'Insufficient evidence' else 'N/A' end as markdown,
case when compliance_level = 'fully_compliant' then 'satisfied' when compliance_level = 'partially_compliant' then 'alternative' else 'not-satisfied' end as state from firsts""",
    "truncate_text": f"""with l as (select doc_id, {strip("replace(text, chr(10), ' ')")} as l, text from documents), c as (select *, left(text, 1200) as c from l),
d as (select *, case when contains(c, '. ') then 1200 - instr(reverse(c), ' .') - 1 when c[-1] = '.' then 1199 else -1 end as place from c)
select doc_id, case when length(l) > 150 then left(l, 147) || '...' else l end as short, md5(case when length(text) <= 1200 then text when place >= 600 then left(c, place + 1) else c || chr(10) || '[...truncated]' end) as cut_md5 from d""",
    "prompt_text": f"""with t as (select conv_id, list(text order by turn, text) as t from conversations group by conv_id), f as (select conv_id, t, {strip("replace(t[1], chr(10), ' ')")} as l from t)
select conv_id, md5(array_to_string([('### Chunk ' || (i - 1) || chr(10) || x) for x, i in t], chr(10))) as listing_md5, conv_id || ': Title. ' || case when length(l) > 150 then left(l, 147) || '...' else l end as prompt from f""",
    "oscal_flatten": """with c(place, control_id, title, description, requirement_family) as (values ('000000.000000', 'AC-1', 'Policy', 'Write it down.', 'Access Control'), ('000000.000000.000000', 'ac-1.1', 'Deeper', '', 'Access Control'), ('000000.000000.000000.000000', 'UNKNOWN', 'Deepest', '', 'Access Control'), ('000000.000001', 'ac-2', 'Accounts', '', 'Access Control'), ('000001.000000', 'au-2', 'Events', 'Log.', 'Audit'))
select n_nationkey, place, control_id, case when n_nationkey % 2 = 0 then 'NIST-800-53' else 'PCI-DSS' end as framework, title, description, requirement_family from nation, c""",
    "upsert_chunks": "select doc_id, source, length(text) + (doc_id % 2 = 0 or doc_id % 3 = 0)::int as n, case when doc_id % 2 = 0 or doc_id % 3 = 0 then 2 else 1 end as batch from documents",
    "store_round_trip": "select vec_id::varchar as chunk_id, label + case when vec_id % 4 = 0 and (vec_id % 2 = 0 or vec_id % 3 = 0) then 200 when vec_id % 2 = 0 or vec_id % 3 = 0 then 100 else 0 end as label, vec_id + case when vec_id % 4 = 0 then 1000000 else 0 end as extraction_order from embeddings",
    "cache_lookup": "with k as (select conv_id, turn, sha256('m::' || text) as key, text from conversations), c as (select key, any_value('r' || length(text)) as response from k where turn = 0 group by key) select conv_id, turn, key, response, response is not null as hit from k left join c using (key)",
    "embedding_queries": f"""with b as (select item_id, case when item_id % 3 = 0 then '[Physical access] ' else '' end || text as q from benchmark), x(i, k, v) as (values {EXPANSIONS}),
w as (select item_id, q, string_agg(v, '; ' order by i) as more from b left join x on contains(lower(q), k) group by all)
select item_id, q || coalesce(' [' || more || ']', '') as keyword_query, {quoted(K.QUERY_PREFIX)} || q || coalesce(' [' || more || ']', '') as vector_query from w""",
    "trailing_words": f"""with {BLOCKS}, l as (select doc_id, pos::int as pos, case when pos % 4 = 0 then text || ' and the.' when pos % 4 = 1 then text || ' THEREOF' else text end as t from blocks),
w as (select doc_id, pos, regexp_replace({strip('t')}, '[.!?]+$', '') as b from l)
select doc_id, pos, b <> '' and list_contains([{", ".join(quoted(w) for w in K.TRAILING_WORDS)}], lower(regexp_extract(b, '(\\S+)\\s*$', 1))) as open from w""",
    "chunk_files": "select case when doc_id % 5 = 4 then 'not JSON' when doc_id % 5 = 1 or length(text) < 50 then 'text under 50 characters' when doc_id % 5 = 2 then 'page under 1' when doc_id % 5 = 3 then 'no identifier or document' else 'none' end as problem, count(*) as n from documents group by 1",
    "golden_files": "select (row_number() over (order by item_id) - 1)::int as ordinal, md5(text) as query_md5, item_id::varchar as expected from benchmark",
    "all_chunks": "select vec_id::varchar as chunk_id, label, row_number() over (order by vec_id desc)::int as place from embeddings",
    "read_flags": "select event_id, event_id % 7 in (0, 2, 4, 6) as relevant, event_id % 7 in (0, 2) as is_meta from events",
    "evaluation_handoff": f"""with {BM25}, {bm25_top(3)}, c as (select item_id, string_agg(text, '|' order by rank) as t, count(*) as n from kw join documents using (doc_id) group by item_id)
select item_id, md5(coalesce(t, '')) as contexts_md5, coalesce(n, 0) as n, true as same from benchmark left join c using (item_id)""",
    "heal_sentences": f"""with recursive s as (select doc_id, [{strip("regexp_replace(x, '[.]$', '')")} for x in string_split(text, chr(10))] as ls from documents),
k as (select doc_id, list_filter(ls, lambda x: x <> '') as ls from s), l as (select doc_id, unnest(range(len(ls))) as i, unnest(ls) as t from k),
r as (select doc_id, i, 0 as pos, t as text from l where i = 0
union all select doc_id, i, case when j then pos else pos + 1 end, case when j then text || ' ' || t else t end from (
select r.doc_id, l.i, r.pos, r.text, l.t, not regexp_matches(r.text, '[.!?]$') and length({strip("regexp_replace(r.text, '(?s)^.*[.!?]', '')")}) < 80
and (regexp_matches(l.t, '^[\\p{{Ll}}\\p{{Nd}}]') or coalesce(list_contains([{", ".join(quoted(w) for w in K.TRAILING_WORDS)}], lower(regexp_extract(regexp_replace(r.text, '[.!?]+$', ''), '(\\S+)\\s*$', 1))), false)) as j
from r join l on l.doc_id = r.doc_id and l.i = r.i + 1))
select doc_id, pos::int as pos, arg_max(text, i) as text from r group by all""",
    "llm_extracted_controls": f"""with d as (select doc_id, string_split(text, chr(10))[2] as line, trim(regexp_replace(text, '\\s+', ' ', 'g')) as seg from documents),
t as (select doc_id, seg, {strip('line')} as raw_text from d where line <> ''),
n as (select *, instr(seg, trim(regexp_replace(raw_text[1:60], '\\s+', ' ', 'g'))) as spot from t where length(raw_text) >= 50)
select doc_id, '2.1' as section, raw_text, (case when spot > 0 then spot - 1 else length(seg) end)::int as place from n""",
    "page_segments": f"""with m as (select doc_id, regexp_replace(text, '\\n([A-ZÉÀ])', chr(10) || '3.1  \\1', 'g') as c from documents),
p as (select doc_id, c, string_split(ltrim(regexp_replace(c, '(?m)^([0-9]+(?:[.][0-9]+)*\\s{{2,}}\\S)', chr(1) || '\\1', 'g'), chr(1)), chr(1)) as ls from m where c is not null),
s as (select doc_id, case when length(c) <= 1500 or len(ls) <= 1 then [c] else list_filter([{strip('x')} for x in ls], lambda x: x <> '') end as ls from p)
select doc_id, unnest(range(len(ls)))::int as pos, md5(unnest(ls)) as segment_md5 from s""",
    "markdown_report": f"""with {REPORTED}, x as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as i, {strip("replace(raw_text, chr(10), ' ')")} as l from chunked),
t as (select user_id, '**Supporting Evidence:**' || chr(10) || chr(10) || '| # | Source | Page | Section | Excerpt |' || chr(10) || '|---|--------|------|---------|---------|' || chr(10)
|| string_agg('| ' || i || ' | events | 1 | — | ' || case when length(l) > 120 then left(l, 117) || '...' else l end || ' |' || chr(10), '' order by i) || chr(10) as rows from x group by user_id),
v as (select user_id, case when kind = 'MappingRationale' then case compliance_level when 'fully_compliant' then '✅ Compliant' when 'partially_compliant' then '\U0001f7e1 Partially compliant' else '⚠️ Non-compliant' end || printf(' (%.2f)', confidence_score) when kind = 'InsufficientEvidence' then 'Insufficient evidence' else 'N/A' end as verdict,
coalesce(case kind when 'MappingRationale' then explanation when 'InsufficientEvidence' then reason end, '') as why from firsts)
select user_id::varchar as control_id, '## ' || user_id || ' — User ' || user_id || chr(10) || chr(10) || '**Framework:** F | **Verdict:** ' || verdict || chr(10) || chr(10) || case when why <> '' then '**Rationale:** ' || why || chr(10) || chr(10) else '' end || coalesce(rows, '') || '---' || chr(10) as section
from v left join t using (user_id)""",
    "oscal_findings": f"""with {REPORTED}, h as (select user_id, event_id, raw_text, {UID.format("'observation|F|' || user_id || '|e' || event_id")} as seen, {UID.format("'subject|e' || event_id")} as subject from chunked),
o as (select user_id, string_agg('{{"observation-uuid":"' || seen || '"}}', ',' order by event_id) as related,
string_agg('{{"uuid":"' || seen || '","description":' || to_json(raw_text)::varchar || ',"methods":["EXAMINE"],"subjects":[{{"subject-uuid":"' || subject || '","type":"component","title":"events","props":[{{"name":"chunk-id","value":"e' || event_id || '"}},{{"name":"page-number","value":"1"}}]}}]}}', ',' order by event_id) as observations from h group by user_id),
f as (select *, {UID.format("'finding|F|' || user_id")} as uid, case compliance_level when 'fully_compliant' then 'satisfied' when 'partially_compliant' then 'alternative' else 'not-satisfied' end as state,
case kind when 'MappingRationale' then 'Compliant: ' || case when is_compliant then 'True' else 'False' end || ', Confidence: ' || confidence_score::double::varchar || ', Explanation: ' || explanation when 'InsufficientEvidence' then 'Insufficient evidence: ' || reason || '. Required: ' || required_context end as remark from firsts)
select user_id::varchar as control_id, '{{"uuid":"' || uid || '","title":"' || user_id || ': User ' || user_id || '","description":"About a user.","target":{{"type":"objective-id","target-id":"' || user_id || '","status":{{"state":"' || state || '"}}}},"related-observations":[' || coalesce(related, '') || ']' || coalesce(',"remarks":' || to_json(remark)::varchar, '') || '}}' as finding,
'[' || coalesce(observations, '') || ']' as observations from f left join o using (user_id)""",
    "join_paragraphs": f"""with recursive {BLOCKS}, s as (select doc_id, pos, page::int as page, x0, y0, x0 + w as x1, y0 + 12 as y1, {strip('text')} as t from blocks),
k as materialized (select *, {HEAD} as h, row_number() over (partition by doc_id order by pos) as i from (select *, count(*) over (partition by doc_id, t) as n from s) where n < 2 and t <> '' and not {FURNITURE}),
r as (select doc_id, i, 0 as paragraph, page, x0, y0, x1, y1, t from k where i = 1
union all select doc_id, i, case when j then paragraph else paragraph + 1 end, page, case when j then least(a0, x0) else x0 end, case when j then b0 else y0 end, case when j then greatest(a1, x1) else x1 end, y1, case when j then before || ' ' || t else t end from (
select k.*, r.paragraph, r.x0 as a0, r.y0 as b0, r.x1 as a1, r.t as before, r.page = k.page and abs(r.x0 - k.x0) < 5 and k.y0 >= r.y1 and k.y0 - r.y1 <= greatest((r.y1 - r.y0) * 1.5, 20) and not {HEAD.replace('(t,', '(r.t,')} and not k.h as j
from r join k on k.doc_id = r.doc_id and k.i = r.i + 1))
select doc_id, paragraph::int as paragraph, page, x0, y0, x1, y1, t as text from r qualify row_number() over (partition by doc_id, paragraph order by i desc) = 1""",
}
