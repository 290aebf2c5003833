"""The same rows in DuckDB's SQL, for every registered query that SQL can state."""

from __future__ import annotations

from ..functions.text import CAPTIONS, CHUNK_NAMESPACE, COSTS, STOPWORDS, THEME_KEYWORDS
from ..operators.answers import REFUSAL, UNCITED
from ..operators.evaluation import QUALITY

_STOP = "[" + ",".join(f"'{w}'" for w in STOPWORDS) + "]"
_SPACE = r"[\s\p{Z}\x{0085}\x0b\x1c-\x1f]"


def words(t: str) -> str:
    return f"regexp_extract_all(lower({t}),'[a-z0-9]+')"


def tokens(t: str) -> str:
    return f"list_filter({words(t)}, lambda w: not list_contains({_STOP}, w))"


def form(t: str) -> str:
    return f"trim(regexp_replace(lower({t}),'[^a-z0-9]+',' ','g'))"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def collapse(t: str) -> str:
    return strip(f"regexp_replace({t}, '{_SPACE}+', ' ', 'g')")


def sentences(t: str, marks: str = ".!?") -> str:
    parts = f"string_split(regexp_replace({t}, '([{marks}]){_SPACE}+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({parts}, lambda s: {strip('s')}), lambda s: s != '')"


def shared(a: str, b: str) -> str:
    return f"len(list_intersect(list_distinct({words(a)}), list_distinct({words(b)})))"


def coverage(a: str, b: str) -> str:
    return f"(case when len(list_distinct({words(a)})) = 0 then 0.0 else {shared(a, b)} / len(list_distinct({words(a)})) end)"


def letters(t: str) -> str:
    return f"len(regexp_extract_all({t}, '\\p{{L}}'))"


_CAPTION = " or ".join(f"starts_with(lower(s), '{c}')" for c in CAPTIONS)
NOISY = f"(contains(s,'arXiv:') or contains(s,'http') or length(s) not between 40 and 160 or {letters('s')} / greatest(length(s),1) < 0.55 or {_CAPTION})"


def hits(title: str, theme: str) -> str:
    return f"len(list_filter([{','.join(repr(k) for k in THEME_KEYWORDS[theme])}], lambda k: contains(lower({title}), k)))"


def best(title: str) -> str:
    """Score and name of the theme with most hits; the first name among equals."""
    return "list_max([" + ",".join(f"{{'score': {hits(title, t)}, 'o': {-k}, 'theme': '{t}'}}" for k, t in enumerate(sorted(THEME_KEYWORDS))) + "])"


BM25 = f"""post as (select id, term, count(*) tf from (select doc_id id, unnest({tokens("text")}) term from documents) group by all),
dl as (select doc_id id, len({tokens("text")}) dl from documents), stat as (select count(*) n, avg(dl) avgdl from dl),
raw as (select term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) raw from post, stat group by term, n),
idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end idf from raw),
qt as (select query_id, term, count(*) qtf from (select item_id query_id, unnest({tokens("text")}) term from benchmark) group by all),
bm as (select query_id, post.id doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score
  from qt join idf using (term) join post using (term) join dl on dl.id = post.id, stat group by 1, 2),
padded as (select * from bm where round(score, 9) > 0 union all select item_id, doc_id, 0.0 from benchmark, documents
  where not exists (select 1 from bm where bm.query_id = item_id and bm.doc_id = documents.doc_id)),
lex as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) rank from padded qualify rank <= 50)"""

HYBRID = BM25 + """,
den as (select q.vec_id query_id, v.vec_id doc_id, list_inner_product(q.embedding::double[], v.embedding::double[]) score
  from embeddings v, embeddings q where q.vec_id in (select item_id from benchmark) and v.vec_id in (select doc_id from documents)),
den50 as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) rank from den qualify rank <= 50),
fused as (select query_id, doc_id, d.score score_dense, s.score score_bm25, coalesce(1.0::double / (60 + d.rank), 0) + coalesce(1.0::double / (60 + s.rank), 0) rrf,
  concat_ws('+', case when d.rank is not null then 'dense' end, case when s.rank is not null then 'bm25' end) channels
  from den50 d full join lex s using (query_id, doc_id)),
hyb as (select *, row_number() over (partition by query_id order by round(rrf, 9) desc, doc_id) rank from fused qualify rank <= 20)"""

RERANK = HYBRID + f""",
pool as (select h.query_id, h.doc_id, h.rank hybrid_rank, d.text passage, b.text question, {coverage("b.text", "d.text")} + 0.01::double / (1 + len({words("d.text")})) score
  from hyb h join documents d using (doc_id) join benchmark b on b.item_id = h.query_id),
rer as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) final_rank from pool qualify final_rank <= 5)"""

CLAIMS = RERANK + f""",
sent as (select query_id, final_rank source, question, unnest({sentences("passage")}) s, generate_subscripts({sentences("passage")}, 1) pos from rer),
best as (select query_id, source, s text, row_number() over (partition by query_id, source order by {shared("s", "question")} desc, length(s), pos) k from sent where not {NOISY} qualify k = 1),
num as (select query_id, source own, text, row_number() over (partition by query_id order by source) claim from best),
claims as (select n.query_id, claim, n.text, list_sort(list_distinct(list(r.final_rank))) cites from num n join rer r on r.query_id = n.query_id
  and (r.final_rank = own or contains({collapse("r.passage")}, {collapse("n.text")})) where claim <= 5 group by all),
piece as (select query_id, claim, case when regexp_matches(text, '\\[[0-9]+\\]') then case when regexp_matches(text, '[.!?]$') then text else text || '.' end
  else regexp_replace(regexp_replace(text, '\\.+$', ''), '{_SPACE}+$', '') || ' ' || list_reduce(list_transform(cites, lambda c: '[' || c || ']'), lambda a, b: a || b) || '.' end sentence from claims),
ans as (select query_id, count(*) n_claims, string_agg(sentence, ' ' order by claim) answer from piece group by query_id)"""

VERIFIED = CLAIMS + f""",
seg0 as (select query_id, unnest({sentences("answer")}) raw, generate_subscripts({sentences("answer")}, 1) pos from ans),
seg as (select query_id, row_number() over (partition by query_id order by pos) - 1 segment, raw,
  regexp_replace({strip("regexp_replace(raw, '\\[[0-9]+\\]', '', 'g')")}, '^[:;,]+|[:;,]+$', '', 'g') claim_text,
  list_transform(regexp_extract_all(raw, '\\[([0-9]+)\\]', 1), lambda x: x::int) cites from seg0 where regexp_matches(raw, '\\[[0-9]+\\]')),
cited as (select query_id, segment, claim_text, unnest(cites) source from seg),
pairs as (select c.*, r.doc_id, r.question, r.passage, {sentences("r.passage")} sents from cited c join rer r on r.query_id = c.query_id and r.final_rank = c.source),
att as (select *, list_max(list_transform(sents, lambda s, i: {{'n': {shared("s", "claim_text")}, 'o': -i}})) top from pairs),
prem as (select *, case when coalesce(top.n, 0) <= 0 then passage else array_to_string(list_slice(sents, greatest(1, -top.o - 1), -top.o + 1), ' ') end premise from att),
cov as (select *, {coverage("claim_text", "premise")} c,
  (list_has_any({words("claim_text")}, ['not','no','never']) != list_has_any({words("premise")}, ['not','no','never'])) odd from prem),
nli as (select *, case when odd then (1 - c) * 0.1 else c * c end e, case when odd then c * c else (1 - c) * 0.1 end k from cov),
ver as (select *, round_even(least(1.0, e * e / (e + k + 1e-6)), 4) support,
  case when round_even(least(1.0, e * e / (e + k + 1e-6)), 4) >= 0.7 then 'Supported' when round_even(least(1.0, e * e / (e + k + 1e-6)), 4) >= 0.4 then 'Weak Support' else 'Unsupported' end verdict from nli)"""

FAITH = VERIFIED + """,
per as (select query_id, claim_text, max(support) best, count(*) n, count(*) filter (verdict = 'Supported') good from ver group by 1, 2),
faith as (select query_id, round(avg(best), 4) faithfulness, round(avg((best >= 0.4)::int::double), 4) claim_accuracy, round(sum(good) / sum(n), 4) pair_accuracy, sum(n)::bigint pairs from per group by 1)"""

RELEVANT = BM25 + """,
rel as (select item_id query_id, doc_id from benchmark b, documents d where contains(d.text, b.text)),
top as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) rank from bm qualify rank <= 10)"""

PAPERS = """papers as (select page_id pos, case when page_id % 11 = 0 then 'bad' else printf('%04d.%05dv%d', page_id % 7 + 2401, page_id // 3, page_id % 4 + 1) end id from pages)"""

INTERVALS = "iv as (select l_orderkey % 5000 document_id, l_partkey % 40 + 1 page_start, l_partkey % 40 + 1 + l_quantity::bigint % 5 page_end from lineitem)"

def premise(claim: str, passage: str) -> str:
    """The sentence of a passage that shares most words with a claim, the first among equals; the passage if none does."""
    top = f"list_max(list_transform({sentences(passage)}, lambda s, i: {{'n': {shared('s', claim)}, 'o': -i}}))"
    return f"case when coalesce({top}.n, 0) <= 0 then {passage} else {sentences(passage)}[-{top}.o] end"


def judged(source: str, claim: str, name: str) -> str:
    """Rows of ``source`` with the premise of ``passage``, the support that it gives ``claim``, and the contradiction."""
    odd = f"(list_has_any({words(claim)}, ['not','no','never']) != list_has_any({words('premise')}, ['not','no','never']))"
    return f"""{name}_p as (select *, {premise(claim, "passage")} premise from {source}),
{name}_c as (select *, {coverage(claim, "premise")} c, {odd} odd from {name}_p),
{name}_n as (select *, case when odd then (1 - c) * 0.1 else c * c end e, case when odd then c * c else (1 - c) * 0.1 end k from {name}_c),
{name} as (select *, round_even(least(1.0, e * e / (e + k + 1e-6)), 4) support from {name}_n)"""


def rendered(claims: str, name: str) -> str:
    """Answers from rows ``query_id, claim, text, cites``; queries without a claim have none."""
    sentence = f"""case when regexp_matches(text, '\\[[0-9]+\\]') then case when regexp_matches(text, '[.!?]$') then text else text || '.' end
  else regexp_replace(regexp_replace(text, '\\.+$', ''), '{_SPACE}+$', '') || ' ' || list_reduce(list_transform(list_sort(cites), lambda c: '[' || c || ']'), lambda a, b: a || b) || '.' end"""
    return f"""{name} as (select query_id, count(*) n_claims, case when count(*) between 1 and 5 then string_agg({sentence}, ' ' order by claim) else '{REFUSAL}' end answer from {claims} group by query_id)"""


def segmented(answers: str, name: str) -> str:
    """Sentences of answers with their marks, a row for each mark: ``query_id, segment, claim_text, source``."""
    return f"""{name}_s as (select query_id, unnest({sentences("answer")}) raw, generate_subscripts({sentences("answer")}, 1) pos from {answers}),
{name} as (select query_id, pos, regexp_replace({strip("regexp_replace(raw, '\\[[0-9]+\\]', '', 'g')")}, '^[:;,]+|[:;,]+$', '', 'g') claim_text, unnest(list_transform(regexp_extract_all(raw, '\\[([0-9]+)\\]', 1), lambda x: x::int)) source
  from {name}_s where regexp_matches(raw, '\\[[0-9]+\\]'))"""


def gated(claims: str, answers: str, prefix: str) -> str:
    """The gate's decisions over ``claims`` (query_id, claim, text, cites) and ``answers``, in a relation named by ``prefix``."""
    p = prefix
    return f"""{segmented(answers, f"{p}seg")},
{p}pair as (select s.query_id, s.claim_text, r.passage from {p}seg s join rer r on r.query_id = s.query_id and r.final_rank = s.source where length(r.passage) > 0),
{judged(f"{p}pair", "claim_text", f"{p}held")},
{p}state as (select a.query_id, a.answer, a.answer = '{REFUSAL}' refused, coalesce(max(support) >= 0.4, true) held from {answers} a left join {p}held h on h.query_id = a.query_id group by 1, 2),
{p}wide as (select c.query_id, c.claim, c.text claim_text, r.passage, {coverage("c.text", "r.passage")} cover, r.final_rank from {claims} c join {p}state s on s.query_id = c.query_id and not refused and not held join rer r on r.query_id = c.query_id
  qualify row_number() over (partition by c.query_id, c.claim order by {coverage("c.text", "r.passage")} desc, r.final_rank) = 1),
{judged(f"{p}wide", "claim_text", f"{p}cover")},
{p}rescued as (select query_id from {p}cover group by 1 having bool_and(cover >= 0.4 and k < 0.5)),
{p}rest as (select query_id from {p}state where not refused and not held and query_id not in (select query_id from {p}rescued)),
{p}own as (select distinct c.* from claims c join rer r on r.query_id = c.query_id where c.query_id in (select query_id from {p}rest) and list_has_any({words("c.text")}, {words("r.question")})),
{rendered(f"{p}own", f"{p}fall")},
{segmented(f"{p}fall", f"{p}fseg")},
{p}fpair as (select s.query_id, s.claim_text, r.passage from {p}fseg s join rer r on r.query_id = s.query_id and r.final_rank = s.source where length(r.passage) > 0),
{judged(f"{p}fpair", "claim_text", f"{p}fheld")},
{p}usable as (select query_id, answer extracted from {p}fall where answer != '{REFUSAL}' and query_id not in (select query_id from {p}fheld group by 1 having max(support) < 0.4)),
{p}gate as (select s.query_id, case when refused then 'refuse' when held then 'keep' when s.query_id in (select query_id from {p}rescued) then 'rescue' when extracted is not null then 'extract' else 'refuse' end decision, s.answer, extracted from {p}state s left join {p}usable u on u.query_id = s.query_id),
{prefix}final as (select query_id, decision, case when decision in ('keep', 'rescue') then answer when decision = 'extract' then extracted else '{REFUSAL}' end answer from {p}gate)"""


#: Every query that has sources, with its answer or the refusal.
ANSWERED = CLAIMS + f""",
asked as (select distinct query_id from rer), rendered as (select a.query_id, coalesce(n_claims, 0) n_claims, case when n_claims between 1 and 5 then answer else '{REFUSAL}' end answer from asked a left join ans on ans.query_id = a.query_id)"""

FINAL = f"""{ANSWERED},
{gated("claims", "rendered", "g")},
marks as (select *, list_transform(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1), lambda x: x::int) citations from gfinal)"""

_TAIL = " qq ww ee rr tt yy uu ii oo pp aa ss dd ff gg hh jj kk ll zz xx cc vv bb nn"
MADE = f"""{ANSWERED},
made as (select query_id, claim, case query_id % 4 when 0 then text when 1 then 'It is never so that ' || text when 2 then text || '{_TAIL} mm' else 'Q{_TAIL.strip()[1:]}.' end text, [1] cites from claims),
{rendered("made", "mmade")}, manswer as (select a.query_id, coalesce(answer, '{REFUSAL}') answer from asked a left join mmade on mmade.query_id = a.query_id),
{gated("made", "manswer", "m")}"""


def repair(claims: str) -> str:
    """``claims`` (query_id, claim, text, cites) with citations as entailment sees them."""
    return f"""rpair as (select c.query_id, c.claim, c.text, c.cites, r.final_rank source, r.passage from {claims} c join rer r on r.query_id = c.query_id),
{judged("rpair", "text", "rsup")},
better as (select query_id, claim, list_slice(list(source order by support desc, source) filter (support >= 0.4), 1, 2) better,
  max(case when list_contains(cites, source) then {coverage("text", "passage")} end) cover from rsup group by 1, 2),
repaired as (select c.query_id, c.claim, c.text, case when len(better) > 0 and list_sort(better) != list_sort(c.cites) then better else c.cites end cites, coalesce(len(better) > 0 and list_sort(better) != list_sort(c.cites), false) changed
  from {claims} c join better b on b.query_id = c.query_id and b.claim = c.claim where coalesce(len(better) > 0 and list_sort(better) != list_sort(c.cites), false) or cover >= case when c.claim = 1 then 0.15 else 0.45 end)"""


SUMMARY = FAITH + """,
rel as (select item_id query_id, doc_id from benchmark b, documents d where contains(d.text, b.text)),
deep as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) final_rank from pool qualify final_rank <= 10),
alone as (select *, row_number() over (partition by query_id order by round(score_dense, 9) desc, doc_id) r from hyb where score_dense is not null qualify r <= 10),
cfgh as (select 'A' config, query_id, doc_id, r rank from alone union all select 'B', query_id, doc_id, rank from hyb where rank <= 10 union all select 'C', query_id, doc_id, final_rank from deep union all select 'D', query_id, doc_id, final_rank from deep),
good as (select cfgh.* from cfgh join (select distinct * from rel) using (query_id, doc_id)), tot as (select query_id, count(distinct doc_id) total from rel group by 1),
ms as (select ['A','B','C','D'][event_id % 4 + 1] config, event_id // 4 query_id, "value" latency_ms from events),
rows_ as (select t.query_id, c.config, """ + ", ".join(f"round(count(distinct case when g.rank <= {k} then g.doc_id end) / any_value(total), 4) recall_at_{k}" for k in (3, 5, 10)) + """, round(coalesce(1.0::double / min(g.rank), 0), 4) mrr
  from tot t cross join (select distinct config from cfgh) c left join good g on g.query_id = t.query_id and g.config = c.config group by 1, 2),
evaluated as (select r.*, case when r.config = 'D' then coalesce(f.faithfulness, 0) end faithfulness, case when r.config = 'D' then coalesce(f.claim_accuracy, 0) end citation_accuracy, ms.latency_ms
  from rows_ r left join faith f on f.query_id = r.query_id left join ms on ms.config = r.config and ms.query_id = r.query_id),
summary as (select config, """ + ", ".join(f"round(avg({m}), 4) {m}" for m in QUALITY) + """, round(avg(latency_ms), 2) avg_latency_ms, round(list_sort(list(latency_ms) filter (latency_ms is not null))[floor(0.95::double * (count(latency_ms) - 1))::int + 1], 2) p95_latency_ms, count(*) queries from evaluated group by 1)"""

METRICS = SUMMARY + """,
shown as (select config, """ + ", ".join(f"round({m} * 100, 1) {m}" for m in QUALITY) + ", " + ", ".join(f"round({m}, 2) {m}" for m in COSTS) + f"""
  from summary), met as (select config, unnest({[*QUALITY, *COSTS]}) metric, unnest([{", ".join((*QUALITY, *COSTS))}]) "value" from shown),
steps as (select unnest(['bm25','reranker','nli']) step, unnest(['A','B','C']) "from", unnest(['B','C','D']) "to"),
gain as (select step, a.metric, "from", "to", a."value" "before", b."value" "after" from steps join met a on a.config = "from" join met b on b.config = "to" and b.metric = a.metric)"""

BEST = METRICS + """,
best_of as (select metric, config, "value" from met where "value" is not null qualify row_number() over (partition by metric order by case when metric like '%latency%' then "value" else -"value" end, case when metric like '%latency%' then config end, config desc) = 1)"""

LINES = """lines as (select doc_id, lang, unnest(string_split(text, chr(10))) text, generate_subscripts(string_split(text, chr(10)), 1) page from documents),
lc as (select doc_id::varchar || '-' || case when doc_id % 50 = 0 then 1 else page end chunk_id, doc_id::varchar document_id, doc_id, case when doc_id % 5 = 0 and page = 2 then 'other' else lang end theme, page, text,
  greatest(1, round_even(length(text) / 4.0, 0))::bigint tokens_est from lines where doc_id % 7 != 0 or page != 2)"""

LINE_PAIRS = LINES + f""",
lw as (select document_id, chunk_id, string_split({form("text")}, ' ') w from lc where {form("text")} != ''),
ls as (select document_id, chunk_id, case when len(w) <= 8 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(list_slice(w, i, i + 7), ' '))) end s from lw),
lx as (select document_id, chunk_id, len(s) n, unnest(s) sh from ls),
lp as (select a.chunk_id id_a, b.chunk_id id_b, count(*) / (a.n + b.n - count(*)) j from lx a join lx b on a.document_id = b.document_id and a.sh = b.sh and a.chunk_id < b.chunk_id group by a.chunk_id, b.chunk_id, a.n, b.n having count(*) / (a.n + b.n - count(*)) >= 0.6)"""

_BROKEN = r"regexp_extract_all(t, '\x{fffd}|\x{c3}[\x{80}-\x{bf}]|\x{e2}[\x{80}-\x{bf}]{2}|\x{c2}[\x{80}-\x{bf}]')"
_BARE = f"regexp_replace(t, '{_SPACE}', '', 'g')"
_CONTEXT = CHUNK_NAMESPACE.replace("-", "")

TEXTS = f"""tp as (select doc_id, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) page from documents),
tq as (select doc_id, page, length({_BARE}) chars, len(list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda w: w != '')) words, {letters(_BARE)} letters, length(t) < 50 blank,
  len(regexp_extract_all({_BARE}, '[\\x{{80}}-\\x{{9f}}]')) c1, len({_BROKEN}) broken from tp),
ts as (select doc_id, count(*) pages, sum(chars)::bigint chars, sum(words)::bigint words, sum(letters)::bigint letters, count(*) filter (blank) empty_pages, list_slice(list(page order by page) filter (blank), 1, 20) idx,
  sum(c1)::bigint c1, (sum(c1) >= 25 or sum(broken) > 0) mojibake from tq group by 1),
ti as (select doc_id, list_filter([case when chars < 4000 then 'no_text' end, case when chars >= 4000 and chars / pages < 400 then 'too_low_text' end, case when empty_pages > 0 then 'empty_pages' end,
  case when letters / greatest(chars, 1) < 0.4 then 'garbage_text' end, case when mojibake then 'mojibake' end], lambda x: x is not null) k from ts)"""

MANIFEST = f"""{PAPERS}, me as (select pos, id, ['rag','agents','fine_tuning','other'][pos % 4 + 1] theme, ['Retrieval of passages','Agents that plan with tools','Low-rank adapters','A note on agent query index'][pos % 3 + 1 + (pos % 5 = 0)::int] title,
  case when pos % 13 != 0 then id || case when pos % 6 = 0 then '-' else '_' end || pos || '.pdf' end file_name from papers),
mo as (select *, theme in ('rag','agents','fine_tuning') known, case theme {" ".join(f"when '{t}' then {hits('title', t)}" for t in THEME_KEYWORDS)} else 0 end own, {best("title")} b from me),
mi as (select *, list_filter([case when not regexp_matches(id, '^\\d{{4}}\\.\\d{{4,5}}(v\\d+)?$') then 'bad_arxiv_id' end, case when not known then 'bad_theme' end, case when file_name is null then 'missing_file' end,
  case when file_name is not null and not starts_with(file_name, id || '_') then 'name_mismatch' end, case when file_name is not null and theme != 'rag' then 'folder_mismatch' end, case when known and own = 0 then 'off_topic' end,
  case when known and b.theme != theme and own > 0 and own <= b.score then 'ambiguous_theme' end], lambda x: x is not null) k from mo),
mf as (select pos, '/corpus/rag/' || file_name path from me where file_name is not null union all
  select pos, '/corpus/' || case when pos % 2 = 0 then '_quarantine' else 'agents' end || '/lost-' || pos || '.pdf' from me where file_name is not null and pos % 17 = 0),
fc as (select path, case when pos % 10 != 0 then '%PDF' else 'PDF' end || repeat('x', (pos % 40 * 2500)::int) || case when pos % 9 = 0 then '/Encrypt' else '' end || case when pos % 7 != 0 then '%%EOF' else '' end content from mf),
fi as (select path, length(content) length, list_filter([case when length(content) < 50000 then 'too_small' end, case when not starts_with(content, '%PDF') then 'bad_signature' end,
  case when not contains(right(content, 2048), '%%EOF') then 'no_eof' end, case when contains(content, '/Encrypt') then 'corrupt_pdf' end], lambda x: x is not null) k, sha256(content) sha256 from fc)"""

_FATAL = "['missing_file','too_small','bad_signature','no_eof','corrupt_pdf','no_text','text_unreadable']"
_BASE = """select *, regexp_replace(lower(trim(id)), 'v\\d+$', '') base, regexp_matches(id, '^\\d{4}\\.\\d{4,5}(v\\d+)?$') good"""
VALIDATED = f"""{MANIFEST}, {TEXTS},
of_text as (select id, list_distinct(flatten(list(ti.k))) k from me join ti on ti.doc_id = me.pos group by 1),
va as (select mi.pos, mi.id, mi.theme, mi.file_name, list_distinct(list_concat(list_concat(mi.k, coalesce(fi.k, [])), coalesce(of_text.k, []))) k from mi left join fi on fi.path = '/corpus/rag/' || mi.file_name left join of_text on of_text.id = mi.id),
vb as ({_BASE} from va),
vc as (select *, row_number() over (partition by base order by case when good then substr(id, 1, 4)::int else 0 end desc, case when good then regexp_extract(id, '\\.(\\d+)', 1)::int else 0 end desc,
  case when good then coalesce(try_cast(regexp_extract(id, 'v(\\d+)$', 1) as int), 1) else 0 end desc, pos) = 1 kept from vb),
vd as (select pos, id, theme, file_name, case when kept then k else list_append(k, 'duplicate') end k, case when not kept then 'duplicate' when list_has_any(k, {_FATAL}) then 'invalid' when list_contains(k, 'off_topic') then 'flagged' else 'valid' end status from vc)"""

ORACLES = {
    "token_estimate": "select doc_id, greatest(1, round_even(length(text) / 4.0, 0))::bigint tokens from documents",
    "normal_form": f"select doc_id, md5({form('text')}) form from documents",
    "tokenize_stats": f"select doc_id, len({tokens('text')}) tokens, len(list_distinct({tokens('text')})) kinds from documents",
    "top_terms": f"select term, count(*) n from (select unnest({tokens('text')}) term from documents) group by 1 order by 2 desc, 1 limit 20",
    "sentence_units": f"select doc_id, len({sentences('text', '.;!?')}) units, md5(array_to_string({sentences('text', '.;!?')}, '|')) units_md5 from documents",
    "shingle_counts": f"""with w as (select doc_id, {form("text")} f, string_split({form("text")}, ' ') w from documents)
        select doc_id, case when f = '' then 0 when len(w) <= 8 then 1 else len(list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(list_slice(w, i, i + 7), ' ')))) end::bigint shingles from w""",
    "noisy_sentence_filter": f"select doc_id, count(*) sentences, count(*) filter ({NOISY}) noisy from (select doc_id, unnest({sentences('text')}) s from documents) group by 1",
    "text_quality": f"""with {TEXTS} select doc_id, pages, pages - empty_pages pages_with_text, empty_pages, array_to_string(coalesce(idx, []), ',') empty_pages_idx, chars, words, letters, c1 c1_controls, round_even(letters / greatest(chars, 1), 3) letter_ratio, round_even(chars / pages, 1) avg_chars_per_page, mojibake from ts""",
    "theme_keyword_hits": f"""with t as (select page_id, concat_ws(' ', url, html) t from pages)
        select page_id, {", ".join(f"{hits('t', x)}::bigint {x}" for x in sorted(THEME_KEYWORDS))}, {best("t")}.theme best_theme, {best("t")}.score::bigint best_score from t""",
    "string_functions": f"""select doc_id, md5({collapse("text")}) collapsed, translate(substr(text, 1, 160), chr(10), ' ') preview,
        doc_id || '_' || substr(regexp_replace(regexp_replace(lower(text), '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60) || '.pdf' slug from documents""",
    "ids_and_keys": f"""with s as (select *, sha1(from_hex('{_CONTEXT}') || encode(doc_id || '-c0001|' || substr(text, 1, 200))) x from documents)
        select doc_id, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || lower(printf('%x', (('0x' || substr(x, 17, 1))::int & 3) | 8)) || substr(x, 18, 3) || '-' || substr(x, 21, 12) chunk_id,
        substr(md5(text || '|1|0'), 1, 12) citation_id, md5(text || '||' || lang) pair_key, sha256(text) sha256 from s""",
    "dedupe_best_version": f"""with {PAPERS}, k as (select *, regexp_replace(lower(trim(id)), 'v\\d+$', '') base, regexp_matches(id, '^\\d{{4}}\\.\\d{{4,5}}(v\\d+)?$') good from papers),
        v as (select *, case when good then substr(id, 1, 4)::int else 0 end m, case when good then regexp_extract(id, '\\.(\\d+)', 1)::int else 0 end n, case when good then coalesce(try_cast(regexp_extract(id, 'v(\\d+)$', 1) as int), 1) else 0 end v from k)
        select pos, id, row_number() over (partition by base order by m desc, n desc, v desc, pos) = 1 kept from v""",
    "manifest_issues": f"""with {MANIFEST} select pos, array_to_string(k, ',') issues, case when list_contains(k, 'missing_file') then 'invalid' when list_contains(k, 'off_topic') then 'flagged' else 'valid' end status from mi""",
    "orphans_anti_join": "select doc_id, source from documents where doc_id not in (select doc_id from labels)",
    "per_theme_counts": "select lang, count(*) documents, count(distinct source) sources from documents group by 1",
    "acquisition_cap": """with f as (select lang theme, doc_id % 97 id, doc_id % 5 query_no, doc_id pos from documents), o as (select *, row_number() over (partition by theme, id order by query_no, pos) s from f qualify s = 1)
        select theme, id, query_no, pos, row_number() over (partition by theme order by query_no, pos, id) place from o qualify place <= 16""",
    "page_islands": f"""with {INTERVALS}, r as (select document_id, page_start a, greatest(page_start, page_end) b from iv),
        n as (select *, coalesce(a > max(b) over w + 1, true)::int new from r window w as (partition by document_id order by a, b rows between unbounded preceding and 1 preceding)),
        i as (select *, sum(new) over (partition by document_id order by a, b rows unbounded preceding) k from n), p as (select document_id, k, min(a) a, max(b) b from i group by 1, 2),
        s as (select document_id, sum(b - a + 1)::bigint covered, max(b)::bigint last_page, min(a)::bigint first from p group by 1)
        select document_id, covered, last_page, greatest(0, last_page - first + 1 - covered)::bigint holes, round(100 * covered / greatest(1, last_page), 1) coverage_pct from s""",
    "span_distribution": f"with {INTERVALS} select page_end - page_start + 1 span, count(*) n from iv group by 1",
    "incoherent_pages": f"with {INTERVALS}, j as (select document_id, page_start, page_end - case when document_id % 9 = 0 then 3 else 0 end page_end from iv) select document_id, count(*) n from j where not coalesce(page_start >= 1 and page_start <= page_end, false) group by 1",
    "exact_duplicates": f"select min(doc_id) first_id, count(*) n, count(*) - 1 redundant from documents where {form('text')} != '' group by {form('text')} having count(*) > 1",
    "near_duplicate_pairs": f"""with w as (select doc_id, source, {form("text")} f, string_split({form("text")}, ' ') w from documents),
        s as (select doc_id, source, case when len(w) <= 8 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(list_slice(w, i, i + 7), ' '))) end s from w where f != ''),
        x as (select doc_id, source, len(s) n, unnest(s) sh from s), c as (select a.doc_id id_a, b.doc_id id_b, a.n na, b.n nb, count(*) c from x a join x b on a.source = b.source and a.sh = b.sh and a.doc_id < b.doc_id group by all)
        select id_a, id_b, round(c / (na + nb - c), 3) jaccard from c where c / (na + nb - c) >= 0.6""",
    "size_histogram": "select (n_chars // 1000 * 1000)::bigint bucket, count(*) n from documents group by 1",
    "rank_percentiles": """with s as (select lang "group", list_sort(list(n_chars)) v, count(*) n from documents group by 1) select "group", q::double q, v[least(n - 1, floor(q * n))::int + 1] "value" from s, (select unnest([0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]::double[]) q)""",
    "grouped_statistics": "select grouping(lang, source)::bigint \"level\", lang theme, source document, count(*) n, sum(n_chars)::bigint total, min(n_chars) low, max(n_chars) high, round(avg(n_chars), 1) mean from documents group by grouping sets ((), (lang), (lang, source))",
    "theme_rollup": "select lang theme, count(distinct source) documents, count(*) chunks, sum(n_chars)::bigint tokens, round(count(*) / count(distinct source), 1) chunks_per_document, round(avg(n_chars), 1) mean_tokens from documents group by 1",
    "length_flags": "select count(*) filter (n_chars < 500) below, count(*) filter (n_chars between 500 and 3000) inside, count(*) filter (n_chars > 3000) above, count(*) filter (n_chars <= 0) not_positive from documents",
    "length_outliers": f"select doc_id, n_chars, case when n_chars < 150 then 'small' else 'large' end kind, substr({form('text')}, 1, 80) preview from documents where n_chars < 150 or n_chars > 700",
    "required_fields": """with r as (select case when doc_id % 7 != 0 then lang end lang, quality, toxic, text from documents left join labels using (doc_id)),
        m as (select concat_ws(',', case when lang is null then 'lang' end, case when quality is null then 'quality' end, case when toxic is null then 'toxic' end, case when text is null then 'text' end) missing from r) select missing, count(*) n from m where missing != '' group by 1""",
    "repeated_keys": "select conv_id, count(*) n from conversations group by 1 having count(*) > 1",
    "worst_status": "select o_custkey, case max(case when o_totalprice > 300000 then 2 when o_totalprice > 150000 then 1 else 0 end) when 2 then 'FAIL' when 1 then 'WARNING' else 'PASS' end status from orders group by 1",
    "bm25_topk": f"with {BM25} select query_id, doc_id, round(score, 6) score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) rank from bm qualify rank <= 10",
    "bm25_padded": f"with {BM25} select query_id, doc_id, round(score, 6) score, rank from lex",
    "dense_topk": """with d as (select q.vec_id query_id, v.vec_id doc_id, list_inner_product(q.embedding::double[], v.embedding::double[]) score from embeddings v, embeddings q where q.vec_id in (select item_id from benchmark))
        select query_id, doc_id, round(score, 6) score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) rank from d qualify rank <= 10""",
    "hybrid_search": f"with {HYBRID} select query_id, doc_id, round(score_dense, 6) score_dense, round(score_bm25, 6) score_bm25, round(rrf, 6) rrf, channels, rank from hyb",
    "dense_only_from_hybrid": f"with {HYBRID} select query_id, doc_id, round(score_dense, 6) score, r rank from (select *, row_number() over (partition by query_id order by round(score_dense, 9) desc, doc_id) r from hyb where score_dense is not null) where r <= 10",
    "rerank_topk": f"with {RERANK} select query_id, doc_id, round(score, 6) score, hybrid_rank, final_rank from rer",
    "rank_movement": f"with {RERANK} select query_id, avg(abs(hybrid_rank - final_rank)) mean_abs_rank_change from rer group by 1",
    "extractive_claims": f"with {CLAIMS} select query_id, claim, text, array_to_string(cites, ',') citations from claims",
    "rendered_answers": f"with {ANSWERED} select query_id, n_claims, answer from rendered",
    "grounding_filter": f"""with {CLAIMS}, x as (select query_id, claim, text, unnest(cites) source from claims), m as (select x.query_id, claim, max({coverage("x.text", "r.passage")}) coverage from x join rer r on r.query_id = x.query_id and r.final_rank = x.source group by 1, 2)
        select query_id, claim, round(coverage, 6) coverage from m where coverage >= case when claim = 1 then 0.15 else 0.45 end""",
    "segmented_claims": f"with {VERIFIED} select query_id, segment, claim_text, array_to_string(cites, ',') citations from seg",
    "verified_citations": f"with {VERIFIED} select query_id, segment, source::bigint source, doc_id, round(e, 6) entailment, support, verdict from ver",
    "verdict_summary": f"""with {VERIFIED} select count(*) n, count(*) filter (verdict = 'Supported') supported, count(*) filter (verdict = 'Weak Support') weak, count(*) filter (verdict = 'Unsupported') unsupported,
        round(avg(support), 4) mean, min(support) low, max(support) high, round(100 * count(*) filter (verdict = 'Supported') / count(*), 1) supported_pct from ver""",
    "faithfulness": f"with {FAITH} select * from faith",
    "weighted_accuracy": f"with {FAITH} select round(sum(pair_accuracy * pairs) / sum(pairs), 4) pair_accuracy, round(avg(faithfulness), 4) faithfulness from faith",
    "sanitized_claims": f"""with r as (select item_id, text || ' as said in [' || item_id || '] ,  [2] and [1].' t from benchmark), a as (select *, {strip("regexp_replace(regexp_replace(t, '\\[[0-9]+\\]', '', 'g'), '\\s{2,}', ' ', 'g')")} x from r),
        b as (select *, regexp_replace({strip("regexp_replace(regexp_replace(x, '[\\s.,;:]+$', ''), '\\s*(?:,|\\band\\b|\\bor\\b)$', '', 'i')")}, '[\\s.,;:]+$', '') y from a)
        select item_id, y claim, array_to_string(list_slice(list_sort(list_distinct(list_filter(list_concat(case when item_id % 2 = 0 then [4, 9] else [5] end, list_transform(regexp_extract_all(t, '\\[([0-9]+)\\]', 1), lambda n: n::int)), lambda n: n between 1 and 5))), 1, 2), ',') citations from b""",
    "support_verdicts": """with s as (select round_even(least(1.0, (l_discount * 10) * (l_discount * 10) / (l_discount * 10 + l_tax * 5 + 1e-6)), 4) s from lineitem)
        select case when s >= 0.7 then 'Supported' when s >= 0.4 then 'Weak Support' else 'Unsupported' end verdict, count(*) n, round(avg(s), 3) mean from s group by 1""",
    "recall_at_k": f"""with {RELEVANT}, t as (select query_id, count(distinct doc_id) total from rel group by 1), h as (select top.query_id, doc_id, rank from top join rel using (query_id, doc_id))
        select t.query_id, {", ".join(f"round(count(distinct case when rank <= {k} then doc_id end) / any_value(total), 4) recall_at_{k}" for k in (3, 5, 10))} from t left join h using (query_id) group by 1""",
    "reciprocal_rank": f"with {RELEVANT} select rel.query_id, round(coalesce(1.0::double / min(top.rank), 0), 4) rr from rel left join top using (query_id, doc_id) group by 1",
    "latency_percentiles": """with s as (select event_type "group", list_sort(list(value)) v, count(*) n, avg(value) m from events where value is not null group by 1) select "group", round(m, 2) mean, v[-1] high, v[floor(0.95::double * (n - 1))::int + 1] p95 from s""",
    "metrics_pivot": f"with {METRICS} select * from shown",
    "best_config": f"with {BEST} select * from best_of",
    "metric_gains": f"""with {METRICS} select step, metric, "from", "to", round("after" - "before", 4) delta, case when "before" != 0 then round_even(("after" - "before") / "before" * 100, 1) end gain_pct,
        case when metric like '%latency%' then 'cost' when "before" is null then 'new' else 'improvement' end direction from gain where "before" is not null or "after" is not null""",
    "trade_off": f"""with {METRICS}, p as (select step, a.recall_at_5 ra, b.recall_at_5 rb, a.avg_latency_ms la, b.avg_latency_ms lb from steps join summary a on a.config = "from" join summary b on b.config = "to")
        select step, round((rb - ra) * 100, 2) points, round(lb - la, 2) cost, case when round((rb - ra) * 100, 9) > 0 then round((lb - la) / ((rb - ra) * 100), 1) end cost_per_point from p""",
    "normalised_metrics": f"""with {METRICS} select config, metric, case when max("value") over (partition by metric) > 0 then round("value" / max("value") over (partition by metric), 6) else 0.0 end share from met""",
    "readiness_flags": "select source, bool_and(n_chars >= 100) all_good, bool_or(n_chars >= 100) any_good, count(*) filter (n_chars >= 100) n_good from documents group by 1",
    "judged_ids": """select id, 'any' kind from (select doc_id id from documents union select doc_id from labels) union all select id, 'both' from (select doc_id id from documents intersect select doc_id from labels)
        union all select id, 'first' from (select doc_id id from documents except all select doc_id from labels)""",
    "text_issues": f"with {TEXTS} select doc_id, array_to_string(k, ',') issues from ti",
    "author_names": f"""with w as (select doc_id, unnest(regexp_split_to_array(text, '[ \\n]+')) w, generate_subscripts(regexp_split_to_array(text, '[ \\n]+'), 1) p from documents), c as (select doc_id, {collapse("w")} n, p from w),
        f as (select doc_id, lower(n), min_by(n, p) n, min(p) p from c where n != '' group by 1, 2) select d.doc_id, md5(coalesce(string_agg(n, '|' order by p), '')) names from documents d left join f using (doc_id) group by 1""",
    "cleaned_answers": f"""with r as (select item_id, 'Assistant: hello' || chr(10) || text || chr(10) || '[/INST] end' || chr(10) || 'SOURCES:' || chr(10) || '[2] second' || chr(10) || ' noise ' || chr(10) || '[1]  ' || substr(text, 1, 30) || chr(10) || '[2] again' || chr(10) t from benchmark)
        select item_id, {strip("array_to_string(list_filter(regexp_split_to_array(t, chr(13) || chr(10) || '|' || chr(13) || '|' || chr(10)), lambda l: not regexp_matches(" + strip("lower(l)") + ", '^(sources|\\[/|assistant)')), chr(10))")} answer from r""",
    "source_lines": f"""select item_id, 1 n, {strip("substr(translate(text, chr(10), ' '), 1, 30)")} line from benchmark union all select item_id, 2, 'again' from benchmark""",
    "paragraph_counts": f"""select doc_id, len(list_filter(regexp_split_to_array(text, '\\n{_SPACE}*\\n'), lambda p: {strip("p")} != '')) paragraphs from documents""",
    "file_issues": f"with {MANIFEST} select path, length, array_to_string(k, ',') issues, sha256 from fi",
    "orphan_files": f"with {MANIFEST} select path from mf where not contains(path, '_quarantine') and path not in (select '/corpus/rag/' || file_name from me where file_name is not null)",
    "validated_manifest": f"with {VALIDATED} select pos, id, array_to_string(list_sort(k), ',') issues, status, status in ('invalid', 'duplicate') and file_name is not null quarantined from vd",
    "manifest_status_counts": f'with {VALIDATED} select status, theme, count(*) n, grouping(status, theme)::bigint "level" from vd group by cube (status, theme)',
    "chunk_statistics": f"with {LINES} select theme, count(distinct document_id) documents, count(*) chunks, sum(tokens_est)::bigint tokens, round(count(*) / count(distinct document_id), 1) chunks_per_document, round(avg(tokens_est), 1) mean_tokens from lc group by 1",
    "chunk_gate": f"""with {LINE_PAIRS}, cover as (select doc_id, document_id, count(distinct page) covered, max(page) last_page, min(page) first_page from lc group by 1, 2),
        ref as (select doc_id, len(string_split(text, chr(10))) + (doc_id % 11 = 0)::int page_count from documents where doc_id % 13 != 0),
        checks as (select 'required_fields' "check", 2 bad, count(*) filter (theme is null or text is null) findings from lc
        union all select 'chunk_id_unique', 2, count(*) from (select chunk_id from lc group by 1 having count(*) > 1)
        union all select 'empty_text', 2, count(*) from lc where {form("text")} = ''
        union all select 'content_duplicates', 1, (select count(*) from (select 1 from lc group by {form("text")} having count(*) > 1)) + (select count(*) from lp)
        union all select 'document_id_consistency', 1, count(*) from (select document_id from lc group by 1 having count(distinct coalesce(theme, '')) > 1)
        union all select 'page_coherence', 2, 0 union all select 'length_range', 1, count(*) from lc where tokens_est not between 100 and 512
        union all select 'document_coverage', case when (select count(*) from ref where doc_id not in (select doc_id from cover)) > 0 then 2 else 1 end,
          (select count(*) from cover where last_page - first_page + 1 - covered > 0 or round(100 * covered / greatest(1, last_page), 1) < 99) + (select count(*) from cover join ref using (doc_id) where last_page != page_count)
          + (select count(*) from ref where doc_id not in (select doc_id from cover)) + (select count(*) from cover where doc_id not in (select doc_id from ref))),
        stated as (select "check", case when findings > 0 then bad else 0 end r, findings::bigint findings from checks)
        select "check", ['PASS','WARNING','FAIL'][r + 1] status, findings, ['PASS','WARNING','FAIL'][max(r) over () + 1] overall from stated""",
    "duplication_report": f"""with {LINE_PAIRS}, own as (select * from lc where doc_id % 50 != 0), x as (select count(*) n from own group by {form("text")} having count(*) > 1), p as (select * from lp where split_part(id_a, '-', 1)::bigint % 50 != 0),
        t as (select (select count(*) from x) exact_groups, (select coalesce(sum(n - 1), 0)::bigint from x) redundant, (select count(*) from p) near_pairs, (select count(distinct id) from (select id_a id from p union all select id_b from p)) involved)
        select *, redundant > 0 or near_pairs > greatest(5, floor((select count(*) from own) * 0.02)) excessive from t""",
    "coverage_totals": f"""with {INTERVALS}, r as (select document_id, page_start a, greatest(page_start, page_end) b from iv), pg as (select distinct document_id, unnest(range(a, b + 1)) p from r), c as (select document_id, count(*) covered from pg group by 1),
        per as (select document_id, count(*) chunks, max(b) last_page from r group by 1)
        select count(*) documents, min(chunks) fewest, max(chunks) most, round(avg(chunks), 1) mean_chunks, count(*) filter (chunks < 5) thin_documents, round(100 * sum(covered) / greatest(1, sum(last_page)), 1) overall_coverage_pct from per join c using (document_id)""",
    "span_totals": f"with {INTERVALS}, s as (select greatest(1, page_end - page_start + 1) s from iv) select round(avg(s), 2) mean_span, max(s)::bigint max_span, count(*) filter (s > 1) multi_page, round(100 * count(*) filter (s > 1) / count(*), 1) multi_page_pct from s",
    "length_examples": "(select 'below' kind, doc_id id, n_chars size from documents where n_chars < 500 order by 3, 2 limit 10) union all (select 'above', doc_id, n_chars from documents where n_chars > 3000 order by 3 desc, 2 limit 10)",
    "exact_group_examples": f"""with f as (select doc_id id, {form("text")} f, min(doc_id) over (partition by {form("text")}) first_id, count(*) over (partition by {form("text")}) n from documents), g as (select distinct first_id from f where n > 1 and f != '' order by 1 limit 5)
        select first_id, id from f where first_id in (select first_id from g)""",
    "bm25_index_build": f"""with t as (select {tokens("text")} t from documents) select count(*) documents, sum(len(t))::bigint total_tokens, round(avg(len(t)), 1) mean_tokens, min(len(t)) min_tokens, max(len(t)) max_tokens, count(*) filter (len(t) = 0) empty_documents,
        (select count(distinct w) from (select unnest(t) w from t)) vocabulary from t""",
    "bm25_index_status": f"with e as (select count(*) filter (len({tokens('text')}) = 0) n from documents) select case when n > 0 then 'WARNING' else 'PASS' end status, true sound, n empty_documents from e",
    "vector_store": "with n as (select count(*) n from embeddings where vec_id % 3 != 0 or vec_id % 2 = 0) select n expected, n indexed, true count_match, true all_found, true payload_ok, 'PASS' status, 'created,reused' actions from n",
    "hybrid_previews": f"with {HYBRID} select h.query_id, h.doc_id, h.rank, d.lang theme, translate(substr(d.text, 1, 160), chr(10), ' ') preview from hyb h join documents d using (doc_id) where h.rank <= 10",
    "rerank_by_model": f"with {RERANK} select query_id, doc_id, round(score, 6) score, hybrid_rank, final_rank from rer",
    "rerank_summary": f"with {RERANK}, m as (select query_id, round(avg(abs(hybrid_rank - final_rank)), 2) m from rer group by 1) select count(*) queries, round(avg(m), 2) mean_abs_rank_change, (select count(*) from pool) pairs_scored from m",
    "search_report": f"""with {HYBRID}, p as (select query_id, count(score_dense) dense, count(score_bm25) bm25, count(*) n, bool_and(length(text) > 0) t from hyb join documents using (doc_id) group by 1), q as (select item_id, p.* from benchmark left join p on query_id = item_id)
        select case when bool_and(coalesce(n, 0) > 0) then 'PASS' else 'FAIL' end status, count(*) queries, count(n) answered, sum(n) > 0 and bool_and(t) ready, bool_and(coalesce(n, 0) > 0) all_queries_returned, bool_and(t) text_available, min(coalesce(dense, 0)) min_dense, min(coalesce(bm25, 0)) min_bm25, sum(n)::bigint results from q""",
    "verification_by_model": f"with {VERIFIED} select query_id, segment, source::bigint source, support, verdict, substr(md5(question || '|' || source || '|' || segment), 1, 12) citation_id from ver",
    "nli_gate": f"with {MADE} select query_id, decision, answer from mfinal",
    "answers": f"with {FINAL} select query_id, decision, answer, array_to_string(citations, ',') citations, array_to_string(list_sort(list_distinct(citations)), ',') cited from marks",
    "citation_repair": f"""with {CLAIMS}, wrong as (select query_id, claim, text, case when claim % 2 = 0 then [1::bigint] else cites end cites from claims),
        {repair("wrong")} select query_id, claim, text, array_to_string(cites, ',') citations, changed from repaired""",
    "claims_from_model": f"""with {CLAIMS}, n as (select query_id, count(*) n from rer group by 1),
        spoken as (select query_id, claim, regexp_replace({strip("regexp_replace(text || ' [1] and [9].', '\\[[0-9]+\\]', '', 'g')")}, '[\\s.,;:]*(\\b(and|or)\\b[\\s.,;:]*)?$', '', 'i') text, [1::bigint] cites from claims where query_id % 3 != 0),
        tidy as (select query_id, claim, regexp_replace(text, '\\s{{2,}}', ' ', 'g') text, cites from spoken where text != ''),
        {repair("tidy")}, usable as (select query_id from repaired group by 1 having count(*) between 1 and 5)
        select query_id, row_number() over (partition by query_id order by claim) claim, text, array_to_string(cites, ',') citations from repaired where query_id in (select query_id from usable)
        union all select query_id, claim, text, array_to_string(cites, ',') from claims where query_id not in (select query_id from usable)""",
    "prompts": f"""with {RERANK}, b as (select query_id, any_value(question) question, string_agg('[' || final_rank || '] ' || doc_id || ' p.1-' || len(string_split(passage, chr(10))) || ':' || chr(10) || case when length(passage) > 1200 then substr(passage, 1, 1200) || ' [...]' else passage end, chr(10) || chr(10) order by final_rank) c,
        count(*) filter ({strip("passage")} != '') n from rer group by 1)
        select query_id, md5('Context:' || chr(10) || c || chr(10) || chr(10) || 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Instructions:' || chr(10) || 'Answer from the numbered sources alone and cite them.') prompt, {strip("string_split(" + strip("question") + ", chr(10))[1]")} question, n n_sources from b""",
    "answer_summary": f"""with {FINAL}, s as (select count(*) queries, sum(len(citations))::bigint total_citations, round(avg(len(citations)), 2) mean_citations_per_answer, count(*) answers, count(*) filter (len(citations) > 0) with_citations, (count(*) filter (len(citations) = 0))::bigint problems from marks)
        select *, problems = 0 ready, case when problems = 0 then 'PASS' else 'WARNING' end status from s""",
    "source_references": f"with {FINAL} select r.query_id, r.final_rank source, r.doc_id, list_contains(m.citations, r.final_rank) extracted from rer r join marks m on m.query_id = r.query_id",
    "generation_readiness": f"""with {RERANK}, c as (select count(*) filter (length(passage) >= 100) full_texts, count(*) filter (length(passage) < 100) short_texts, count(distinct query_id) got from rer)
        select got > 0 and short_texts = 0 ready, full_texts, short_texts, 0::bigint without_reference, case when got > 0 and short_texts = 0 and got = (select count(distinct item_id) from benchmark) then 'PASS' else 'FAIL' end status from c""",
    "self_check": f"""with c as (select text passage, unnest(['true','false']) kind, unnest([text, 'never ' || text || ' qq ww ee']) claim, unnest(['Supported','Unsupported']) expected from benchmark),
        v as (select *, {coverage("claim", "passage")} c, list_has_any({words("claim")}, ['not','no','never']) != list_has_any({words("passage")}, ['not','no','never']) odd from c),
        n as (select *, case when odd then (1 - c) * 0.1 else c * c end e, case when odd then c * c else (1 - c) * 0.1 end k from v), s as (select *, round_even(least(1.0, e * e / (e + k + 1e-6)), 4) s from n)
        select kind, case when s >= 0.7 then 'Supported' when s >= 0.4 then 'Weak Support' else 'Unsupported' end verdict, expected, count(*) n from s group by 1, 2, 3""",
    "latency_summary": "select count(*) queries, round(avg(value), 2) mean_total_ms, max(value) max_total_ms, round(avg(value / 4), 2) mean_dense_ms, round(avg(value / 8), 2) mean_bm25_ms from events",
    "evaluation_rows": f"with {SUMMARY} select * from evaluated",
    "configuration_summary": f"with {SUMMARY} select * from summary",
    "metrics_display": f"""with {METRICS} select config, metric, case when "value" is null then 'N/A' when metric like '%latency%' then format('{{:,.1f}} ms', "value") else format('{{:.1f}}%', "value") end shown from met""",
    "winning_config": f"""with {BEST}, w as (select config, count(*) n from best_of where metric not like '%latency%' group by 1) select (select config from w order by n desc, config limit 1) best_quality, (select config from best_of where metric = 'avg_latency_ms') fastest""",
    
    "verification_summary": f"""with {FAITH}, p as (select query_id, count(*) w, round(avg(support), 4) m, round(count(*) filter (verdict = 'Supported') / count(*), 4) s, round(count(*) filter (verdict = 'Weak Support') / count(*), 4) k, round(count(*) filter (verdict = 'Unsupported') / count(*), 4) u from ver group by 1)
        select sum(w)::bigint citations_verified, round(sum(m * w) / sum(w), 4) mean_support, round(sum(s * w) / sum(w), 4) supported_rate, round(sum(k * w) / sum(w), 4) weak_rate, round(sum(u * w) / sum(w), 4) unsupported_rate, (select round(avg(faithfulness), 4) from faith) faithfulness from p""",
}

ORACLES["near_pair_examples"] = f"select * from ({ORACLES['near_duplicate_pairs']}) order by jaccard desc, id_a, id_b limit 10"

ORACLES["atom_entries"] = """select page_id, '2401.' || page_id || 'v' || n arxiv_id, 'A title of & ' || page_id title, 'Ann,Bo' authors, 'Line one line two' summary,
        case when n = 1 then 'http://x/pdf/' || page_id else 'https://arxiv.org/pdf/2401.' || page_id || 'v2' end pdf_url from pages, (select unnest([1, 2]) n)"""
ORACLES["first_documents"] = "select doc_id, n_chars from documents order by doc_id limit 25"
ORACLES["contained_ids"] = """select count(*) = 0 "contained", count(*) missing, 'labels' "of" from (select distinct doc_id from labels where doc_id not in (select doc_id from documents))
        union all select count(*) = 0, count(*), 'documents' from (select distinct doc_id from documents where doc_id not in (select doc_id from labels))"""
ORACLES["quotations"] = f"""with {RERANK}, q as (select query_id, final_rank source, unnest({sentences("passage")}) s, generate_subscripts({sentences("passage")}, 1) pos from rer),
        f as (select query_id, source, s from q where length(s) between 60 and 220 and not contains(s, 'arXiv:') and not contains(s, 'http') and not regexp_matches(s, '^(1 |2 |3 |Figure|Table|Abstract)') and {letters("s")} / length(s) >= 0.55
          qualify row_number() over (partition by query_id, source order by pos) = 1), t as (select query_id, string_agg(s || ' [' || source || '].', ' ' order by source) answer from f group by 1)
        select a.query_id, coalesce(answer, '{UNCITED}') answer from (select distinct query_id from rer) a left join t on t.query_id = a.query_id"""
ORACLES["explored_theme"] = f"with {SUMMARY} select *, 'even' theme from evaluated where query_id % 2 = 0"
