"""SQL of the core queries, over the same whole tables."""

from __future__ import annotations

from timberline.operators.prompts import KEY_EXAMPLES, KEY_HINTS
from timberline.schema import KEY_NAMES

_SP = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SP}+|{_SP}+$', '', 'g')"


def _collapse(c: str) -> str:
    return _strip(f"regexp_replace({c}, '{_SP}+', ' ', 'g')")


def _sentences(c: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace(coalesce({c}, ''), '([.!?]){_SP}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '')"


_NUMBER = r"case when regexp_matches({c}, '^[\t-\r ]*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[\t-\r ]*$') then try_cast(regexp_replace({c}, '[\t-\r ]+', '', 'g') as double) end"
_POSTS = "posts as (select * from post_data where timeline_id is not null and post_index is not null qualify row_number() over (partition by timeline_id, post_index order by row_id desc) = 1)"
_LAST = "res as (select * from task_b_results where timeline_id is not null and post_index is not null qualify row_number() over (partition by timeline_id, post_index order by result_id desc) = 1)"


def _ok(c: str, n: int) -> str:
    return f"(case when {c} is not null and len({c}) = {n} and len(list_filter({c}, lambda x: x is not null and not isnan(x))) = {n} then list_sum(list_transform({c}, lambda x: x::double * x::double)) > 0 else false end)"


def _knn(sim: str, use: str, k: int, group: bool = True) -> str:
    apart = "q.g <> c.g" if group else "true"
    return f"""
with v as (select profile_id id, coalesce(timeline_id, '') g, coalesce(is_annotated, false) a, structural_vector::double[] v1, semantic_vector::double[] v2 from post_profile where {use}),
p as (select q.id query_id, c.id candidate_id, round({sim}, 9) s from (select * from v where id % 100 = 0) q join (select * from v where a) c on q.id <> c.id and {apart}),
r as (select *, row_number() over (partition by query_id order by s desc, candidate_id) rank from p)
select query_id, candidate_id, cast(rank as int) rank, round(s + 1e-10, 6) similarity from r where rank <= {k}"""


_C1, _C2 = "list_cosine_similarity(q.v1, c.v1)", "list_cosine_similarity(q.v2, c.v2)"
_U1, _U2 = _ok("structural_vector", 14), _ok("semantic_vector", 64)
_H = f"(0.25 * {_C1} + 0.75 * {_C2})"
_HC = f"((0.0625 * {_C1} + 0.5625 * {_C2}) / 0.625)"
_H5 = f"(0.5 * {_C1} + 0.5 * {_C2})"


def _context(w: int) -> str:
    o = "over (partition by timeline_id order by coalesce(post_index, -1), row_id rows between"
    item = "struct_pack(i := coalesce(post_index, -1), t := coalesce(post, ''))"
    before = f"coalesce(list({item}) {o} {w} preceding and 1 preceding), [])" if w else "[]::struct(i int, t varchar)[]"
    after = f"coalesce(list({item}) {o} 1 following and {w} following), [])" if w else "[]::struct(i int, t varchar)[]"
    return f"select row_id, timeline_id, well_being_score, post_summary, {before} b, {after} a from post_data"


def _ctx(w: int) -> str:
    return f"with x as ({_context(w)}) select row_id, cast(len(b) as int) n_before, cast(len(a) as int) n_after, coalesce(array_to_string(list_transform(b, lambda x: x.t), '|'), '') before_text, coalesce(array_to_string(list_transform(a, lambda x: x.t), '|'), '') after_text from x"


def _part(title: str, c: str) -> str:
    return f"case when len({c}) > 0 then '{title}' || chr(10) || array_to_string(list_transform({c}, lambda x: '  [post ' || x.i || '] ' || chr(34) || x.t || chr(34)), chr(10)) else '' end"


_KEYS = ("A", "B-O", "B-S", "C-O", "C-S", "D")
_DIMS = [f"max(case when polarity = '{p}' and gold_abcd_key = '{k}' then 1 else 0 end)" for p in ("adaptive", "maladaptive") for k in _KEYS]
_PRES = f"pres as (select timeline_id, post_index, [{', '.join(_DIMS)}] d, count(*) n, avg(case when polarity = 'adaptive' then 1.0::double else 0.0 end) ratio from evidence_span where timeline_id is not null and post_index is not null group by 1, 2)"
_RAW = f"{_PRES}, raw as (select profile_id, wellbeing, coalesce(d, list_resize([]::int[], 12, 0)) d, coalesce((wellbeing - 1) / 9.0::double, 0.5) w, coalesce(ratio, 0.5) r from post_profile left join pres using (timeline_id, post_index)), nrm as (select *, sqrt(list_sum(d) + w * w + r * r) n from raw)"

_UP = f"upper({_strip('coalesce(predicted_abcd_key, ' + chr(39) * 2 + ')')})"
_TWO = "".join(f" when contains(s, '{k}') then '{k}'" for k in ("B-O", "B-S", "C-O", "C-S"))
_NAMES = "".join(f" when contains(s, '{n}') then '{k}'" for n, k in (("AFFECT", "A"), ("BEHAVIOR TOWARD THE OTHER", "B-O"), ("BEHAVIOR OTHER", "B-O"), ("BEHAVIOR TOWARD THE SELF", "B-S"), ("BEHAVIOR SELF", "B-S"), ("COGNITION OF THE OTHER", "C-O"), ("COGNITION OTHER", "C-O"), ("COGNITION OF THE SELF", "C-S"), ("COGNITION SELF", "C-S"), ("DESIRE", "D")))
_EXACT = "case when s in ('A','B-O','B-S','C-O','C-S','D') then s" + _TWO
_COMPAT = _EXACT + " when contains(s, 'A') then 'A' when contains(s, 'D') then 'D'" + _NAMES + " else 'UNKNOWN' end"
_STRICT = _EXACT + _NAMES + r" when regexp_matches(s, '\bA\b') then 'A' when regexp_matches(s, '\bD\b') then 'D' else 'UNKNOWN' end"
_LAB = f"lab as (select *, {_UP} s from evidence_span), pr as (select span_id, gold_abcd_key gold, polarity, {_STRICT} pred from lab)"
_F1 = """k as (select unnest(['A','B-O','B-S','C-O','C-S','D']) label),
c as (select label, count(case when gold = label and pred = label then 1 end) tp, count(case when gold is distinct from label and pred = label then 1 end) fp, count(case when gold = label and pred is distinct from label then 1 end) fn from k, pr group by label),
f as (select label, coalesce(round(case when tp + fp > 0 then tp::double / (tp + fp) end + 1e-10, 6), 0) p, coalesce(round(case when tp + fn > 0 then tp::double / (tp + fn) end + 1e-10, 6), 0) r, coalesce(round(case when 2 * tp + fp + fn > 0 then 2.0 * tp::double / (2 * tp + fp + fn) end + 1e-10, 6), 0) f1, coalesce(case when 2 * tp + fp + fn > 0 then 2.0 * tp::double / (2 * tp + fp + fn) end, 0) fx, tp + fn s from c)"""


def _overlap(p: str, h: str) -> str:
    hw = f"list_distinct(string_split(lower({h}), ' '))"
    return f"(len(list_intersect({hw}, list_distinct(string_split(lower({p}), ' '))))::double / len({hw}))"


def _pairs(src: str, key: str, pred: str, gold: str, ev: str | None) -> str:
    evidence = f"list_filter(coalesce({ev}, []::varchar[]), lambda x: x is not null)" if ev else "[]::varchar[]"
    return f"""
b as (select {key} id, {_sentences(pred)} s, {_sentences(gold)} g, {evidence} h from {src}),
m as (select id, si, gt, st from (select id, unnest(s) st, generate_subscripts(s, 1) si, g from b), unnest(g) t(gt)),
mc as (select id, si, sum(1 - (1 - {_overlap('gt', 'st')}) * 0.5) sm, count(*) n, max((1 - {_overlap('gt', 'st')}) * 0.5) mx from m group by 1, 2),
c as (select id, sum(sm) / sum(n) cs, avg(mx) ct from mc group by 1),
e as (select id, hi, max({_overlap('ht', 'st')}) mx from (select id, unnest(h) ht, generate_subscripts(h, 1) hi, s from b), unnest(s) t(st) group by 1, 2),
ea as (select id, avg(mx) ea from e group by 1),
pm as (select id, case when len(s) = 0 or len(g) = 0 then 0.0 else cs end cs, case when len(s) = 0 or len(g) = 0 then 1.0 else ct end ct, case when len(s) = 0 or len(g) = 0 then 0.0 else ea end ea from b left join c using (id) left join ea using (id))"""


def _mode(mode: str) -> str:
    return _pairs(f"(select * from task_b_results where length(gold_summary) > 0 and length({mode}_summary) > 0)", "result_id", f"{mode}_summary", "gold_summary", "evidence_texts")


_MEANS = "count(*) n_evaluated, round(avg(cs) + 1e-10, 6) consistency, round(avg(ct) + 1e-10, 6) contradiction, round(avg(ea) + 1e-10, 6) evidence_alignment"


def _running(src: str, order: str, v: str, every: int) -> str:
    return f"select p as position, round(s / p + 1e-10, 6) running from (select row_number() over (order by {order}) p, sum({v}) over (order by {order} rows unbounded preceding) s from {src}) where p % {every} = 0"


def _block(title: str, polarity: str) -> str:
    own = f"list_filter(spans, lambda x: x.polarity = '{polarity}')"
    names = "".join(f" when '{k}' then '{n}'" for k, n in (("A", "Affect"), ("B-O", "Behavior toward the Other"), ("B-S", "Behavior toward the Self"), ("C-O", "Cognition of the Other"), ("C-S", "Cognition of the Self"), ("D", "Desire")))
    line = f"'  - ' || (case x.k{names} else x.k end) || ' (' || x.k || '): \"' || x.t || '\"'"
    return f"'{title}' || chr(10) || case when len({own}) > 0 then array_to_string(list_transform({own}, lambda x: {line}), chr(10)) else '  None identified' end"


_LISTS = "lists as (select timeline_id, post_index, list(struct_pack(polarity := coalesce(polarity, ''), k := coalesce(gold_abcd_key, ''), t := text) order by span_id) spans from evidence_span where timeline_id is not null and post_index is not null and length(text) > 0 group by 1, 2)"
_EV = f"({_block('Adaptive evidence:', 'adaptive')} || chr(10) || {_block('Maladaptive evidence:', 'maladaptive')})"
_TL = "'Here is all posts of one person, in order. Summarize it in a few sentences.' || chr(10) || x || chr(10)"
_JSON = """'Answer as JSON of this form:' || chr(10) || '{"summary": "..."}'"""


def _hints(polarity: str) -> str:
    lines = [f"{k} ({KEY_NAMES[k]}): {v}. For example: {KEY_EXAMPLES[k][polarity]}." for k, v in KEY_HINTS.items()]
    return " || chr(10) || ".join(f"'{x}'" for x in lines)


_WBT = "case when w is null or isnan(w) then 'Unknown' else cast(cast(round_even(w, 0) as bigint) as varchar) end"


def oracle_sql() -> dict[str, str]:
    two = f"{_U1} and {_U2}"
    return {
        "knn_semantic_top1": """
with p as (select q.vec_id query_id, c.vec_id candidate_id, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9) s from embeddings q join embeddings c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and q.label <> c.label)
select query_id, candidate_id, round(s + 1e-10, 6) similarity from p qualify row_number() over (partition by query_id order by s desc, candidate_id) = 1""",
        "knn_semantic_top5": _knn(_C2, _U2, 5),
        "knn_same_group_allowed": _knn(_C2, _U2, 3, False),
        "knn_structural": _knn(_C1, _U1, 1),
        "knn_hybrid": _knn(_H, two, 3),
        "knn_hybrid_concat": _knn(_HC, two, 3),
        "fold_similarity": f"with k as ({_knn(_H5, two, 1)}) select coalesce(timeline_id, '') fold, count(*) n_target, round(avg(similarity) + 1e-10, 6) mean_similarity from k join post_profile on query_id = profile_id group by 1",
        "pairwise_similarity_stats": "with p as (select list_cosine_similarity(a.embedding::double[], b.embedding::double[]) s from embeddings a join embeddings b on a.vec_id < b.vec_id) select (select count(*) from embeddings) n, round(avg(s), 6) mean, round(stddev_pop(s), 6) std, round(min(s), 6) min, round(max(s), 6) max from p",
        "weighted_concat": f"""
with v as materialized (select profile_id, list_transform(hybrid_vector, lambda x: coalesce(x, 0)) h, list_concat(list_transform(structural_vector, lambda x: coalesce(x, 0) * 0.5::double), list_transform(semantic_vector::double[], lambda x: coalesce(x, 0) * 0.5::double)) w from post_profile where {two} and {_ok('hybrid_vector', 78)}),
x as (select *, list_sum(list_transform(h, lambda x: x * x)) hh, list_sum(list_transform(w, lambda x: x * x)) ww, list_sum(list_transform(generate_series(1, 78), lambda i: h[i] * w[i])) hw from v)
select profile_id, round(list_max(list_transform(generate_series(1, 78), lambda i: abs(h[i] - w[i]))), 5) gap, round(sqrt(hh) + 1e-10, 6) norm, round(hw / sqrt(hh * ww) + 1e-10, 6) cosine from x""",
        "context_w0": _ctx(0),
        "context_w1": _ctx(1),
        "context_w2": _ctx(2),
        "context_format": f"with x as ({_context(1)}), y as (select row_id, {_part('Earlier posts in this timeline:', 'b')} p, {_part('Later posts in this timeline:', 'a')} q from x) select row_id, p || case when p <> '' and q <> '' then chr(10) else '' end || q as block from y",
        "context_positions": f"""
with x as ({_context(2)} ), y as (select row_id, list_concat(list_transform(b, lambda p: struct_pack(i := p.i, t := p.t, w := 'before')), list_transform(a, lambda p: struct_pack(i := p.i, t := p.t, w := 'after'))) c from x where (well_being_score is not null and well_being_score <> 'NONE') or (post_summary is not null and post_summary <> 'NONE')),
z as (select row_id, generate_subscripts(c, 1) - 1 pos, unnest(c) c from y)
select row_id, cast(pos as int) pos, c.i post_index, c.w as position, cast(length(c.t) as int) n_chars from z""",
        "timeline_prompts": f"with t as (select timeline_id, string_agg(coalesce(post, ''), chr(10) || chr(10) order by row_id) x from post_data group by 1) select timeline_id, {_TL} || 'Timeline Summary :' || chr(10) as official, {_TL} || {_JSON} as blue from t",
        "timeline_texts": "select timeline_id, count(*) n_posts, min(row_id) first_row, string_agg(coalesce(post, ''), chr(10) || chr(10) order by row_id) as text from post_data group by 1",
        "timeline_ids": "select timeline_id, count(distinct t) n_tables, count(*) n_rows from (select timeline_id, 0 t from timeline_data union all select timeline_id, 1 from post_data union all select timeline_id, 2 from task_c_baseline) where timeline_id is not null group by 1",
        "load_counts": "select count(*) n_posts, count(distinct timeline_id) n_timelines, count(*) filter (where (well_being_score is not null and well_being_score <> 'NONE') or (post_summary is not null and post_summary <> 'NONE')) n_annotated, count(*) filter (where length(coalesce(post, '')) = 0) n_empty from post_data",
        "presence_profile": f"with {_PRES} select timeline_id, post_index, array_to_string(d, '') dims, n n_spans, round(ratio + 1e-10, 6) adaptive_ratio from pres",
        "structural_vectors": f"with {_RAW} select profile_id, array_to_string(d, '') dims, round(w + 1e-10, 6) wellbeing_dim, round(r + 1e-10, 6) ratio_dim, case when n > 0 then round(w / n + 1e-10, 6) end wellbeing_unit, case when n > 0 then round(r / n + 1e-10, 6) end ratio_unit from nrm",
        "profile_analysis": f"with {_RAW} select count(*) n_profiles, count(distinct d) n_distinct, round(avg(list_sum(d)), 6) avg_active, round(avg(wellbeing), 6) wellbeing_mean, round(stddev_pop(wellbeing), 6) wellbeing_std, min(wellbeing) wellbeing_min, max(wellbeing) wellbeing_max, round(avg(r), 6) ratio_mean, round(stddev_pop(r), 6) ratio_std from nrm",
        "accuracy_by_polarity": f"with {_LAB} select case when grouping(g) = 1 then 'all' else g end grp, count(*) n, count(*) filter (where gold = pred) n_correct, count(*) filter (where pred = 'UNKNOWN') n_unknown, round(count(*) filter (where gold = pred)::double / count(*) + 1e-10, 6) accuracy from (select *, coalesce(polarity, '') g from pr) group by rollup(g)",
        "macro_f1": f"with {_LAB}, {_F1} select round(avg(fx) + 1e-10, 6) macro_f1 from f",
        "macro_f1_orders": """
with r as (select o_orderpriority gold, case when o_totalprice < 100000 then '1-URGENT' when o_totalprice < 200000 then '2-HIGH' when o_totalprice < 300000 then '3-MEDIUM' when o_totalprice < 400000 then '5-LOW' else 'UNKNOWN' end pred from orders),
k as (select unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', '6-ABSENT']) as lab),
c as (select lab, count(case when gold = lab and pred = lab then 1 end) tp, count(case when gold <> lab and pred = lab then 1 end) fp, count(case when gold = lab and pred <> lab then 1 end) fn from k, r group by lab)
select round(avg(case when 2 * tp + fp + fn = 0 then 0.0 else 2.0 * tp::double / (2 * tp + fp + fn) end) + 1e-10, 6) macro_f1 from c""",
        "classification_report": f"""
with {_LAB}, {_F1}
select label, p as precision, r as recall, f1, s support from f
union all select 'macro avg', round(avg(p) + 1e-10, 6), round(avg(r) + 1e-10, 6), round(avg(f1) + 1e-10, 6), cast(sum(s) as bigint) from f
union all select 'weighted avg', round(sum(p * s) / sum(s) + 1e-10, 6), round(sum(r * s) / sum(s) + 1e-10, 6), round(sum(f1 * s) / sum(s) + 1e-10, 6), cast(sum(s) as bigint) from f
union all select case when m then 'micro avg' else 'accuracy' end, case when m then round(coalesce(tp / nullif(tp + fp, 0), 0) + 1e-10, 6) end, case when m then round(coalesce(tp / nullif(tp + fn, 0), 0) + 1e-10, 6) end, case when m then round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + 1e-10, 6) else round(a + 1e-10, 6) end, case when m then cast(s as bigint) else n end
from (select sum(tp)::double tp, sum(fp)::double fp, sum(fn)::double fn, sum(tp + fn) s from c), (select count(*) n, count(*) filter (where gold = pred)::double / count(*) a, count(*) filter (where gold is null or pred is null or gold not in ('A','B-O','B-S','C-O','C-S','D') or pred not in ('A','B-O','B-S','C-O','C-S','D')) > 0 m from pr)""",
        "running_accuracy": _running("(select span_id, coalesce(cast(gold_abcd_key = predicted_abcd_key as int), 0)::double h from evidence_span)", "span_id", "h", 25),
        "pair_metrics_zero_shot": f"with {_mode('zero_shot')} select id result_id, round(cs + 1e-10, 6) cs, round(ct + 1e-10, 6) ct, round(ea + 1e-10, 6) ea from pm",
        "pair_metrics_one_shot": f"with {_mode('one_shot')} select id result_id, round(cs + 1e-10, 6) cs, round(ct + 1e-10, 6) ct, round(ea + 1e-10, 6) ea from pm",
        "corpus_means": f"with {_mode('zero_shot')} select 'zero_shot' as mode, {_MEANS} from pm union all (with {_mode('one_shot')} select 'one_shot' as mode, {_MEANS} from pm)",
        "mode_delta": f"""
with z as (with {_mode('zero_shot')} select {_MEANS} from pm), o as (with {_mode('one_shot')} select {_MEANS} from pm),
x as (select unnest(['consistency', 'contradiction', 'evidence_alignment']) metric, unnest([z.consistency, z.contradiction, z.evidence_alignment]) zero_shot, unnest([o.consistency, o.contradiction, o.evidence_alignment]) one_shot from z, o)
select metric, zero_shot, one_shot, round(one_shot - zero_shot + 1e-10, 6) delta, case when one_shot is null or zero_shot is null then null when (metric = 'contradiction' and one_shot < zero_shot) or (metric <> 'contradiction' and one_shot > zero_shot) then '+' else '-' end better from x""",
        "running_consistency": f"with {_mode('zero_shot')} " + "select p as position, round(s / p + 1e-10, 6) consistency, round(t / p + 1e-10, 6) contradiction from (select row_number() over (order by id) p, sum(cs) over (order by id rows unbounded preceding) s, sum(ct) over (order by id rows unbounded preceding) t from pm) where p % 10 = 0",
        "timeline_metrics": "with gold as (select timeline_id, timeline_summary from timeline_data where timeline_summary is not null and timeline_summary <> 'NONE' qualify row_number() over (partition by timeline_id order by row_id desc) = 1), src as (select c.row_id, c.task_c_baseline_official_summaries p, timeline_summary from task_c_baseline c join gold using (timeline_id) where length(c.task_c_baseline_official_summaries) > 0)," + _pairs("src", "row_id", "p", "timeline_summary", None) + " select id delivery_id, round(cs + 1e-10, 6) cs, round(ct + 1e-10, 6) ct from pm",
        "sentence_split": f"with s as (select doc_id, {_sentences('text')} s from documents) select doc_id, cast(generate_subscripts(s, 1) - 1 as int) pos, unnest(s) as sentence from s",
        "whitespace_normalize": f"select doc_id, {_collapse('text')} as text from documents",
        "span_highlight": f"""
with {_POSTS}, j as (select span_id, post, e.text span, {_collapse('post')} wp, {_collapse('e.text')} ws from evidence_span e join posts p on e.timeline_id = p.timeline_id and e.post_index = p.post_index)
select span_id, case when length(span) > 0 and contains(post, span) then substr(post, 1, strpos(post, span) - 1) || '«' || span || '»' || substr(post, strpos(post, span) + length(span)) when length(span) > 0 and length(ws) > 0 and contains(wp, ws) then substr(wp, 1, strpos(wp, ws) - 1) || '«' || ws || '»' || substr(wp, strpos(wp, ws) + length(ws)) else post end marked, coalesce(length(span) > 0 and (contains(post, span) or (length(ws) > 0 and contains(wp, ws))), false) as found from j""",
        "label_parse": f"with x as (select span_id, {_UP} s from evidence_span) select span_id, {_COMPAT} as label, {_STRICT} as strict_label from x",
        "span_truncate": "select span_id, substr(text, 1, 100) as text from evidence_span",
        "lenient_number": f"select row_id, {_NUMBER.format(c='well_being_score')} as value from post_data",
        "wellbeing_text": f"select profile_id, {_WBT} as label from (select profile_id, wellbeing w from post_profile)",
        "none_filled": "select row_id, coalesce(post_summary, 'NONE') post_summary, coalesce(well_being_score, 'NONE') well_being_score, coalesce(maladaptive_evidence, 'NONE') maladaptive_evidence, coalesce(adaptive_evidence, 'NONE') adaptive_evidence from post_data",
        "category_names": "select case predicted_abcd_key when 'A' then 'Affect' when 'B-O' then 'Behavior toward the Other' when 'B-S' then 'Behavior toward the Self' when 'C-O' then 'Cognition of the Other' when 'C-S' then 'Cognition of the Self' when 'D' then 'Desire' else coalesce(predicted_abcd_key, 'none') end as name, polarity, count(*) n from evidence_span group by 1, 2",
        "evidence_format": f"with {_LISTS} select timeline_id, post_index, {_EV} as block from lists",
        "zero_shot_prompts": f"with {_POSTS}, {_LISTS}, x as (select timeline_id, post_index, coalesce(post, '') post, spans, {_NUMBER.format(c='well_being_score')} w from posts join lists using (timeline_id, post_index)) select timeline_id, post_index, 'Sum up the mental state in this post.' || chr(10) || 'Post:' || chr(10) || post || chr(10) || {_EV} || chr(10) || 'Well-being (1-10): ' || {_WBT} || chr(10) || 'Summary:' as prompt from x",
        "baseline_prompts": f"with t as (select row_id, 'Here is one post. Summarize it in a few sentences.' || chr(10) || coalesce(post, '') || chr(10) x from post_data) select row_id, x || 'Summary :' || chr(10) as prompt, x || {_JSON} as blue_prompt from t",
        "one_shot_prompts": f"""
with {_POSTS}, {_LISTS}, p as (select p.timeline_id, p.post_index, coalesce(post, '') post, post_summary, coalesce(spans, []) spans, {_NUMBER.format(c='well_being_score')} w from posts p left join lists l on p.timeline_id = l.timeline_id and p.post_index = l.post_index),
b as (select timeline_id, post_index, post || chr(10) || {_EV} || chr(10) || 'Well-being (1-10): ' || {_WBT} || chr(10) x, post_summary s from p)
select result_id, 'Example post:' || chr(10) || e.x || 'Summary: ' || e.s || chr(10) || chr(10) || 'Sum up the mental state in this post.' || chr(10) || 'Post:' || chr(10) || t.x || 'Summary:' as prompt
from task_b_results r join b t on r.timeline_id = t.timeline_id and r.post_index = t.post_index join b e on r.retrieved_timeline = e.timeline_id and r.retrieved_post_index = e.post_index where length(e.s) > 0""",
        "classification_prompts": f"""
with {_POSTS}, j as (select span_id, post, e.text span, polarity, upper(polarity[1]) || lower(polarity[2:]) state, {_collapse('post')} wp, {_collapse('e.text')} ws from evidence_span e join posts p on e.timeline_id = p.timeline_id and e.post_index = p.post_index where length(e.text) > 0 and polarity is not null and post is not null),
m as (select *, case when contains(post, span) then substr(post, 1, strpos(post, span) - 1) || '«' || span || '»' || substr(post, strpos(post, span) + length(span)) when length(ws) > 0 and contains(wp, ws) then substr(wp, 1, strpos(wp, ws) - 1) || '«' || ws || '»' || substr(wp, strpos(wp, ws) + length(ws)) else post end marked, contains(post, span) or (length(ws) > 0 and contains(wp, ws)) f from j)
select span_id, 'Which key fits the passage? It shows an ' || state || ' state.' || chr(10) || case when polarity = 'adaptive' then {_hints('adaptive')} else {_hints('maladaptive')} end || chr(10) || case when f then 'The post, with the passage between « and »:' else 'The post:' end || chr(10) || marked || chr(10) || 'Passage (' || state || '): ' || span || chr(10) || 'Key:' as prompt from m""",
        "submission_documents": f"""
with {_POSTS}, {_LAST}, ev as (select timeline_id, post_index, list(text order by span_id) filter (where polarity = 'adaptive') a, list(text order by span_id) filter (where polarity = 'maladaptive') m from evidence_span where timeline_id is not null and length(text) > 0 group by 1, 2),
p as (select p.timeline_id, p.post_id, coalesce(a, []) a, coalesce(m, []) m, coalesce(zero_shot_summary, '') s, {_NUMBER.format(c='well_being_score')} w from posts p left join res r on p.timeline_id = r.timeline_id and p.post_index = r.post_index left join ev on p.timeline_id = ev.timeline_id and p.post_index = ev.post_index where p.post_id is not null qualify row_number() over (partition by p.timeline_id, p.post_id order by p.row_id desc) = 1)
select timeline_id, '{{"timeline_level":{{"summary":""}},"post_level":{{' || string_agg(to_json(post_id)::varchar || ':{{"adaptive_evidence":' || to_json(a)::varchar || ',"maladaptive_evidence":' || to_json(m)::varchar || ',"summary":' || to_json(s)::varchar || ',"wellbeing_score":' || coalesce(to_json(w)::varchar, 'null') || '}}', ',' order by post_id) || '}}}}' as document from p group by 1""",
        "lookup_default_fill": f"with {_POSTS}, {_LAST} select p.timeline_id, p.post_index, p.post_id, coalesce(zero_shot_summary, '') as summary from posts p left join res r on p.timeline_id = r.timeline_id and p.post_index = r.post_index",
        "lookup_inner": f"with {_POSTS} select b.row_id, b.post_id, p.timeline_id tl, p.post_index ix, source from task_b_baseline b join posts p using (post_id)",
        "orphan_results": f"with {_POSTS} select profile_id from post_profile x where not exists (select 1 from posts p where p.timeline_id = x.timeline_id and p.post_index = x.post_index)",
        "retrieved_examples": f"with {_POSTS} select result_id, p.post_id example_id from task_b_results r left join posts p on r.retrieved_timeline = p.timeline_id and r.retrieved_post_index = p.post_index",
        "eligible_posts": f"with {_POSTS} select timeline_id, post_index, post_id from posts p where post_summary <> 'NONE' and length(post_summary) > 0 and exists (select 1 from evidence_span e where e.timeline_id = p.timeline_id and e.post_index = p.post_index)",
        "evaluable_rows": f"with {_POSTS} select count(*) filter (where length(gold_summary) > 0 and length(zero_shot_summary) > 0) n_zero_shot, count(*) filter (where length(gold_summary) > 0 and length(one_shot_summary) > 0) n_one_shot, (select count(*) from task_b_baseline b join posts p using (post_id) where p.post_summary <> 'NONE' and task_b_baseline_official_summaries is not null) n_baseline from task_b_results",
    }
