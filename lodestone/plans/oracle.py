"""The queries of this package as DuckDB SQL, put together from common table expressions."""

from __future__ import annotations

import re

from lodestone.functions.text import STOPWORDS
from lodestone.operators.augment import PREFIXES, SUFFIXES
from lodestone.operators.retrieval import FEATURES, WEIGHTS
from lodestone.plans.queries import LABELS, MARKERS, MIN_DF, SYNONYMS

SEPARATORS = r"""[\s\p{Z}\x0B\x1c-\x1f,，。！？!?、；;：:（）()\[\]【】"''“”‘’—\-_/\\|~`@#$%^&*+=<>《》…·]+"""


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def rounded(x: str, places: int = 4) -> str:
    return f"(floor(({x}) * {10**places} + 0.5) / {float(10**places)})"


def tokens(x: str) -> str:
    x = f"coalesce({x}, '')"
    spelled = "flatten(list_transform(range(1, len(string_split(c, '')) + 1), lambda i: CASE WHEN i < len(c) THEN [string_split(c, '')[i], string_split(c, '')[i] || string_split(c, '')[i + 1]] ELSE [string_split(c, '')[i]] END))"
    chunks = f"list_filter(regexp_split_to_array(lower({x}), '{SEPARATORS}'), lambda c: c <> '')"
    words = f"flatten(list_transform({chunks}, lambda c: CASE WHEN regexp_full_match(c, '[a-z0-9.]+') THEN [c] ELSE {spelled} END))"
    numbers = f"list_transform(regexp_extract_all({x}, '\\p{{Nd}}+'), lambda d: '#' || d)"
    return f"list_concat(list_filter({words}, lambda w: w NOT IN ({quoted(STOPWORDS)})), {numbers})"


def grams(x: str, n: int = 2) -> str:
    s = f"regexp_replace(coalesce({x}, ''), '{SEPARATORS}', '', 'g')"
    runs = f"(SELECT list_transform(range(1, len(cs) - {n - 2}), lambda i: array_to_string(cs[i:i + {n - 1}], '')) FROM (SELECT string_split({s}, '') AS cs))"
    if n == 2:
        runs = f"(SELECT list_transform(range(1, len(cs)), lambda i: cs[i] || cs[i + 1]) FROM (SELECT string_split({s}, '') AS cs))"
    return f"CASE WHEN {s} = '' THEN []::VARCHAR[] WHEN len({s}) < {n} THEN [{s}] ELSE {runs} END"


def content(ts: str) -> str:
    return f"list_distinct(list_filter({ts}, lambda t: t NOT LIKE '#%'))"


_fits = lambda m: f"strpos(q, '{m}') > 1 AND strpos(q, '{m}') - 1 + {len(m)} < len(q) - 1"
_case = lambda part: "CASE " + " ".join(f"WHEN {_fits(m)} THEN {part(m)}" for m in MARKERS) + " END"
HEAD = _case(lambda m: f"q[1:strpos(q, '{m}') - 1]")
TAIL = _case(lambda m: f"q[strpos(q, '{m}') + {len(m)}:]")
IDF = "ln((1.0 + n_docs) / (1.0 + df)) + 1.0"
LABEL_ROWS = ", ".join(f"({i}, '{x}')" for i, x in enumerate(LABELS))


def _feature(name: str) -> str:
    return {"title": "title_hit", "cat": "cat_hit", "helpful": "helpful_hit"}.get(name, name)


_score = f"sim * {WEIGHTS['sim']}::DOUBLE" + "".join(f" + {_feature(n)} * {WEIGHTS[n]}::DOUBLE" for n in FEATURES[1:])


def _draw(name: str) -> str:
    return f"concat('0x', substr(md5('20260101|' || pass || '|' || doc_id || '|{name}'), 1, 8))::BIGINT"


def _pick(name: str, choices) -> str:
    return f"[{quoted(choices)}][{_draw(name)} % {len(choices)} + 1]"


def _augmented() -> str:
    s = "text"
    steps = "SELECT doc_id, label_id, pass, text AS s FROM e, (SELECT unnest([1, 2, 3]) AS pass)"
    for i, (old, new) in enumerate(SYNONYMS):
        steps = f"SELECT doc_id, label_id, pass, CASE WHEN strpos(s, '{old}') > 0 AND {_draw(f's{i}')} < {int(0.4 * 2**32)} THEN s[1:strpos(s, '{old}') - 1] || '{new}' || s[strpos(s, '{old}') + {len(old)}:] ELSE s END AS s FROM ({steps})"
    return f"SELECT doc_id, pass, label_id, {_pick('p', PREFIXES)} || s || {_pick('q', SUFFIXES)} AS {s} FROM ({steps})"


CTES = {
    "docs": "SELECT doc_id, split_part(text, '.', 1) AS title, text, lang AS cat, source AS grp, coalesce(good, false) AS helpful FROM documents LEFT JOIN (SELECT doc_id, max(quality) = 1 AS good FROM labels GROUP BY 1) USING (doc_id)",
    "asked": "SELECT item_id AS qid, text AS q FROM benchmark",
    "n": "SELECT count(*) AS n_docs FROM documents",
    "bags": f"SELECT doc_id, {tokens('b')} AS w, {grams('b')} AS g FROM (SELECT doc_id, coalesce(title, '') || '。' || coalesce(text, '') AS b FROM docs)",
    "said": "SELECT doc_id, unnest(w) AS t, 1 AS wn FROM bags UNION ALL SELECT doc_id, unnest(g), 0 FROM bags",
    "counts": "SELECT doc_id, t, count(*) AS n, sum(wn)::BIGINT AS wn FROM said GROUP BY 1, 2",
    "vocab": f"SELECT t, df, {IDF} AS idf, wdf, CASE WHEN wdf > 0 THEN ln(1.0 + (n_docs - wdf + 0.5) / (wdf + 0.5)) END AS bidf FROM (SELECT t, count(*) AS df, count(*) FILTER (WHERE wn > 0) AS wdf FROM counts GROUP BY 1), n",
    "stats": "SELECT doc_id, sum(wn)::BIGINT AS dl, sqrt(sum(((1.0 + ln(n)) * idf) ** 2)) AS norm FROM counts JOIN vocab USING (t) GROUP BY 1",
    "average": "SELECT sum(dl) / max(n_docs) AS avg_len FROM stats, n",
    "parts": f"SELECT qid, q, {HEAD} AS head, {TAIL} AS tail FROM asked",
    "query_bags": f"SELECT qid, q, {tokens('q')} AS w, {grams('q')} AS g, {content(tokens('head'))} AS head, {content(tokens('tail'))} AS tail, head IS NOT NULL AS turns FROM parts",
    "roles": " UNION ALL ".join(f"SELECT qid, unnest({c}) AS t, '{r}' AS role FROM query_bags" for c, r in (("w", "word"), ("g", "gram"), (content("w"), "whole"), ("head", "head"), ("tail", "tail"))),
    "query_counts": "SELECT qid, t, count(*) FILTER (WHERE role = 'word') AS qn, count(*) FILTER (WHERE role = 'gram') AS gn, bool_or(role = 'whole') AS whole, bool_or(role = 'head') AS head, bool_or(role = 'tail') AS tail FROM roles GROUP BY 1, 2",
    "query_raw": "SELECT c.*, bidf, CASE WHEN qn + gn > 0 THEN (1.0 + ln(qn + gn)) * idf END AS raw FROM query_counts c LEFT JOIN vocab USING (t)",
    "query_tokens": "SELECT qid, t, qn, whole, head, tail, bidf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY qid)) AS qw FROM query_raw",
    "query_stats": "SELECT qid, CASE WHEN sum(qn) > 0 THEN greatest(sum(CASE WHEN qn > 0 THEN coalesce(bidf, 0.0) END) * 2.5, 1e-6) ELSE 1.0 END AS most, count(*) FILTER (WHERE whole) AS n_whole, count(*) FILTER (WHERE head) AS n_head, count(*) FILTER (WHERE tail) AS n_tail FROM query_tokens GROUP BY 1",
    "raw_matches": """SELECT qid, doc_id, coalesce(sum(qw * (1.0 + ln(n)) * idf / norm), 0.0) AS sim,
      coalesce(sum(CASE WHEN wn > 0 AND qn > 0 THEN qn * q.bidf * (wn * 2.5) / (wn + 1.5 * (1 - 0.75 + 0.75 * dl / avg_len)) END), 0.0) AS bm25_raw,
      count(*) FILTER (WHERE whole AND wn > 0) AS hit_whole, count(*) FILTER (WHERE head AND wn > 0) AS hit_head, count(*) FILTER (WHERE tail AND wn > 0) AS hit_tail
      FROM counts c JOIN query_tokens q USING (t) JOIN vocab v USING (t) JOIN stats USING (doc_id), average GROUP BY 1, 2""",
    "matches": f"SELECT qid, doc_id, {rounded('sim')} AS sim, {rounded('bm25_raw', 3)} AS bm25_raw, {rounded('least(bm25_raw / most, 1.0)')} AS bm25, hit_whole, hit_head, hit_tail FROM raw_matches JOIN query_stats USING (qid)",
    "pairs": f"SELECT *, {rounded('0.45::DOUBLE * sim + 0.12::DOUBLE * bm25')} AS recall_score FROM (SELECT qid, doc_id, coalesce(sim, 0.0) AS sim, coalesce(bm25_raw, 0.0) AS bm25_raw, coalesce(bm25, 0.0) AS bm25, coalesce(hit_whole, 0) AS hit_whole, coalesce(hit_head, 0) AS hit_head, coalesce(hit_tail, 0) AS hit_tail FROM (SELECT qid, doc_id FROM asked, documents) LEFT JOIN matches USING (qid, doc_id))",
    "pool": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY recall_score DESC, doc_id) AS recall_rank FROM pairs) WHERE recall_rank <= 10",
    "title_bags": f"SELECT doc_id, {content(tokens('title'))} AS title_words, list_distinct({grams('title')}) AS title_grams FROM docs WHERE doc_id IN (SELECT doc_id FROM pool)",
    "doc_words": "SELECT doc_id, list(t) AS words FROM counts WHERE wn > 0 AND doc_id IN (SELECT doc_id FROM pool) GROUP BY 1",
    "pool_raw": f"""SELECT p.*, d.title, d.grp, d.cat, d.helpful, q.q, turns, n_whole, n_head, n_tail, words, {content('w')} AS said_words,
      CASE WHEN len({content('w')}) = 0 THEN 0.0 ELSE len(list_intersect({content('w')}, title_words)) / len({content('w')}) END AS tc,
      CASE WHEN len(g) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(g), title_grams)) / len(list_distinct(g)) END AS tg
      FROM pool p JOIN docs d USING (doc_id) JOIN query_bags q USING (qid) JOIN query_stats USING (qid) JOIN title_bags USING (doc_id) LEFT JOIN doc_words USING (doc_id)""",
    "feats": f"""SELECT *, CASE WHEN n_whole = 0 THEN 0.0 ELSE {rounded('hit_whole / n_whole')} END AS coverage, {rounded('tc')} AS title_cover, {rounded('tg')} AS gram_overlap,
      {rounded('0.6::DOUBLE * tc + 0.4::DOUBLE * tg')} AS title_hit, (strpos(q, cat) > 0)::INT::DOUBLE AS cat_hit, helpful::INT::DOUBLE AS helpful_hit,
      CASE WHEN turns THEN {rounded('CASE WHEN n_tail = 0 THEN 0.0 ELSE hit_tail / n_tail END - CASE WHEN n_head = 0 THEN 0.0 ELSE hit_head / n_head END')} ELSE 0.0 END AS clause FROM pool_raw""",
    "dups": "SELECT *, row_number() OVER (PARTITION BY qid, grp ORDER BY recall_score DESC, doc_id) - 1 AS dup_count FROM feats",
    "scored": f"SELECT *, {rounded(_score + ' - dup_count * 0.08::DOUBLE')} AS final_score FROM dups",
    "ranked": "SELECT *, recall_rank - final_rank AS rank_delta FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final_score DESC, doc_id) AS final_rank FROM scored)",
    "fused": f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, doc_id) AS rrf_rank FROM (SELECT *, {rounded('1.0 / (60 + sim_rank) + 1.0 / (60 + bm25_rank)', 10)} AS rrf FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, recall_rank) AS sim_rank, row_number() OVER (PARTITION BY qid ORDER BY bm25_raw DESC, recall_rank) AS bm25_rank FROM pool))",
    "gold": "SELECT item_id AS qid, list_sort(list(DISTINCT source)) AS gold FROM benchmark b JOIN documents d ON contains(d.text, substring(b.text, 10, 40)) WHERE substring(b.text, 10, 40) <> '' GROUP BY 1",
    "base_list": "SELECT qid, doc_id, recall_rank AS rank, grp, title FROM pool JOIN docs USING (doc_id) WHERE qid IN (SELECT qid FROM gold)",
    "rerank_list": "SELECT qid, doc_id, final_rank AS rank, grp, title FROM ranked WHERE final_rank <= 5 AND qid IN (SELECT qid FROM gold)",
    "sim_list": "SELECT qid, doc_id, rank, grp FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, doc_id) AS rank FROM pool) JOIN docs USING (doc_id) WHERE rank <= 5 AND qid IN (SELECT qid FROM gold)",
    "rrf_list": "SELECT qid, doc_id, rrf_rank AS rank, grp FROM fused JOIN docs USING (doc_id) WHERE rrf_rank <= 5 AND qid IN (SELECT qid FROM gold)",
    "base_hits": "SELECT *, hit AND row_number() OVER (PARTITION BY qid, grp ORDER BY rank) = 1 AS new FROM (SELECT *, list_contains(gold, grp) AS hit FROM base_list JOIN gold USING (qid))",
    "rerank_hits": "SELECT *, hit AND row_number() OVER (PARTITION BY qid, grp ORDER BY rank) = 1 AS new FROM (SELECT *, list_contains(gold, grp) AS hit FROM rerank_list JOIN gold USING (qid))",
    "sim_hits": "SELECT *, hit AND row_number() OVER (PARTITION BY qid, grp ORDER BY rank) = 1 AS new FROM (SELECT *, list_contains(gold, grp) AS hit FROM sim_list JOIN gold USING (qid))",
    "rrf_hits": "SELECT *, hit AND row_number() OVER (PARTITION BY qid, grp ORDER BY rank) = 1 AS new FROM (SELECT *, list_contains(gold, grp) AS hit FROM rrf_list JOIN gold USING (qid))",
    "tops": """SELECT g.qid, g.gold, coalesce(r.title, '') AS top1, coalesce(r.hit, false) AS top1_hit, coalesce(b.title, '') AS baseline_top1, coalesce(b.hit, false) AS baseline_top1_hit,
      (SELECT min(rank) FROM rerank_hits x WHERE x.qid = g.qid AND x.hit) AS rank_of_gold FROM gold g LEFT JOIN (SELECT * FROM rerank_hits WHERE rank = 1) r USING (qid) LEFT JOIN (SELECT * FROM base_hits WHERE rank = 1) b USING (qid)""",
    "labs": f"SELECT * FROM (VALUES {LABEL_ROWS}) v(label_id, label)",
    "e": "SELECT doc_id, text, label_id FROM documents JOIN labs ON lang = label",
    "word_sets": f"SELECT doc_id, label_id, doc_id % 5 <> 0 AS fit, unnest(list_distinct(ts)) AS t FROM (SELECT doc_id, label_id, {tokens('text')} AS ts FROM e)",
    "class_counts": "SELECT label_id, t, count(*) AS n FROM word_sets WHERE fit GROUP BY 1, 2",
    "fit_n": "SELECT count(*) AS n_docs FROM e WHERE doc_id % 5 <> 0",
    "class_idf": f"SELECT t, {IDF} AS idf FROM (SELECT t, sum(n) AS df FROM class_counts GROUP BY 1), fit_n",
    "keywords": "SELECT * FROM (SELECT label_id, t, idf, row_number() OVER (PARTITION BY label_id ORDER BY n * idf DESC, t) AS place FROM class_counts JOIN class_idf USING (t)) WHERE place <= 12",
    "kscores": f"SELECT doc_id, label_id, {rounded('coalesce(score, 0.0)', 6)} AS score FROM (SELECT doc_id, l.label_id FROM e, labs l) LEFT JOIN (SELECT doc_id, k.label_id, sum(idf) AS score FROM word_sets w JOIN keywords k ON k.t = w.t GROUP BY 1, 2) USING (doc_id, label_id)",
    "kproba": "SELECT doc_id, label_id, x / sum(x) OVER (PARTITION BY doc_id) AS p FROM (SELECT *, exp((score - top) / greatest(top, 1e-6)) AS x FROM (SELECT *, CASE WHEN max(score) OVER (PARTITION BY doc_id) = 0 THEN 1.0 ELSE max(score) OVER (PARTITION BY doc_id) END AS top FROM kscores))",
    "kpred": f"SELECT doc_id, max(label_id) FILTER (WHERE r = 1) AS pred, max(label) FILTER (WHERE r = 1) AS label, {rounded('max(p) FILTER (WHERE r = 1)')} AS confidence, {rounded('max(p) FILTER (WHERE r = 1) - max(p) FILTER (WHERE r = 2)')} AS margin, string_agg(label, ' ' ORDER BY r) AS top3 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, label_id) AS r FROM kproba) JOIN labs USING (label_id) WHERE r <= 3 GROUP BY 1",
    "judged": "SELECT k.*, label_id FROM kpred k JOIN e USING (doc_id) WHERE doc_id % 5 = 0",
    "per_class": "SELECT label_id, label, tp, support, said, CASE WHEN said = 0 THEN 0.0 ELSE tp / said END AS p, CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS r FROM (SELECT label_id, label, (SELECT count(*) FROM judged j WHERE j.label_id = l.label_id AND pred = l.label_id) AS tp, (SELECT count(*) FROM judged j WHERE j.label_id = l.label_id) AS support, (SELECT count(*) FROM judged j WHERE j.pred = l.label_id) AS said FROM labs l)",
    "class_f1": "SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM per_class",
    "chat": "SELECT concat_ws(':', conv_id, turn) AS doc_id, text FROM conversations",
    "chat_scores": f"SELECT doc_id, label_id, {rounded('coalesce(score, 0.0)', 6)} AS score FROM (SELECT doc_id, label_id FROM chat, labs) LEFT JOIN (SELECT doc_id, k.label_id, sum(idf) AS score FROM (SELECT doc_id, unnest(list_distinct({tokens('text')})) AS t FROM chat) w JOIN keywords k USING (t) GROUP BY 1, 2) USING (doc_id, label_id)",
    "chat_proba": "SELECT doc_id, label_id, x / sum(x) OVER (PARTITION BY doc_id) AS p FROM (SELECT *, exp((score - top) / greatest(top, 1e-6)) AS x FROM (SELECT *, CASE WHEN max(score) OVER (PARTITION BY doc_id) = 0 THEN 1.0 ELSE max(score) OVER (PARTITION BY doc_id) END AS top FROM chat_scores))",
    "chat_pred": f"SELECT doc_id, max(label) FILTER (WHERE r = 1) AS label, {rounded('max(p) FILTER (WHERE r = 1)')} AS confidence, {rounded('max(p) FILTER (WHERE r = 1) - max(p) FILTER (WHERE r = 2)')} AS margin FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, label_id) AS r FROM chat_proba) JOIN labs USING (label_id) GROUP BY 1",
    "word_counts": f"SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest({tokens('text')}) AS t FROM e) GROUP BY 1, 2",
    "word_vocab": f"SELECT t, {IDF} AS idf FROM (SELECT t, count(*) AS df FROM word_counts WHERE doc_id % 5 <> 0 GROUP BY 1 HAVING count(*) >= {MIN_DF}), fit_n",
    "unit": "SELECT doc_id, t, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS x FROM (SELECT doc_id, t, (1.0 + ln(n)) * idf AS raw FROM word_counts JOIN word_vocab USING (t))",
    "augmented": _augmented(),
    "turns": f"SELECT conv_id, turn, {tokens('text')} AS ts FROM conversations",
    "turn_counts": "SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(ts) AS t FROM turns) GROUP BY 1, 2, 3",
    "units": "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings",
}


def sql(final: str) -> str:
    """final with the expressions it needs, in order; those used more than once are computed once."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN|,)\s+(\w+)", text):
            if name in CTES and name not in wanted:
                need(CTES[name])
                wanted.append(name) if name not in wanted else None

    need(final)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in wanted) + "\n" if wanted else "") + final


def _metrics(source: str, ks, extra: str) -> str:
    per = ", ".join(f"coalesce((first_hit <= {k})::INT::DOUBLE, 0.0) AS recall_{k}, {rounded(f'dcg_{k} / ideal_{k}', 6)} AS ndcg_{k}" for k in ks)
    sums = ", ".join(f"coalesce(sum(1.0 / log2(rank + 1.0)) FILTER (WHERE new AND rank <= {k}), 0.0) AS dcg_{k}, any_value((SELECT sum(1.0 / log2(i + 1.0)) FROM unnest(range(1, least(len(g.gold), {k}) + 1)) u(i))) AS ideal_{k}" for k in ks)
    inner = f"SELECT g.qid, min(rank) FILTER (WHERE hit) AS first_hit, {sums} FROM gold g LEFT JOIN {source} h ON h.qid = g.qid GROUP BY 1"
    each = f"SELECT qid, {per}, coalesce({rounded('1.0 / first_hit', 6)}, 0.0) AS mrr, first_hit FROM ({inner})"
    if extra == "per query":
        return each
    means = ", ".join(f"coalesce({rounded(f'avg({m}_{k})')}, 0.0) AS {m}_{k}" for k in ks for m in ("recall", "ndcg"))
    return f"SELECT count(*) AS n_queries, {means}, coalesce({rounded('avg(mrr)')}, 0.0) AS mrr, {extra} FROM ({each})"


FINAL = {
    "tokenize": f"SELECT doc_id, len(ts)::BIGINT AS n_tokens, md5(array_to_string(ts, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tokens('text')} AS ts FROM documents)",
    "char_ngrams": f"SELECT qid, len(g2)::BIGINT AS n2, md5(array_to_string(g2, ' ')) AS g2_md5, md5(array_to_string(g3, ' ')) AS g3_md5 FROM (SELECT qid, {grams('q')} AS g2, {grams('q', 3)} AS g3 FROM asked)",
    "token_counts": "SELECT doc_id, t, n, wn FROM counts",
    "doc_freq_idf": f"SELECT t, df, {rounded('idf', 6)} AS idf FROM vocab",
    "bm25_idf": f"SELECT t, wdf, {rounded('bidf', 6)} AS bidf FROM vocab WHERE wdf > 0",
    "tfidf_weights": f"SELECT qid, t, {rounded('qw', 6)} AS w FROM query_tokens WHERE qw IS NOT NULL",
    "tfidf_norms": f"SELECT doc_id, dl, {rounded('norm')} AS norm FROM stats",
    "vocabulary_min_df": f"SELECT t, df, row_number() OVER (ORDER BY t) - 1 AS place FROM (SELECT t, wdf AS df FROM vocab WHERE wdf >= {MIN_DF})",
    "cosine_topk": "SELECT qid, doc_id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, doc_id) AS rank FROM pool) WHERE rank <= 5",
    "bm25_scores": "SELECT qid, doc_id, bm25_raw, bm25, sim FROM matches",
    "recall_pool": "SELECT qid, doc_id, recall_rank, recall_score, sim, bm25, bm25_raw FROM pool",
    "features": "SELECT qid, doc_id, sim, bm25, coverage, title_cover, gram_overlap, title_hit, cat_hit, helpful_hit, clause FROM feats",
    "covered_missed_terms": "SELECT qid, doc_id, array_to_string(list_sort(list_intersect(said_words, coalesce(words, []))), ' ') AS covered, array_to_string(list_sort(list_filter(said_words, lambda t: NOT list_contains(coalesce(words, []), t)))[1:6], ' ') AS missed FROM feats",
    "contrast_split": "SELECT qid, head, tail FROM parts",
    "rerank_topk": "SELECT qid, doc_id, grp, final_rank, final_score, recall_score, dup_count, rank_delta FROM ranked WHERE final_rank <= 5",
    "contrib": "SELECT qid, doc_id, " + ", ".join(f"{rounded(f'{_feature(n)} * {WEIGHTS[n]}::DOUBLE')} AS c_{n}" for n in FEATURES) + " FROM ranked WHERE final_rank <= 5",
    "recall_only": "SELECT qid, doc_id, recall_score AS final_score, recall_rank AS final_rank, 0::BIGINT AS rank_delta, 0::BIGINT AS n_contrib FROM pool WHERE recall_rank <= 5",
    "rrf_fusion": "SELECT qid, doc_id, rrf, rrf_rank FROM fused WHERE rrf_rank <= 5",
    "gold_groups": "SELECT qid, array_to_string(gold, ' ') AS gold FROM gold",
    "hit_flags": "SELECT qid, doc_id, rank, hit, new FROM base_hits",
    "query_metrics": _metrics("rerank_hits", (1, 3, 5), "per query"),
    "eval_summary": _metrics("base_hits", (1, 3, 5), "'baseline' AS arm") + " UNION ALL " + _metrics("rerank_hits", (1, 3, 5), "'rerank' AS arm"),
    "rank_flips": "SELECT count(*) FILTER (WHERE top1 <> baseline_top1) AS n, count(*) FILTER (WHERE top1 <> baseline_top1 AND top1_hit AND NOT baseline_top1_hit) AS improved, count(*) FILTER (WHERE top1 <> baseline_top1 AND NOT top1_hit AND baseline_top1_hit) AS worsened, count(*) FILTER (WHERE top1 = baseline_top1) AS unchanged FROM tops",
    "per_query_report": "SELECT qid, array_to_string(gold, ' ') AS gold, top1, top1_hit, baseline_top1, baseline_top1_hit, rank_of_gold FROM tops",
    "failed_queries": "SELECT qid FROM tops WHERE NOT top1_hit",
    "three_strategies": " UNION ALL ".join(_metrics(f"{n}_hits", (1, 3, 5, 10), f"'{n}' AS strategy") for n in ("sim", "rrf", "rerank")),
    "keyword_table": f"SELECT label_id, t, {rounded('idf', 6)} AS idf, place FROM keywords",
    "keyword_scores": "SELECT doc_id, label_id, score FROM kscores",
    "keyword_proba": f"SELECT doc_id, label_id, {rounded('p', 6)} AS p FROM kproba",
    "keyword_predict": "SELECT doc_id, pred, label, confidence, margin, top3 FROM kpred",
    "action_policy": "SELECT doc_id, label, confidence, margin, CASE WHEN confidence >= 0.7 AND margin >= 0.35 THEN 'auto' WHEN confidence >= 0.45 THEN 'assist' ELSE 'human' END AS action FROM chat_pred",
    "class_report": f"SELECT label_id, label, {rounded('p')} AS precision, {rounded('r')} AS recall, {rounded('f1')} AS f1, support FROM class_f1",
    "report_summary": f"""SELECT n, {rounded('h / greatest(n, 1)')} AS accuracy, CASE WHEN n = 0 THEN 0.0 ELSE {rounded('greatest(0.0, c - w)')} END AS ci_low, CASE WHEN n = 0 THEN 1.0 ELSE {rounded('least(1.0, c + w)')} END AS ci_high,
      (SELECT {rounded('avg(f1)')} FROM class_f1) AS macro_f1, mean_confidence FROM (SELECT *, (p + 1.96::DOUBLE * 1.96 / (2 * n)) / (1 + 1.96::DOUBLE * 1.96 / n) AS c, 1.96::DOUBLE * sqrt(p * (1 - p) / n + 1.96::DOUBLE * 1.96 / (4 * n * n)) / (1 + 1.96::DOUBLE * 1.96 / n) AS w
      FROM (SELECT *, h / n AS p FROM (SELECT count(*) AS n, count(*) FILTER (WHERE pred = label_id) AS h, {rounded('avg(confidence)')} AS mean_confidence FROM judged)))""",
    "confusion_matrix": "SELECT a.label_id AS truth, b.label_id AS predicted, (SELECT count(*) FROM judged j WHERE j.label_id = a.label_id AND j.pred = b.label_id) AS n FROM labs a, labs b",
    "wilson_ci": f"""SELECT source, success, total, {rounded('greatest(0.0, c - w)')} AS low, {rounded('least(1.0, c + w)')} AS high FROM (SELECT *, (p + 1.96::DOUBLE * 1.96 / (2 * total)) / (1 + 1.96::DOUBLE * 1.96 / total) AS c, 1.96::DOUBLE * sqrt(p * (1 - p) / total + 1.96::DOUBLE * 1.96 / (4 * total * total)) / (1 + 1.96::DOUBLE * 1.96 / total) AS w
      FROM (SELECT source, sum(quality)::BIGINT AS success, count(*) AS total, sum(quality) / count(*) AS p FROM labels JOIN documents USING (doc_id) GROUP BY 1))""",
    "kfold_assign": "SELECT doc_id, label_id, (row_number() OVER (PARTITION BY label_id ORDER BY md5('3:' || doc_id), doc_id) - 1) % 4 AS fold FROM e",
    "augment_synonyms": "SELECT doc_id, pass, label_id, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY pass, doc_id) AS turn FROM (SELECT doc_id, 0 AS pass, label_id, text FROM e UNION ALL SELECT doc_id, pass, label_id, text FROM augmented)) WHERE pass = 0 OR (turn = 1 AND trim(text) <> '')",
    "train_test_overlap": "SELECT (SELECT count(*) FROM (SELECT text FROM e WHERE doc_id % 5 <> 0 INTERSECT SELECT text FROM e WHERE doc_id % 5 = 0)) AS n_shared_texts, count(doc_id) AS n_ids, count(DISTINCT doc_id) AS n_distinct FROM documents",
    "token_f1": f"""SELECT conv_id, turn, {rounded('CASE WHEN la = 0 OR lb = 0 OR coalesce(same, 0) = 0 THEN 0.0 ELSE 2 * (same / la) * (same / lb) / (same / la + same / lb) END', 6)} AS f1 FROM (
      SELECT a.conv_id, a.turn, len(a.ts) AS la, len(b.ts) AS lb, (SELECT sum(least(x.n, y.n)) FROM turn_counts x JOIN turn_counts y ON x.t = y.t WHERE x.conv_id = a.conv_id AND x.turn = a.turn AND y.conv_id = b.conv_id AND y.turn = b.turn) AS same FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)""",
    "dense_cosine_knn": f"SELECT query_id, vec_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, {rounded('list_dot_product(a.v, b.v)', 6)} AS cosine FROM units a JOIN units b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)) WHERE rank <= 5",
    "dense_normalize": f"SELECT vec_id, {rounded('list_dot_product(v, v)', 6)} AS length, {rounded('v[1]', 5)} AS first, len(v)::BIGINT AS dim FROM units",
    "linear_scores": f"SELECT doc_id, label_id, {rounded('z', 6)} AS z, {rounded('x / sum(x) OVER (PARTITION BY doc_id)', 6)} AS p FROM (SELECT *, exp(z - max(z) OVER (PARTITION BY doc_id)) AS x FROM (SELECT doc_id, label_id, coalesce(z, 0.0) AS z FROM (SELECT doc_id, l.label_id FROM e, labs l) LEFT JOIN (SELECT doc_id, k.label_id, sum(x * idf) AS z FROM unit u JOIN keywords k USING (t) GROUP BY 1, 2) USING (doc_id, label_id)))",
    "logreg_first_step": "SELECT t, " + ", ".join(f"{rounded(f'(sum(x) / {len(LABELS)} - coalesce(sum(x) FILTER (WHERE label_id = {k}), 0.0)) / max(n_docs)', 8)} AS g_{k}" for k in range(len(LABELS))) + " FROM unit JOIN e USING (doc_id), fit_n WHERE doc_id % 5 <> 0 GROUP BY t",
    "corpus_dump": "SELECT doc_id, title, md5(text) AS text_md5, cat, grp, helpful FROM docs",
    "health": "SELECT count(*) AS tickets, count(DISTINCT lang) AS labels, 'ok' AS status FROM documents",
    "json_results": """SELECT '{"qid":' || qid || ',"doc_id":' || doc_id || ',"cat":"' || cat || '","grp":"' || grp || '"}' AS json FROM ranked WHERE final_rank = 1""",
    "search_answer": """SELECT b.qid, len(w)::BIGINT AS n_tokens, pool_size, results, coalesce(changed, '') AS changed, recall_topk FROM query_bags b
      JOIN (SELECT qid, count(*) AS pool_size, string_agg(doc_id, ' ' ORDER BY recall_rank) FILTER (WHERE recall_rank <= 5) AS recall_topk FROM pool GROUP BY 1) x ON x.qid = b.qid
      JOIN (SELECT qid, string_agg(doc_id, ' ' ORDER BY final_rank) AS results, string_agg(doc_id, ' ' ORDER BY doc_id) FILTER (WHERE rank_delta <> 0) AS changed FROM ranked WHERE final_rank <= 5 GROUP BY 1) y ON y.qid = b.qid""",
    "document_vectors": f"SELECT doc_id, t, {rounded('(1.0 + ln(n)) * idf / norm', 6)} AS w FROM counts JOIN vocab USING (t) JOIN stats USING (doc_id)",
    "request_bodies": "SELECT outcome, count(*) AS n FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'blank text' ELSE 'bad json' END AS outcome FROM events) GROUP BY 1",
}
ORACLE_SQL = {name: sql(final) for name, final in FINAL.items()}
