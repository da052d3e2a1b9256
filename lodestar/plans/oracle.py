"""SQL of the named queries, for an independent engine (DuckDB) on the same tables."""

from __future__ import annotations

from lodestar.functions import text as T

_WS = T.SPACE
_q = lambda s: s.replace("'", "''")
_in = lambda ws: ", ".join(f"'{w}'" for w in ws)


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _norm(c: str) -> str:
    for _ in range(2):
        c = f"regexp_replace(regexp_replace({c}, '{_q(T.LEADING_LABEL)}', ''), '{_q(T.LEADING_NUMBER)}', '')"
    return f"coalesce({_strip(f'regexp_replace({c}, ' + chr(39) + _WS + '+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '')"


def _tokens(c: str) -> str:
    joined = rf"regexp_replace(lower(coalesce({c}, '')), '(\d+)\(([a-zA-Z0-9])\)', '\1\2', 'g')"
    return rf"list_filter(string_split(trim(regexp_replace({joined}, '[^a-z0-9\-]+', ' ', 'g')), ' '), lambda t: t <> '' AND t NOT IN ({_in(T.RETRIEVAL_STOPWORDS)}))"


def _leak(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '{_q(T.LEAKAGE_TOKEN)}'), lambda t: length(t) > 1 AND t NOT IN ({_in(T.LEAKAGE_STOPWORDS)}))"


def _grams(c: str) -> str:
    s = _strip(f"regexp_replace(lower(coalesce({c}, '')), '{_WS}+', ' ', 'g')")
    return f"(SELECT CASE WHEN length(s) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_transform(range(1, greatest(length(s) - 4, 1) + 1), lambda i: substring(s, CAST(i AS INT), 5))) END FROM (SELECT {s} AS s))"


_CONCLUSION = "substring(" + _strip("regexp_extract(coalesce(pos_qa_text, ''), '(?s)\\n\\nCONCLUSION:(.*)', 1)") + ", 1, 1500)"


def _cites(src: str, key: str, text: str) -> str:
    """CTE body: key, kind, raw, base."""
    t = f"coalesce({text}, '')"
    return f"""
 SELECT DISTINCT {key}, 'gov' AS kind, raw, regexp_replace(raw, '\\(.*', '') AS base FROM (
   SELECT {key}, regexp_extract(unnest(regexp_extract_all({t}, '{_q(T.STATUTE)}')), '\\d{{3,5}}(?:\\([a-zA-Z0-9]\\))?$') AS raw FROM {src}
   UNION ALL SELECT {key}, unnest(regexp_extract_all({t}, '{_q(T.BARE_STATUTE)}')) FROM {src})
 UNION ALL SELECT DISTINCT {key}, 'reg', raw, regexp_replace(raw, '\\..*', '') FROM (
   SELECT {key}, unnest(regexp_extract_all({t}, '{_q(T.REGULATION)}', 1)) AS raw FROM {src}
   UNION ALL SELECT {key}, unnest(regexp_extract_all({t}, '{_q(T.BARE_REGULATION)}')) FROM {src})"""


_OPS = """ops AS (SELECT doc_id, question, qa, full_text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o, i) AS rn FROM (
  SELECT opinion_id AS doc_id, question, pos_qa_text AS qa, pos_qa_text AS full_text, 0 AS o, item_id AS i FROM heldout_pairs
  UNION ALL SELECT opinion_id, question, pos_qa_text, pos_full_text, 1, pair_id FROM pairs) WHERE doc_id IS NOT NULL) WHERE rn = 1)"""
_QRELS = "qrels AS (SELECT query_id, j.opinion_id AS doc_id, j.score AS score FROM (SELECT query_id, unnest(relevance_judgments) AS j FROM eval_queries))"


def _bm25(docs: str, doc: str, text: str, queries: str, query: str, qtext: str, name: str = "lex") -> str:
    """CTEs ending in `name`(query_id, doc_id, score)."""
    return f"""
 {name}_d AS (SELECT {doc} AS doc_id, {_tokens(text)} AS toks FROM {docs}),
 {name}_t AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM {name}_d),
 {name}_p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM {name}_d) GROUP BY ALL),
 {name}_f AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
 {name}_q AS (SELECT query_id, term, count(*) AS q_tf FROM (SELECT {query} AS query_id, unnest({_tokens(qtext)}) AS term FROM {queries}) GROUP BY ALL),
 {name} AS (SELECT query_id, doc_id, sum(q_tf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
   FROM {name}_q JOIN {name}_f USING (term) JOIN {name}_p USING (term), {name}_t GROUP BY query_id, doc_id)"""


def _graded(run: str, rel: str, out: str) -> str:
    """CTEs ending in `out`(run_id, query_id, metrics). run: run_id, query_id, rank, doc_id."""
    dcg = lambda at, k: f"sum(CASE WHEN {at} <= {k} THEN score / log2({at} + 1) ELSE 0 END)"
    return f"""
 {out}_r AS (SELECT query_id, doc_id, max(score) AS score FROM {rel} GROUP BY ALL),
 {out}_i AS (SELECT query_id, {dcg('i', 5)} AS i5, {dcg('i', 10)} AS i10, count_if(score >= 1) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS i FROM {out}_r) GROUP BY query_id),
 {out}_p AS (SELECT run_id, query_id, min(CASE WHEN score = 2 THEN rank END) AS first, {dcg('rank', 5)} AS d5, {dcg('rank', 10)} AS d10,
   count_if(rank <= 5 AND score >= 1) AS h5, count_if(rank <= 10 AND score >= 1) AS h10, count_if(rank <= 20 AND score >= 1) AS h20 FROM (SELECT run_id, query_id, rank, doc_id FROM {run}) JOIN {out}_r USING (query_id, doc_id) GROUP BY ALL),
 {out} AS (SELECT run_id, query_id, coalesce(1.0 / first, 0.0) AS mrr, CASE WHEN i5 > 0 THEN coalesce(d5, 0) / i5 ELSE 0.0 END AS ndcg_5, CASE WHEN i10 > 0 THEN coalesce(d10, 0) / i10 ELSE 0.0 END AS ndcg_10,
   coalesce(h5, 0) / 5.0 AS p_5, coalesce(h10, 0) / 10.0 AS p_10, CASE WHEN relevant > 0 THEN coalesce(h10, 0) / relevant ELSE 0.0 END AS r_10, CASE WHEN relevant > 0 THEN coalesce(h20, 0) / relevant ELSE 0.0 END AS r_20
   FROM (SELECT DISTINCT run_id FROM {run}) CROSS JOIN {out}_i LEFT JOIN {out}_p USING (run_id, query_id))"""


_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in ("mrr", "ndcg_5", "ndcg_10", "p_5", "p_10", "r_10", "r_20"))


def _groups(per: str, queries: str, dims: list[str]) -> str:
    parts = [f"SELECT run_id, 'overall' AS group_kind, 'all' AS \"group\", count(*) AS n, {_MEANS} FROM {per} JOIN {queries} USING (query_id) GROUP BY run_id"]
    parts += [f"SELECT run_id, '{d}', coalesce({d}, ''), count(*), {_MEANS} FROM {per} JOIN {queries} USING (query_id) GROUP BY run_id, {d}" for d in dims]
    return " UNION ALL ".join(parts)


_DENSE = """dense AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 9) AS score
  FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)))"""
_LABELS = "rel AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, 2 AS score FROM embeddings q JOIN embeddings d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)"

# --- hybrid search -----------------------------------------------------------------------
_VEC = lambda c: f"list_transform(range(0, 64), lambda i: CAST(len(list_filter(list_transform({_tokens(c)}, lambda t: CAST('0x' || substring(md5(t), 1, 2) AS INT) % 64), lambda x: x = i)) AS DOUBLE))"
_POOL = f"""{_OPS}, {_QRELS}, {_bm25('ops', 'doc_id', 'full_text', 'eval_queries', 'query_id', 'query_text')},
 oc AS ({_cites('ops', 'doc_id', 'full_text')}),
 idx AS (SELECT doc_id, 'gov_exact' AS kind, raw AS key FROM oc WHERE kind = 'gov' UNION SELECT doc_id, 'gov_base', base FROM oc WHERE kind = 'gov' UNION SELECT doc_id, 'reg_exact', raw FROM oc WHERE kind = 'reg'),
 qc AS ({_cites('eval_queries', 'query_id', 'query_text')}),
 keys AS (SELECT query_id, 'gov_exact' AS kind, raw AS key FROM qc WHERE kind = 'gov' UNION SELECT query_id, 'gov_base', base FROM qc WHERE kind = 'gov' UNION SELECT query_id, 'reg_exact', raw FROM qc WHERE kind = 'reg' UNION SELECT query_id, 'reg_exact', base FROM qc WHERE kind = 'reg'),
 cited AS (SELECT DISTINCT query_id, doc_id FROM keys JOIN idx USING (kind, key)),
 top AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rn FROM lex WHERE score > 0) WHERE rn <= 100),
 cand AS (SELECT query_id, doc_id, max(c) = 1 AS from_citation FROM (SELECT *, 0 AS c FROM top UNION ALL SELECT *, 1 FROM cited) GROUP BY ALL),
 qv AS (SELECT query_id, {_VEC('query_text')} AS q FROM eval_queries),
 dv AS (SELECT doc_id, {_VEC('qa')} AS d FROM ops WHERE doc_id IN (SELECT doc_id FROM cand)),
 pool AS (SELECT query_id, doc_id, coalesce(score, 0.0) AS bm25, CASE WHEN n > 0 THEN dp / n ELSE 0.0 END AS cos, from_citation
   FROM (SELECT query_id, doc_id, from_citation, list_inner_product(q, d) AS dp, sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(d, d)) AS n FROM cand JOIN qv USING (query_id) JOIN dv USING (doc_id)) LEFT JOIN lex USING (query_id, doc_id))"""
_TRIALS = """trials AS (SELECT * FROM (VALUES ('w60', 0.6, 1.3, false, NULL, NULL, NULL, NULL), ('w40_all', 0.4, 1.5, true, NULL, NULL, NULL, NULL), ('lexical_all', 0.0, 2.0, true, NULL, NULL, NULL, NULL),
   ('by_type', 0.4, 1.5, true, 0.2, 0.7, NULL, NULL), ('boost', 0.4, 1.5, true, NULL, NULL, 0.6, 0.1)) v(run_id, w, cb, all_path, w_keyword, w_fact, t1, gap))"""
_SWEEP = f"""{_POOL}, {_TRIALS},
 p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS lex_rank,
   CASE WHEN max(bm25) OVER w = min(bm25) OVER w THEN 1.0 ELSE (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) END AS nb,
   CASE WHEN max(cos) OVER w = min(cos) OVER w THEN 1.0 ELSE (cos - min(cos) OVER w) / (max(cos) OVER w - min(cos) OVER w) END AS ns FROM pool WINDOW w AS (PARTITION BY query_id)),
 st AS (SELECT query_id, count(*) AS pool_size, count_if(from_citation) AS citation_pool_size, max(CASE WHEN lex_rank = 1 THEN bm25 END) AS b1, max(CASE WHEN lex_rank = 2 THEN bm25 END) AS b2, max(cos) AS sem_top1, avg(cos) AS sem_mean FROM p GROUP BY query_id),
 diag AS (SELECT run_id, query_id, CASE WHEN tok IS NULL THEN 'empty_query' WHEN cit IS NULL AND NOT all_path THEN 'bm25_only_noncite' WHEN pool_size IS NULL THEN 'empty_pool' WHEN ratio IS NULL OR ratio >= cb THEN 'cb_fired' ELSE 'fusion' END AS path,
   cit IS NOT NULL AS has_citations, coalesce(pool_size, 0) AS pool_size, coalesce(citation_pool_size, 0) AS citation_pool_size, ratio AS top12_ratio,
   CASE WHEN sem_top1 >= t1 AND (gap IS NULL OR sem_top1 - sem_mean >= gap) THEN 0.8 ELSE coalesce(CASE query_type WHEN 'keyword' THEN w_keyword WHEN 'fact_pattern' THEN w_fact END, w) END AS w_sem, sem_top1, sem_mean
   FROM (SELECT query_id, query_type, (SELECT max(1) FROM lex_q x WHERE x.query_id = e.query_id) AS tok, (SELECT max(1) FROM keys x WHERE x.query_id = e.query_id) AS cit FROM eval_queries e)
   LEFT JOIN (SELECT *, CASE WHEN b2 > 0 THEN b1 / b2 END AS ratio FROM st) USING (query_id) CROSS JOIN trials),
 run AS (SELECT * FROM (SELECT run_id, query_id, doc_id, sc AS score, row_number() OVER (PARTITION BY run_id, query_id ORDER BY round(sc, 9) DESC, doc_id) AS rank FROM (
   SELECT run_id, query_id, doc_id, CASE WHEN path = 'fusion' THEN (1 - w_sem) * nb + w_sem * ns ELSE bm25 END AS sc FROM diag JOIN p USING (query_id)
   WHERE path IN ('cb_fired', 'fusion') OR (path = 'bm25_only_noncite' AND bm25 > 0))) WHERE rank <= 20)"""
_ADAPTED = _SWEEP.replace(
    "ELSE coalesce(CASE query_type WHEN 'keyword' THEN w_keyword WHEN 'fact_pattern' THEN w_fact END, w) END AS w_sem",
    "WHEN sem_top1 - sem_mean >= 0.3 THEN least(coalesce(CASE query_type WHEN 'keyword' THEN w_keyword WHEN 'fact_pattern' THEN w_fact END, w) + 0.2, 1.0) ELSE coalesce(CASE query_type WHEN 'keyword' THEN w_keyword WHEN 'fact_pattern' THEN w_fact END, w) END AS w_sem",
)
_PERQ = f"{_SWEEP}, {_graded('run', 'qrels', 'per')}"
_GROUPED = f"{_PERQ}, g AS ({_groups('per', 'eval_queries', ['query_type', 'query_topic'])})"
_DELTA = f"{_PERQ}, dl AS (SELECT x.query_id, x.ndcg_10 AS a, y.ndcg_10 AS b, y.ndcg_10 - x.ndcg_10 AS delta FROM per x JOIN per y USING (query_id) WHERE x.run_id = 'w60' AND y.run_id = 'w40_all')"
_WIN = "count(*) AS n, count_if(round(delta, 9) >= 0.05) AS wins, count_if(round(delta, 9) <= -0.05) AS losses, count_if(abs(round(delta, 9)) < 0.05) AS flat, round(avg(delta), 6) AS mean_delta FROM dl5 JOIN eval_queries USING (query_id) JOIN (SELECT query_id, path FROM diag WHERE run_id = 'w40_all') USING (query_id)"
_DELTA5 = _DELTA + ", dl5 AS (SELECT x.query_id, x.ndcg_5 AS a, y.ndcg_5 AS b, y.ndcg_5 - x.ndcg_5 AS delta FROM per x JOIN per y USING (query_id) WHERE x.run_id = 'w60' AND y.run_id = 'w40_all')"
_UNIT = lambda c: f"(SELECT CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) END FROM (SELECT v, sqrt(list_inner_product(v, v)) AS n FROM (SELECT {_VEC(c)} AS v)))"
# --- leakage -------------------------------------------------------------------------------
_SIM = lambda a, b, over: f"CASE WHEN {b} IS NULL THEN NULL WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE round_even(len(list_intersect({a}, {b})) / len(list_distinct({over})), 3) END"
_MEASURED = f"""{_OPS}, {_QRELS}, ql AS (SELECT query_id, query_type, {_leak('query_text')} AS qt, {_grams('query_text')} AS qg FROM eval_queries),
 ol AS (SELECT doc_id, {_leak('question')} AS ot, {_grams('question')} AS og FROM ops WHERE doc_id IN (SELECT doc_id FROM qrels)),
 m AS (SELECT query_id, query_type, doc_id, score, {_SIM('qt', 'ot', 'list_concat(qt, ot)')} AS token_jaccard, {_SIM('qg', 'og', 'list_concat(qg, og)')} AS char_jaccard_5, {_SIM('qt', 'ot', 'qt')} AS query_overlap FROM qrels JOIN ql USING (query_id) LEFT JOIN ol USING (doc_id))"""


def _rank_stats(src: str, key: str) -> str:
    """src: a relation with the key and v."""
    return f"""SELECT {key}, count(*) AS n, max(CASE WHEN rn = n_ // 10 THEN v END) AS p10, max(CASE WHEN rn = n_ // 2 THEN v END) AS p50, max(CASE WHEN rn = CAST(floor(n_ * 0.9) AS BIGINT) THEN v END) AS p90, max(CASE WHEN rn = CAST(floor(n_ * 0.99) AS BIGINT) THEN v END) AS p99,
  max(v) AS max, min(v) AS min, round(avg(v), 6) AS mean, round(CASE WHEN count(*) >= 4 THEN sum(CASE WHEN rn = l1 - 1 THEN 1 - f1 WHEN rn = l1 THEN f1 ELSE 0 END * v) END, 6) AS q1, round(avg(CASE WHEN rn = (n_ - 1) // 2 OR rn = n_ // 2 THEN v END), 6) AS median,
  round(CASE WHEN count(*) >= 4 THEN sum(CASE WHEN rn = l3 - 1 THEN 1 - f3 WHEN rn = l3 THEN f3 ELSE 0 END * v) END, 6) AS q3
 FROM (SELECT *, (n_ + 1) * 0.25 - l1 AS f1, (n_ + 1) * 0.75 - l3 AS f3 FROM (SELECT *, least(greatest(floor((n_ + 1) * 0.25), 1), n_ - 1) AS l1, least(greatest(floor((n_ + 1) * 0.75), 1), n_ - 1) AS l3 FROM (
   SELECT {key}, CAST(v AS DOUBLE) AS v, row_number() OVER (PARTITION BY {key} ORDER BY v) - 1 AS rn, count(*) OVER (PARTITION BY {key}) AS n_ FROM {src} WHERE v IS NOT NULL))) GROUP BY {key}"""


# --- pairs -----------------------------------------------------------------------------------
_CUT = lambda a, b: f"nullif(regexp_extract(pos_full_text, '(?s)\\n\\n{a}\\n\\n(.*?)\\n\\n{b}', 1), '')"
_F = lambda c: f"nullif({_strip(c)}, '')"
_BUILT = f"""src AS (SELECT pair_id, year, qa_source, topic_primary, {_F("CASE WHEN question_source = 'real' THEN question END")} AS real, {_F("CASE WHEN question_source <> 'real' THEN question END")} AS synth,
  {_F(_CUT('FACTS', 'ANALYSIS'))} AS facts, {_F(_CUT('ANALYSIS', 'Sincerely'))} AS analysis, coalesce({_F(_CUT('CONCLUSION', '(?:FACTS|ANALYSIS)'))}, CASE WHEN NOT has_conclusion THEN 'Yes.' END) AS conclusion, {_F('pos_qa_text')} AS qa, {_F('pos_full_text')} AS full_text FROM (SELECT * REPLACE (CASE WHEN pair_id % 29 = 3 THEN NULL WHEN pair_id % 31 = 4 THEN 'Too short?' ELSE question END AS question, CASE WHEN pair_id % 37 = 5 THEN ' ' ELSE pos_qa_text END AS pos_qa_text) FROM pairs)),
 built AS (SELECT *, {_norm('coalesce(real, synth)')} AS question, CASE WHEN analysis IS NOT NULL AND (facts IS NOT NULL OR conclusion IS NOT NULL) THEN concat_ws(chr(10) || chr(10), facts, analysis, conclusion) END AS body FROM src),
 reasoned AS (SELECT *, CASE WHEN real IS NULL AND synth IS NULL THEN 'no_question' WHEN length(question) < 15 OR qa IS NULL OR full_text IS NULL THEN 'short_or_empty' END AS reason FROM built)"""
_TRAIN = "held AS (SELECT opinion_id FROM pairs WHERE split_name <> 'train' AND opinion_id IS NOT NULL UNION SELECT opinion_id FROM heldout_pairs WHERE opinion_id IS NOT NULL), docs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY opinion_id ORDER BY pair_id) AS rn FROM pairs WHERE split_name = 'train' AND opinion_id IS NOT NULL) WHERE rn = 1)"
_STATUTE = f"""cc AS ({_cites('docs', 'opinion_id', 'pos_full_text')}), codes AS (SELECT DISTINCT opinion_id AS doc_id, base AS code FROM cc WHERE kind = 'gov'),
 sn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_shared DESC, neg_id) AS rank FROM (SELECT a.doc_id, b.doc_id AS neg_id, count(*) AS n_shared FROM codes a JOIN codes b USING (code) WHERE a.doc_id <> b.doc_id AND b.doc_id NOT IN (SELECT opinion_id FROM held) GROUP BY ALL)) WHERE rank <= 5)"""
_LEXNEG = f"""{_bm25('docs', 'opinion_id', 'pos_full_text', '(SELECT * FROM docs WHERE pair_id % 20 = 0)', 'opinion_id', 'question', 'tl')},
 ln AS (SELECT query_id AS doc_id, doc_id AS neg_id, rank, round_even(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rn) AS rank FROM (
   SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rn FROM tl) WHERE rn <= 30 AND score > 0 AND doc_id <> query_id AND doc_id NOT IN (SELECT opinion_id FROM held)) WHERE rank <= 5)"""
_DIMS3 = ["question_source", "topic_primary", "year"]
_KEY = lambda c: f"md5('20260521|' || CAST({c} AS VARCHAR))"

SQL = {
    "flagship": f"WITH {_DENSE}, {_LABELS}, run AS (SELECT 'exact' AS run_id, * FROM dense WHERE rank <= 20), {_graded('run', 'rel', 'per')}, q AS (SELECT vec_id AS query_id, CAST(label AS VARCHAR) AS label FROM embeddings) {_groups('per', 'q', ['label'])}",
    "normalize_question": f"SELECT pair_id, {_norm('question')} AS question FROM pairs",
    "retrieval_tokens": f"SELECT pair_id, array_to_string({_tokens('pos_full_text')}, ' ') AS tokens FROM pairs",
    "leakage_tokens": f"SELECT pair_id, array_to_string({_leak('question')}, ' ') AS tokens FROM pairs",
    "char_ngrams": f"SELECT query_id, unnest({_grams('query_text')}) AS gram FROM eval_queries",
    "document_citations": _cites("documents", "doc_id", "text"),
    "base_codes": r"SELECT DISTINCT neg_id, code FROM (SELECT neg_id, trim(regexp_replace(unnest(shared_codes), '\([^)]*\)', '', 'g')) AS code FROM neg_records) WHERE code <> ''".replace("neg_id, code", "neg_id AS doc_id, code", 1),
    "conclusions": f"SELECT pair_id, CASE WHEN strpos(pos_qa_text, chr(10) || chr(10) || 'CONCLUSION:') > 0 THEN substring(pos_qa_text, strpos(pos_qa_text, chr(10) || chr(10) || 'CONCLUSION:') + 2) END AS section, {_CONCLUSION} AS conclusion FROM pairs",
    "embedding_text": f"SELECT pair_id, md5('passage: ' || CASE WHEN {_strip('t')} = '' THEN ' ' ELSE t END) AS text FROM (SELECT pair_id, CASE WHEN length({_strip(chr(99) + 'oalesce(pos_body, ' + chr(39) * 2 + ')')}) < 20 THEN coalesce(pos_full_text, '') ELSE coalesce(pos_body, '') END AS t FROM pairs)",
    "prompts": f"SELECT pair_id, md5('Q: ' || coalesce(question, '') || chr(10) || 'C: ' || CASE WHEN c = '' THEN '(not available)' ELSE c END || chr(10)) AS prompt FROM (SELECT pair_id, question, {_CONCLUSION} AS c FROM pairs)",
    "paraphrase_json": "SELECT event_id, CASE WHEN event_id % 4 < 2 AND trim(event_type) <> '' THEN event_type END AS keyword, CASE WHEN event_id % 4 < 2 AND trim(event_type) <> '' THEN 'seen by ' || user_id END AS fact_pattern FROM events",
    "build_pairs": f"""WITH {_BUILT} SELECT CAST(pair_id AS VARCHAR) AS opinion_id, coalesce(nullif(year, 0), 0) AS year, question, CASE WHEN real IS NOT NULL THEN 'real' WHEN synth IS NOT NULL THEN 'synthetic' END AS question_source, coalesce(nullif(qa_source, ''), '') AS qa_source, topic_primary,
  md5(body) AS pos_body, md5(qa || chr(10) || chr(10) || body) AS pos_qa_plus_body, real IS NOT NULL AS has_real_question, synth IS NOT NULL AS has_synth_question, facts IS NOT NULL AS has_facts, analysis IS NOT NULL AS has_analysis, conclusion IS NOT NULL AS has_conclusion, body IS NOT NULL AS body_complete, reason FROM reasoned""",
    "pair_reasons": f"WITH {_BUILT} SELECT coalesce(reason, 'pair') AS reason, count(*) AS n FROM reasoned GROUP BY 1",
    "pair_counters": f"""WITH {_BUILT}, r AS (SELECT reasoned.reason, pairs.opinion_id AS id, row_number() OVER (PARTITION BY pairs.opinion_id ORDER BY pair_id) AS rn FROM reasoned JOIN pairs USING (pair_id))
 SELECT CASE WHEN id IS NULL OR rn > 1 THEN 'duplicate_or_no_id' WHEN id IN (SELECT anchor_id FROM neg_records WHERE anchor_id IS NOT NULL) THEN 'held_out' ELSE coalesce(reason, 'emitted') END AS outcome, count(*) AS n FROM r GROUP BY 1""",
    "question_coverage": f"WITH {_BUILT} SELECT count_if(real IS NOT NULL) AS real, count_if(real IS NULL AND synth IS NOT NULL) AS synthetic_only, count_if(real IS NULL AND synth IS NULL) AS neither FROM reasoned",
    "language_model_texts": f"WITH {_OPS} SELECT doc_id, md5(full_text) AS text FROM ops WHERE length(full_text) >= 100 AND doc_id NOT IN (SELECT opinion_id FROM heldout_pairs)",
    "paraphrase_rows": """WITH a AS (SELECT event_id + 1000000 AS pair_id, event_type, user_id FROM events WHERE event_id % 4 < 2 AND trim(event_type) <> '')
 SELECT pair_id, year, event_type AS question, 'synthetic_keyword' AS question_source FROM pairs JOIN a USING (pair_id) UNION ALL SELECT pair_id, year, 'seen by ' || user_id, 'synthetic_fact_pattern' FROM pairs JOIN a USING (pair_id)""",
    "first_deliveries": "SELECT opinion_id, pair_id FROM (SELECT *, row_number() OVER (PARTITION BY opinion_id ORDER BY ingested_at, pair_id) AS rn FROM pairs WHERE opinion_id IS NOT NULL) WHERE rn = 1",
    "coverage": " UNION ALL ".join(f"SELECT '{d}' AS dimension, coalesce(CAST({d} AS VARCHAR), '') AS value, count(*) AS n FROM pairs GROUP BY 2" for d in ("question_source", "qa_source", "topic_primary", "year")),
    "top_topics": "SELECT coalesce(topic_primary, '') AS value, count(*) AS n FROM pairs GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
    "fill_report": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count_if(length(coalesce({e}, '')) > 0) AS filled, count(*) AS total FROM pairs" for c, e in (("pos_body", "pos_body"), ("pos_qa_plus_body", "pos_qa_plus_body"), ("topic_primary", "topic_primary"), ("pos_conclusion_only", "CASE WHEN strpos(pos_qa_text, chr(10) || chr(10) || 'CONCLUSION:') > 0 THEN 'x' END"))),
    "length_stats": _rank_stats("(SELECT split_name, length(pos_full_text) AS v FROM pairs)", "split_name"),
    "training_pairs": "SELECT pair_id FROM pairs WHERE split_name = 'train' AND (opinion_id IS NULL OR opinion_id NOT IN (SELECT opinion_id FROM pairs WHERE split_name <> 'train'))",
    "val_slice": f"SELECT pair_id, year FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY {_KEY('pair_id')}, pair_id) AS rn, count(*) OVER (PARTITION BY year) AS n FROM pairs) WHERE rn <= round_even(n * 0.05, 0)",
    "proportional_sample": f"SELECT pair_id, topic_primary FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k, pair_id) AS rn, count(*) OVER (PARTITION BY s) AS n, count(*) OVER () AS total FROM (SELECT *, coalesce(topic_primary, 'unclassified') AS s, {_KEY('pair_id')} AS k FROM pairs)) WHERE rn <= greatest(1, round_even(300.0 * n / total, 0)) ORDER BY md5(k), pair_id LIMIT 300",
    "first_rows": "SELECT pair_id FROM pairs ORDER BY pair_id LIMIT 100",
    "split_drift": " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, value, n_all, n_sample, round(100.0 * n_all / sum(n_all) OVER (), 2) AS pct_all, round(CASE WHEN sum(n_sample) OVER () = 0 THEN 0 ELSE 100.0 * n_sample / sum(n_sample) OVER () END, 2) AS pct_sample FROM (SELECT coalesce(CAST({d} AS VARCHAR), '') AS value, count(*) AS n_all, count_if(split_name = 'val') AS n_sample FROM pairs GROUP BY 1)"
        for d in _DIMS3
    ),
    "leakage_pairs": f"WITH {_MEASURED} SELECT * FROM m",
    "leakage_buckets": f"WITH {_MEASURED}, b AS (SELECT query_id, " + ", ".join(f"max(CASE WHEN score >= 2 THEN {x} END) AS {x}" for x in ("token_jaccard", "char_jaccard_5", "query_overlap")) + " FROM m GROUP BY query_id) " + " UNION ALL ".join(f"SELECT '{x}' AS measure, count({x}) AS n, " + ", ".join(f"count_if({x} >= {t}) AS ge_{str(t)[2:]}" for t in (0.3, 0.5, 0.7, 0.85, 0.95)) + " FROM b" for x in ("token_jaccard", "char_jaccard_5", "query_overlap")),
    "leakage_best_match": f"WITH {_MEASURED} SELECT query_id, doc_id, query_overlap FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY query_overlap DESC NULLS LAST, doc_id) AS rn FROM m) WHERE rn = 1",
    "leakage_stats": f"WITH {_MEASURED}, b AS ("
    + " UNION ALL ".join(f"SELECT query_id, 'overall' AS group_kind, 'all' AS \"group\", '{x}_score{tag}' AS measure, max(CASE WHEN score >= {least} THEN {x} END) AS v FROM m GROUP BY query_id" for x in ("token_jaccard", "char_jaccard_5", "query_overlap") for least, tag in ((2, "2"), (1, "1plus")))
    + " UNION ALL SELECT query_id, 'query_type', query_type, 'query_overlap_score2', max(CASE WHEN score = 2 THEN query_overlap END) FROM m GROUP BY query_id, query_type), s AS ("
    + _rank_stats("b", 'group_kind, "group", measure')
    + ') SELECT group_kind, "group", measure, n, ' + ", ".join(f"round_even({a}, 3) AS {b}" for a, b in (("mean", "mean"), ("median", "median"), ("q1", "p25"), ("q3", "p75"), ("max", "max"), ("min", "min"))) + " FROM s",
    "leakage_missing": f"WITH {_QRELS} SELECT score, count(*) AS n, count_if(doc_id NOT IN (SELECT opinion_id FROM pairs WHERE opinion_id IS NOT NULL)) AS missing FROM qrels GROUP BY score",
    "judged_opinions": f"WITH {_QRELS} SELECT doc_id, max(score) AS best, count(*) AS n FROM qrels GROUP BY doc_id",
    "bm25_top20": f"WITH {_OPS}, {_bm25('ops', 'doc_id', 'full_text', 'eval_queries', 'query_id', 'query_text')} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM lex) WHERE rank <= 20 AND score > 0",
    "dense_top20": f"WITH {_DENSE} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM dense WHERE rank <= 20",
    "vector_norms": "SELECT count(*) AS n, count_if(NOT sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) BETWEEN 0.99 AND 1.01) AS off_norm FROM embeddings",
    "dense_binary": f"""WITH {_DENSE}, {_LABELS}, nr AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1), h AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM dense JOIN rel USING (query_id, doc_id) WHERE rank <= 100),
 s AS (SELECT query_id, min(rank) AS first, count_if(rank <= 5) AS h5, count_if(rank <= 10) AS h10, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS d5, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS d10, sum(i / rank) AS ap FROM h GROUP BY 1),
 x AS (SELECT n, coalesce(first, 1000000000) AS first, coalesce(h5, 0) AS h5, coalesce(h10, 0) AS h10, coalesce(d5, 0) AS d5, coalesce(d10, 0) AS d10, coalesce(ap, 0) AS ap, list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))) AS i5, list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) AS i10 FROM nr LEFT JOIN s USING (query_id))
 SELECT count(*) AS n_queries, """ + ", ".join(f"round(avg(CASE WHEN first <= {k} THEN 1.0 ELSE 0.0 END), 6) AS accuracy_{k}" for k in (1, 3, 5)) + ", " + ", ".join(f"round(avg(h{k} / {k}.0), 6) AS precision_{k}, round(avg(h{k} / n), 6) AS recall_{k}, round(avg(d{k} / i{k}), 6) AS ndcg_{k}, round(avg(CASE WHEN first <= {k} THEN 1.0 / first ELSE 0.0 END), 6) AS mrr_{k}" for k in (5, 10)) + ", round(avg(ap / least(n, 100)), 6) AS map_100 FROM x",
    "cited_documents": f"WITH {_POOL} SELECT query_id, doc_id FROM cited",
    "statute_neighbours": f"WITH {_TRAIN}, {_STATUTE} SELECT doc_id, neg_id, n_shared, rank FROM sn",
    "fusion_pool": f"WITH {_POOL} SELECT query_id, doc_id, round(bm25, 6) AS bm25, round(cos, 6) AS cos, from_citation FROM pool",
    "fusion_ranking": f"WITH {_SWEEP} SELECT run_id, query_id, rank, doc_id, round(score, 6) AS score FROM run",
    "fusion_routes": f"WITH {_SWEEP} SELECT run_id, query_id, path, has_citations, pool_size, citation_pool_size, round(top12_ratio, 6) AS top12_ratio, round(w_sem, 6) AS w_sem, round(sem_top1, 6) AS sem_top1 FROM diag",
    "fusion_paths": f"WITH {_SWEEP} SELECT run_id, path, count(*) AS n FROM diag GROUP BY ALL",
    "fusion_per_query": f"WITH {_PERQ} SELECT run_id, query_id, " + ", ".join(f"round({m}, 6) AS {m}" for m in ("mrr", "ndcg_5", "ndcg_10", "p_5", "p_10", "r_10", "r_20")) + " FROM per",
    "fusion_metrics": f"WITH {_GROUPED} SELECT * FROM g",
    "best_trial": f"WITH {_GROUPED} SELECT run_id, ndcg_5 FROM g WHERE group_kind = 'overall' ORDER BY ndcg_5 DESC, list_position(['w60', 'w40_all', 'lexical_all', 'by_type', 'boost'], run_id) LIMIT 1",
    "run_wins": f"WITH {_DELTA5} SELECT 'overall' AS group_kind, 'all' AS \"group\", {_WIN} UNION ALL SELECT 'query_type', query_type, {_WIN} GROUP BY query_type UNION ALL SELECT 'query_topic', query_topic, {_WIN} GROUP BY query_topic UNION ALL SELECT 'path', path, {_WIN} GROUP BY path",
    "run_join": f"WITH {_PERQ} SELECT query_id, " + ", ".join(f"round(max(CASE WHEN run_id = '{r}' THEN ndcg_10 END), 6) AS {r}" for r in ("w60", "w40_all", "lexical_all", "by_type", "boost")) + ", CAST(5 - count(DISTINCT run_id) AS INT) AS missing FROM per GROUP BY query_id",
    "topic_mean": f"WITH {_DELTA5} SELECT count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(delta), 6) AS mean_delta FROM dl5 JOIN eval_queries USING (query_id) WHERE query_topic = 'conflicts_of_interest'",
    "fusion_adaptive": f"WITH {_ADAPTED} SELECT run_id, query_id, path, round(w_sem, 6) AS w_sem, round(sem_top1, 6) AS sem_top1, round(sem_mean, 6) AS sem_mean FROM diag",
    "largest_changes": f"WITH {_DELTA} SELECT query_id, round(a, 6) AS a, round(b, 6) AS b, round(delta, 6) AS delta, CASE WHEN round(delta, 9) > 0 THEN '+' WHEN round(delta, 9) < 0 THEN '-' ELSE '=' END AS mark FROM dl ORDER BY abs(round(delta, 9)) DESC, query_id LIMIT 20",
    "change_texts": f"WITH {_DELTA5} SELECT query_id, CASE WHEN round(delta, 9) > 0 THEN '+' WHEN round(delta, 9) < 0 THEN '-' ELSE '=' END AS mark, replace(substring(query_text, 1, 60), '|', chr(92) || '|') AS query FROM dl5 JOIN eval_queries USING (query_id) ORDER BY abs(round(delta, 9)) DESC, query_id LIMIT 20",
    "oracle_mean": f"WITH {_DELTA} SELECT count(*) AS n, round(avg(greatest(a, b)), 6) AS oracle FROM dl",
    "metric_pivot": f"WITH {_GROUPED} SELECT group_kind, \"group\", " + ", ".join(f"max(CASE WHEN run_id = '{r}' THEN ndcg_10 END) AS {r}" for r in ("w60", "w40_all", "lexical_all", "by_type", "boost")) + " FROM g GROUP BY ALL",
    "side_by_side": f"WITH {_SWEEP} SELECT query_id, rank, " + ", ".join(f"max(CASE WHEN run_id = '{r}' THEN doc_id || '|' || coalesce(CAST(q.score AS VARCHAR), '') END) AS {r}" for r in ("w60", "w40_all")) + " FROM run LEFT JOIN (SELECT query_id, doc_id, score FROM qrels) q USING (query_id, doc_id) WHERE rank <= 10 GROUP BY ALL",
    "gold_ranks": f"WITH {_OPS}, {_QRELS}, {_bm25('ops', 'doc_id', 'full_text', 'eval_queries', 'query_id', 'query_text')}, r AS (SELECT * FROM (SELECT query_id, doc_id, score AS s, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM lex) WHERE s > 0), x AS (SELECT query_id, score, coalesce(rank, 99999) AS rank FROM qrels LEFT JOIN r USING (query_id, doc_id) WHERE score >= 1) SELECT query_id, coalesce(min(CASE WHEN score = 2 THEN rank END), 99999) AS best_rank, count_if(score = 2 AND rank <= 100) AS gold2_100, count_if(rank <= 100) AS any_100, count_if(rank <= 1000) AS any_1000 FROM x GROUP BY query_id",
    "dense_gold_ranks": f"WITH {_OPS}, {_QRELS}, qv AS (SELECT query_id, {_UNIT('query_text')} AS q FROM eval_queries), dv AS (SELECT doc_id, {_UNIT('qa')} AS d FROM ops), r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(list_inner_product(q, d), 9) AS s FROM qv CROSS JOIN dv WHERE q IS NOT NULL AND d IS NOT NULL)), x AS (SELECT query_id, score, coalesce(rank, 99999) AS rank FROM qrels LEFT JOIN r USING (query_id, doc_id) WHERE score >= 1) SELECT query_id, coalesce(min(CASE WHEN score = 2 THEN rank END), 99999) AS best_rank, count_if(score = 2 AND rank <= 100) AS gold2_100, count_if(rank <= 100) AS any_100, count_if(rank <= 1000) AS any_1000 FROM x GROUP BY query_id",
    "lexical_negatives": f"WITH {_TRAIN}, {_LEXNEG} SELECT doc_id, neg_id, rank, score FROM ln",
    "hard_negatives": f"""WITH {_TRAIN}, {_STATUTE}, {_LEXNEG}, s AS (SELECT doc_id, neg_id, n_shared, rank AS s_rank FROM sn WHERE doc_id IN (SELECT opinion_id FROM docs WHERE pair_id % 20 = 0))
 SELECT doc_id, neg_id, CASE WHEN rank IS NULL THEN 'same_statute' WHEN s_rank IS NULL THEN 'bm25' ELSE 'bm25+same_statute' END AS source, rank, score, n_shared, row_number() OVER (PARTITION BY doc_id ORDER BY rank NULLS LAST, s_rank, neg_id) AS ordinal FROM ln FULL OUTER JOIN s USING (doc_id, neg_id)""",
    "anchor_mix": "SELECT CASE WHEN b AND s THEN 'mixed' WHEN b THEN 'bm25_only' WHEN s THEN 'statute_only' ELSE 'empty' END AS mix, count(*) AS n FROM (SELECT DISTINCT opinion_id AS a FROM pairs WHERE split_name = 'train') LEFT JOIN (SELECT anchor_id AS a, bool_or(contains(lower(trim(source)), 'bm25')) AS b, bool_or(contains(lower(trim(source)), 'same_statute')) AS s FROM neg_records GROUP BY 1) USING (a) GROUP BY 1",
    "negative_list_summary": "SELECT count(*) AS n, round_even(avg(l), 3) AS mean, min(l) AS least, max(l) AS most FROM (SELECT a, count(neg_id) AS l FROM (SELECT DISTINCT opinion_id AS a FROM pairs WHERE split_name = 'train') LEFT JOIN (SELECT anchor_id AS a, 1 AS neg_id FROM neg_records) USING (a) GROUP BY a)",
    "negative_list_lengths": "SELECT length, count(*) AS n FROM (SELECT anchor_id, count(*) AS length FROM neg_records WHERE anchor_id IS NOT NULL GROUP BY 1) GROUP BY 1",
    "training_rows": f"""WITH {_OPS}, n AS (SELECT anchor_id AS opinion_id, qa, row_number() OVER (PARTITION BY anchor_id ORDER BY neg_id, x.opinion_id) AS k FROM (SELECT DISTINCT anchor_id, opinion_id, neg_id FROM neg_records WHERE anchor_id IS NOT NULL) x JOIN ops ON x.opinion_id = ops.doc_id WHERE length(qa) > 0),
 l AS (SELECT opinion_id, string_agg(md5('passage: ' || qa), ',' ORDER BY k) AS negatives FROM n WHERE k <= 2 GROUP BY 1 HAVING count(*) = 2)
 SELECT pair_id, 'query: ' || question AS anchor, length('passage: ' || pos_body) AS n_positive, negatives, md5('42|' || pair_id) AS shuffle_key FROM pairs JOIN l USING (opinion_id) WHERE split_name = 'train' AND length(coalesce(pos_body, '')) > 0 AND opinion_id NOT IN (SELECT opinion_id FROM pairs WHERE split_name <> 'train') AND opinion_id NOT IN (SELECT opinion_id FROM heldout_pairs)""",
    "question_index": f"WITH {_OPS} SELECT doc_id, {_norm('question')} AS question, length(full_text) AS n_chars FROM ops",
    "extra_pairs": """WITH a AS (SELECT event_id + 1000000 AS pair_id, event_type, user_id FROM events WHERE event_id % 4 < 2 AND trim(event_type) <> '')
 SELECT pair_id, year, question, question_source FROM pairs UNION ALL SELECT pair_id, year, event_type, 'synthetic_keyword' FROM pairs JOIN a USING (pair_id) UNION ALL SELECT pair_id, year, 'seen by ' || user_id, 'synthetic_fact_pattern' FROM pairs JOIN a USING (pair_id)""",
    "training_report": f"""WITH {_OPS}, n AS (SELECT anchor_id AS opinion_id, row_number() OVER (PARTITION BY anchor_id ORDER BY neg_id) AS k FROM (SELECT DISTINCT anchor_id, opinion_id, neg_id FROM neg_records WHERE anchor_id IS NOT NULL) x JOIN ops ON x.opinion_id = ops.doc_id WHERE length(qa) > 0),
 enough AS (SELECT opinion_id FROM n GROUP BY 1 HAVING count(*) >= 2),
 c AS (SELECT CASE WHEN opinion_id IN (SELECT opinion_id FROM pairs WHERE split_name <> 'train') OR opinion_id IN (SELECT opinion_id FROM heldout_pairs) THEN 'dropped_val_overlap' WHEN length(coalesce(pos_body, '')) = 0 THEN 'dropped_poscol_null' WHEN opinion_id NOT IN (SELECT opinion_id FROM enough) THEN 'dropped_insufficient_hard_negs' ELSE 'training_rows' END AS o FROM pairs)
 SELECT 'input_pairs' AS outcome, count(*) AS n FROM c UNION ALL SELECT outcome, (SELECT count(*) FROM c WHERE o = outcome) FROM (VALUES ('dropped_val_overlap'), ('dropped_poscol_null'), ('dropped_insufficient_hard_negs'), ('training_rows')) v(outcome)""",
    "val_evaluator": f"""WITH rows AS (SELECT pair_id AS id, question, pos_qa_text FROM (SELECT *, row_number() OVER (PARTITION BY opinion_id ORDER BY pair_id DESC) AS rn FROM pairs WHERE split_name = 'val' AND opinion_id IS NOT NULL AND length(coalesce(pos_qa_text, '')) > 0) WHERE rn = 1),
 qv AS (SELECT id, {_UNIT('question')} AS q FROM rows), dv AS (SELECT id, {_UNIT('pos_qa_text')} AS d FROM rows),
 r AS (SELECT a, rank FROM (SELECT qv.id AS a, dv.id AS b, row_number() OVER (PARTITION BY qv.id ORDER BY round(list_inner_product(q, d), 9) DESC, -dv.id) AS rank FROM qv CROSS JOIN dv WHERE q IS NOT NULL AND d IS NOT NULL) WHERE a = b AND rank <= 100),
 x AS (SELECT coalesce(rank, 1000000000) AS r FROM rows LEFT JOIN r ON r.a = rows.id)
 SELECT count(*) AS n_queries, """ + ", ".join(f"round(avg(CASE WHEN r <= {k} THEN 1.0 ELSE 0.0 END), 6) AS accuracy_{k}" for k in (1, 3, 5)) + ", " + ", ".join(f"round(avg(CASE WHEN r <= {k} THEN 1.0 / {k} ELSE 0.0 END), 6) AS precision_{k}, round(avg(CASE WHEN r <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}, round(avg(CASE WHEN r <= {k} THEN 1 / log2(r + 1) ELSE 0.0 END), 6) AS ndcg_{k}, round(avg(CASE WHEN r <= {k} THEN 1.0 / r ELSE 0.0 END), 6) AS mrr_{k}" for k in (5, 10)) + ", round(avg(CASE WHEN r <= 100 THEN 1.0 / r ELSE 0.0 END), 6) AS map_100 FROM x",
    "chunks": """WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\s\\x{0b}]+'), lambda x: x <> '') AS t FROM documents), d AS (SELECT *, len(t) AS l, CAST(greatest(1, ceil(len(t) / 128.0)) AS INT) AS n FROM t WHERE len(t) > 0),
 s AS (SELECT *, CAST(('0x' || substring(md5('42|' || doc_id), 1, 8))::BIGINT % (greatest(0, l - n * 128) + 1) AS INT) AS start FROM d), c AS (SELECT doc_id, CAST(k AS INT) AS chunk, t[start + k * 128 + 1 : start + k * 128 + 128] AS tokens FROM (SELECT *, unnest(range(0, n)) AS k FROM s))
 SELECT doc_id, chunk, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens FROM c WHERE len(tokens) >= 32""",
    "resume": "SELECT pair_id FROM pairs WHERE opinion_id NOT IN (SELECT anchor_id FROM neg_records WHERE anchor_id IS NOT NULL)",
}
