"""Queries of composed search, grounding, further splitters and negatives chosen per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.functions import text as T
from rankframe.operators import bm25, grounding, metrics, search
from rankframe.operators import chunking as C
from rankframe.operators import conversations as V
from rankframe.operators import scoring as S
from rankframe.operators import training as N
from rankframe.plans import conversing, ingesting, learning, scoring
from rankframe.plans.common import STOP_LIST, dealt, registering, table
from rankframe.plans.retrieval import BM25_SQL, METRICS_SQL, QRELS_SQL, K, _passages
from rankframe.sources.scratch import written

QUERIES: dict = {}
ORACLES: dict = {}
register = registering(QUERIES, ORACLES)

#: Fixture patterns: the invented prose has none of the domain's phrases.
PHRASES = (r"[a-z]+tion", r"the [a-z]+")
TRIGGERS = ("of", "und", "de", "y")
DOMAINS = {"place": r"(^|\s)(in|on|at)(\s|$)", "link": r"(^|\s)(and|und|et|y)(\s|$)", "article": r"(^|\s)(the|der|la|le)(\s|$)"}
STRATEGIES = (("motion", 15, True, "src1"), ("place", 8, False, "src2"), ("german", 12, True, ""))


@register(r"SELECT doc_id, translate(replace(regexp_replace(strip_accents(text), '[\x01-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '…', '...'), '‐–—•‘’“”«»', '----' || chr(39) || chr(39) || repeat(chr(34), 4)) AS text FROM documents")
def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3."""
    return table(spark, sf_dir, "documents").select("doc_id", T.canonical(F.col("text")).alias("text"))


@register(
    """WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS i, l_linenumber::VARCHAR || ' | ' || l_partkey::VARCHAR || ' | ' || l_returnflag AS line FROM lineitem)
SELECT l_orderkey AS order_id, string_agg(line, chr(10) ORDER BY i) AS text, left(sha256(string_agg(CASE WHEN i <= 5 THEN line END, chr(10) ORDER BY i)), 16) AS fingerprint, count(*) AS n_rows, 3::BIGINT AS n_columns FROM r GROUP BY 1"""
)
def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each order as a table in text."""
    cells = F.struct("l_linenumber", "l_partkey", F.array(F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_returnflag")).alias("row"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.array_sort(F.collect_list(cells))["row"].alias("rows"))
    return rows.select("order_id", T.table_text(F.col("rows")).alias("text"), T.table_fingerprint(F.col("rows")).alias("fingerprint"), F.size("rows").cast("long").alias("n_rows"), F.array_max(F.transform("rows", F.size)).cast("long").alias("n_columns"))


@register()
def redistributed_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks grouped after the last sentence spread over the last sentences; tested against golden texts."""
    return table(spark, sf_dir, "documents").select("doc_id", T.redistributed_citations(F.concat("text", F.lit(" [1.1] [1.2] [2.1]"))).alias("text"))


@register(f"WITH a AS (SELECT conv_id * 100 + turn AS answer_id, {conversing.CITED} AS text FROM conversations) SELECT answer_id, replace(replace(replace(text, '[1.1]', '[#]'), '[2.1]', '[1.1]'), '[#]', '[2.1]') AS text FROM a")
def renumbered_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents change numbers, without one mark replaced twice."""
    mapping = F.create_map(*[F.lit(x) for x in ("1.1", "2.1", "2.1", "1.1")])
    return conversing._answers(spark, sf_dir)[0].select("answer_id", T.renumbered(F.col("text"), mapping).alias("text"))


@register("WITH r AS (SELECT conv_id, left(trim(text), 200) AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE trim(text) <> '' AND left(trim(text), 1) <> '{') SELECT * FROM r WHERE place <= 5")
def past_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five answers of each conversation, given in fences, as JSON or plain, in plain words."""
    c = table(spark, sf_dir, "conversations").where(~F.trim("text").startswith("{"))
    given = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```sql\nselect 1\n```\n"), F.col("text"))).when(F.col("turn") % 3 == 1, F.to_json(F.struct(F.trim("text").alias("answer")))).otherwise(F.col("text"))
    found = c.select("conv_id", (-F.col("turn")).alias("_t"), T.past_answer(given, "no answer").alias("answer")).where("answer is not null")
    return V.latest_each(found, "conv_id", "_t", 5).select("conv_id", "answer", F.col("place").cast("long").alias("place"))


@register(
    f"""WITH i AS ({scoring.ORACLES['query_intent']}) SELECT query_id, intent, CASE intent WHEN 'motion' THEN 15 WHEN 'place' THEN 8 WHEN 'german' THEN 12 ELSE 10 END::BIGINT AS top_k, intent <> 'place' AS expand_query, CASE intent WHEN 'motion' THEN 'src1' WHEN 'place' THEN 'src2' ELSE '' END AS sections FROM i"""
)
def intent_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B40."""
    found = search.strategies(scoring.query_intent(spark, sf_dir).select("query_id", "intent"), STRATEGIES)
    return found.withColumn("top_k", F.col("top_k").cast("long"))


@register(
    "WITH a AS (" + scoring.ORACLES["query_alpha"].replace("SELECT query_id, query_type,", "SELECT query_id, round(coalesce(list_sum(st), 0), 6) AS adjustment, query_type,") + ") "
    "SELECT query_id, 'type ' || query_type || ' | base ' || printf('%.2f', base_alpha) || ' | adjusted ' || CASE WHEN adjustment < 0 THEN '-' ELSE '+' END || printf('%.2f', abs(adjustment)) || ' | ' || CASE WHEN alpha >= 0.7 THEN 'dense first' WHEN alpha <= 0.4 THEN 'terms first' ELSE 'balanced' END AS reasoning FROM a"
)
def alpha_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B41."""
    rated = S.adaptive_alpha(_passages(spark, sf_dir), scoring.GROUPS).withColumn("alpha", F.round("alpha", 6))
    return search.alpha_reasons(rated).select("query_id", "reasoning")


@register(
    r"""WITH d AS (SELECT doc_id, lower(text) AS t, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(regexp_extract_all(t, '[a-z]+tion')) AS term FROM d UNION ALL SELECT doc_id, unnest(regexp_extract_all(t, 'the [a-z]+')) FROM d UNION ALL SELECT doc_id, a || ' ' || b FROM (SELECT doc_id, unnest(w) AS a, unnest(w[2:]) AS b FROM d) WHERE b IS NOT NULL AND a IN ('of', 'und', 'de', 'y'))
SELECT term, count(DISTINCT doc_id) AS n_docs FROM p GROUP BY 1"""
)
def term_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and trigger pairs of all documents."""
    return search.term_corpus(table(spark, sf_dir, "documents"), PHRASES, TRIGGERS)


VARIANTS_SQL = f"""cv AS ({scoring.ORACLES['concept_variants']}),
va AS (SELECT item_id AS query_id, 0 AS ord, text FROM benchmark UNION ALL SELECT item_id, rank, text || ' ' || synonym FROM cv JOIN benchmark ON item_id = query_id),
vd AS (SELECT query_id, min(ord) AS ord, arg_min(text, ord) AS text FROM va GROUP BY query_id, lower(text)),
vb AS (SELECT query_id * 100 + ord AS item_id, text FROM vd)"""
MULTI_SQL = f"""{VARIANTS_SQL}, mq AS (WITH {BM25_SQL.replace('FROM benchmark', 'FROM vb')} SELECT * FROM run),
mu AS (SELECT query_id // 100 AS query_id, doc_id, query_id % 100 AS variant_ord, score, row_number() OVER (PARTITION BY query_id // 100, doc_id ORDER BY query_id % 100) AS r FROM mq)"""


def _extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.concept_variants(spark, sf_dir).select("query_id", F.col("synonym").alias("term"), F.col("rank").alias("ord"))


@register(f"WITH {MULTI_SQL} SELECT query_id, doc_id, variant_ord::BIGINT AS variant_ord, round(score, 4) AS score FROM mu WHERE r = 1")
def multi_query_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage and its concept variants, hits by the first variant that found them (ladder_hits has the other variants)."""
    found = search.multi_query(dealt(table(spark, sf_dir, "documents")), _passages(spark, sf_dir), _extra(spark, sf_dir), K)
    return found.select("query_id", "doc_id", F.col("variant_ord").cast("long").alias("variant_ord"), F.round("score", 4).alias("score"))


HYBRID_SQL = f"""{MULTI_SQL}, al AS ({scoring.ORACLES['query_alpha']}),
dq AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS e FROM benchmark JOIN embeddings ON vec_id = item_id), dd AS (SELECT doc_id, embedding::DOUBLE[] AS e FROM documents JOIN embeddings ON vec_id = doc_id),
dn AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(dq.e, dd.e), 9) DESC, doc_id) AS rank FROM dq, dd),
al2 AS (SELECT query_id, doc_id, min(o) AS variant_ord FROM (SELECT query_id, doc_id, -1 AS o FROM dn WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, variant_ord FROM mu) GROUP BY ALL),
ix AS (WITH {BM25_SQL} SELECT query_id, term, idf FROM q JOIN idf USING (term) WHERE idf > 0),
hh AS (SELECT u.query_id, u.doc_id, u.variant_ord, d.text, d.source, coalesce(list_cosine_similarity(dq.e, dd.e), 0) AS score, al.alpha, list_filter(regexp_extract_all(lower(b.text), '[a-z]{{2,}}'), lambda x: NOT list_contains([{STOP_LIST}], x)) AS query_tokens
  FROM al2 u JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = u.query_id JOIN al ON al.query_id = u.query_id LEFT JOIN dq ON dq.query_id = u.query_id LEFT JOIN dd ON dd.doc_id = u.doc_id),
bo AS (SELECT hh.query_id, doc_id, sum(CASE WHEN contains(lower(text), term) THEN idf ELSE 0 END) AS boost FROM hh JOIN ix USING (query_id) GROUP BY ALL),
hf AS (SELECT hh.*, coalesce(boost, 0) AS boost, boost IS NOT NULL AS has, length(text) AS n, len(query_tokens) AS asked, len(list_filter(query_tokens, lambda t: contains(lower(text), t))) AS found FROM hh LEFT JOIN bo USING (query_id, doc_id)),
hs AS (SELECT *, CASE WHEN has THEN alpha * score + (1 - alpha) * boost / 10 END AS hybrid_score, greatest(-0.4, least(0.85, CASE WHEN n BETWEEN 400 AND 1200 THEN 0.2 WHEN n < 200 THEN -0.15 WHEN n > 1600 THEN -0.1 ELSE 0.0 END + CASE WHEN asked = 0 THEN 0.0 WHEN found > 0 THEN least(0.2, 0.25 * found / asked) ELSE -0.18 END + CASE WHEN contains(source, 'src1') THEN 0.25 WHEN contains(source, 'src2') THEN 0.15 ELSE 0.0 END))::DOUBLE AS quality_score FROM hf),
hr AS (SELECT *, coalesce(hybrid_score, score) * (1 + quality_score) AS final_score FROM hs), hk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, doc_id) AS rank FROM hr)"""


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    queries = _passages(spark, sf_dir).join(v.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")
    return search.hybrid_search(table(spark, sf_dir, "documents"), v.select(F.col("vec_id").alias("doc_id"), "embedding"), queries, _extra(spark, sf_dir), scoring.GROUPS, K, K, "source", scoring.SECTIONS)


@register(f"WITH {HYBRID_SQL} SELECT query_id, doc_id, variant_ord::BIGINT AS variant_ord, round(score, 4) AS score, round(hybrid_score, 4) AS hybrid_score, round(final_score, 4) AS final_score, rank FROM hk WHERE rank <= 20")
def hybrid_search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and BM25 variants together, blended, raised by quality and cut."""
    found = _hybrid(spark, sf_dir)
    return found.select("query_id", "doc_id", F.col("variant_ord").cast("long").alias("variant_ord"), *[F.round(c, 4).alias(c) for c in ("score", "hybrid_score", "final_score")], F.col("rank").cast("long").alias("rank"))


@register(f"WITH {HYBRID_SQL} SELECT query_id, lang AS kind, count(*) AS total, string_agg(DISTINCT d.source, ',' ORDER BY d.source) AS sources FROM hk JOIN documents d USING (doc_id) WHERE rank <= 20 AND lang IS NOT NULL GROUP BY ALL")
def search_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and sources of the hits by kind."""
    kinds = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("kind"), "source").where("kind is not null")
    return search.envelope(_hybrid(spark, sf_dir).select("query_id", "doc_id").join(kinds, "doc_id"), "kind")


@register(
    rf"""WITH {scoring.RUN_SQL}, h AS (SELECT hit.*, lower(b.text) AS q, lower(hit.text) AS t FROM hit JOIN benchmark b ON b.item_id = query_id),
s AS (SELECT *, least(0.5, {' + '.join(f"CASE WHEN regexp_matches(q, '{p}') AND regexp_matches(t, '{p}') THEN 0.2 ELSE 0.0 END" for p in DOMAINS.values())})::DOUBLE AS boost FROM h) SELECT query_id, doc_id, boost AS domain_boost, round(score * (1 + boost), 4) AS boosted_score FROM s"""
)
def domain_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R19."""
    hits = scoring._run(spark, sf_dir).join(_passages(spark, sf_dir).withColumnRenamed("text", "query"), "query_id")
    return search.domain_boost(hits, "query", "text", "source", DOMAINS).select("query_id", "doc_id", F.round("domain_boost", 6).alias("domain_boost"), F.round("boosted_score", 4).alias("boosted_score"))


@register(f"WITH {BM25_SQL} SELECT query_id, doc_id, rank, coalesce(nullif(source, ''), 'unknown') AS source, '' AS section, left(text, 1500) AS text, coalesce(lang, '') AS region FROM run JOIN documents USING (doc_id)")
def hit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B10."""
    docs = table(spark, sf_dir, "documents")
    hits = bm25.search(dealt(docs), _passages(spark, sf_dir), K).join(docs.select("doc_id", "text", "source", "lang"), "doc_id")
    return search.projected(hits).withColumn("rank", F.col("rank").cast("long"))


@register()
def grounded_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each passage stands in its three best documents; tested against a brute-force version."""
    docs, queries = table(spark, sf_dir, "documents"), _passages(spark, sf_dir)
    pairs = bm25.search(docs, queries, 3).join(docs.select("doc_id", "text"), "doc_id").join(queries.withColumnRenamed("text", "passage"), "query_id")
    return grounding.grounded(pairs).select("query_id", "doc_id", "match_type", F.round("similarity", 6).alias("similarity"), "match_start")


@register(
    f"""WITH a AS (WITH {BM25_SQL}, {QRELS_SQL}, {METRICS_SQL} SELECT * FROM ev), b AS (WITH {BM25_SQL.replace('run AS (', 'run0 AS (')}, {QRELS_SQL},
  s AS (SELECT run0.query_id, run0.doc_id, score, list_distinct(list_filter(regexp_extract_all(lower(b.text), '[a-z]{{2,}}'), lambda x: NOT list_contains([{STOP_LIST}], x))) AS qt, regexp_extract_all(lower(d.text), '[a-z]{{2,}}') AS tt FROM run0 JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE trim(d.text) <> ''),
  run AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, tt))::DOUBLE / len(qt) ELSE 0.0 END, 9) DESC, doc_id) AS rank FROM s), {METRICS_SQL} SELECT * FROM ev),
x AS (SELECT 'mrr' AS metric, avg(mrr) AS v FROM a WHERE has_truth UNION ALL SELECT 'ndcg', avg(ndcg) FROM a WHERE has_truth UNION ALL SELECT 'map', avg(map) FROM a WHERE has_truth),
y AS (SELECT 'mrr' AS metric, avg(mrr) AS v FROM b WHERE has_truth UNION ALL SELECT 'ndcg', avg(ndcg) FROM b WHERE has_truth UNION ALL SELECT 'map', avg(map) FROM b WHERE has_truth)
SELECT metric, round(x.v, 4) AS before, round(y.v, 4) AS after, round(y.v - x.v, 4) AS delta FROM x JOIN y USING (metric)"""
)
def rerank_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics before and after re-ranking."""
    docs, passages = dealt(table(spark, sf_dir, "documents")), _passages(spark, sf_dir)
    index, stats = bm25.indexed(docs, bm25.query_terms(passages).select("term").distinct())  # one index for the run and the judgements
    qrels = bm25.containing(docs, passages, index)
    hits = written(scoring._run(spark, sf_dir, index, stats), "hits")  # read before and after re-ranking
    after = S.reranked(hits, S.overlap_score(F.col("query_tokens"), F.col("text")), K).select("query_id", "doc_id", F.col("rerank_rank").alias("rank"))
    means = [metrics.summary(metrics.per_query(run, qrels), ("mrr", "ndcg", "map")) for run in (after, hits)]
    found = metrics.against_baseline(*means)
    return found.select("metric", F.round("baseline", 4).alias("before"), F.round("value", 4).alias("after"), F.round("delta", 4).alias("delta"))


HEADER_AT = (ingesting.LINES_SQL.index("line <> ''"), ingesting.LINES_SQL.index(" AS header"))
PLAIN_LINES_SQL = ingesting.LINES_SQL[: HEADER_AT[0]] + r"line <> '' AND length(line) <= 150 AND (regexp_matches(line, '^\d+(\.\d+)*\.?\s+[A-Za-z]') OR (length(line) >= 4 AND letters > 0 AND caps >= 0.6 * letters))" + ingesting.LINES_SQL[HEADER_AT[1] :]


@register(f"WITH {PLAIN_LINES_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS section_index, section_title, content FROM s WHERE content IS NOT NULL")
def plain_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: sections by the older header rule."""
    return C.sections(table(spark, sf_dir, "documents"), header=C.is_plain_header).withColumn("section_index", F.col("section_index").cast("long"))


@register(ingesting.ORACLES["document_chunks"].replace("least(held, 4)", "least(held, 3)").replace("> 500", "> 950").replace(">= 200", ">= 550").replace(">= 750", ">= 1400"))
def long_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: the packer with larger sizes and three sentences of overlap."""
    made = C.chunks(table(spark, sf_dir, "documents"), target=950, least=550, most=1400, overlap=3)
    return made.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "start_sentence_index", "end_sentence_index")], "text")


@register()
def dispatched_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6; tested against a brute-force version."""
    return C.dispatched(dealt(table(spark, sf_dir, "documents")))


@register(
    r"""WITH RECURSIVE w AS (SELECT doc_id, text, length(text) AS n, 0 AS start, NULL::INT AS s, NULL::INT AS e FROM documents WHERE length(text) > 0
UNION ALL SELECT doc_id, text, n, CASE WHEN cut >= n THEN n ELSE greatest(cut - 200, start + 1) END, start, cut FROM (SELECT *, CASE WHEN start + 1000 >= n THEN n WHEN se > 0 THEN start + 800 + se WHEN wo > 0 THEN start + 500 + wo ELSE start + 1000 END AS cut
  FROM (SELECT *, length(regexp_extract(substring(text, start + 801, 200), '(?s)^(.*[.!?])\s', 1)) AS se, length(regexp_extract(substring(text, start + 501, 500), '(?s)^(.*)\s', 1)) AS wo FROM w WHERE start < n)))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, s::BIGINT AS start, e::BIGINT AS end, substring(text, s + 1, e - s) AS text FROM w WHERE e IS NOT NULL"""
)
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7."""
    return C.windowed(table(spark, sf_dir, "documents")).select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "start", "end")], "text")


@register()
def overlapped_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: lines as paragraphs; tested against a brute-force version."""
    parts = C.paragraphs_overlapped(C.lines_of(T.normalised(F.col("text"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("chunk_index", "text"))


@register()
def fallback_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed to 1,200 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.paragraphs_packed(C.lines_of(T.normalised(F.col("text"))), F.lit(1200))).alias("chunk_index", "text"))


@register(
    rf"""WITH {learning.CANDIDATES_SQL}, pw AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS a FROM benchmark),
nw AS (SELECT query_id, doc_id, score, lang, source, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS b FROM ca JOIN documents USING (doc_id)),
si AS (SELECT nw.*, len(list_intersect(a, b))::DOUBLE / greatest(len(a) + len(b) - len(list_intersect(a, b)), 1) AS similarity FROM nw JOIN pw USING (query_id))
SELECT query_id, count(*) AS n, round(0.3 * least(avg(score) / 0.5, 1.0) + 0.3 * least(count(DISTINCT lang) / 3.0, 1.0) + 0.2 * least(count(DISTINCT source) / 5.0, 1.0) + 0.2 * least(avg(similarity), 1.0), 6)::DOUBLE AS quality FROM si GROUP BY 1"""
)
def negative_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passage itself is the positive that the negatives are compared with."""
    found = learning._parts(spark, sf_dir)[0].join(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    likeness = N.semantic(found, _passages(spark, sf_dir), N.MOST_CANDIDATES).select("query_id", "doc_id", "similarity")
    rated = found.join(likeness, ["query_id", "doc_id"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    return N.quality(rated, "lang", F.col("source")).withColumn("quality", F.round("quality", 6))


def _adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = learning._parts(spark, sf_dir)[0].join(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    found = written(found, "found")  # each strategy reads it
    return N.adaptive(found, _passages(spark, sf_dir), "lang", F.col("source"))


@register()
def adaptive_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's first strategy whose negatives are good enough."""
    return _adaptive(spark, sf_dir).select("query_id", "doc_id", "pick", "strategy", "k", F.round("quality", 6).alias("quality"))


@register()
def mining_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries and negatives of each strategy."""
    return _adaptive(spark, sf_dir).groupBy("strategy").agg(F.count_distinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_negatives"))


@register("SELECT page_id AS model_id, page_id % 97 AS created_at, page_id = (SELECT page_id FROM pages ORDER BY page_id % 97 DESC, page_id DESC LIMIT 1) AS is_active FROM pages")
def active_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all registered models, the one made last is active."""
    return N.newest_active(table(spark, sf_dir, "pages").select(F.col("page_id").alias("model_id"), (F.col("page_id") % 97).alias("created_at")))


@register("SELECT conv_id, turn, role, text FROM conversations WHERE role = 'user' ORDER BY turn DESC, conv_id, role, text LIMIT 50")
def page_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty newest messages of a role."""
    return V.history(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "turn", role="user")


@register("SELECT page_id, url, (SELECT count(*) FROM conversations WHERE conv_id = page_id) AS n_messages FROM pages")
def page_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their number of messages."""
    messages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"))
    return V.listing(table(spark, sf_dir, "pages").select("page_id", "url"), messages, "page_id")
