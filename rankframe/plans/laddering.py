"""Queries of search in stages, past cases by user and phrase concepts, with their SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from rankframe.functions import intents as I
from rankframe.functions import text as T
from rankframe.operators import corpus, ladder
from rankframe.operators import scoring as S
from rankframe.operators import search as H
from rankframe.plans import catalogue, composed, scoring
from rankframe.plans.common import STOP_LIST, registering, table
from rankframe.plans.retrieval import BM25_SQL, _passages
from rankframe.sources.scratch import written

QUERIES: dict = {}
ORACLES: dict = {}
register = registering(QUERIES, ORACLES)
K = 10


@F.arrow_udf(ArrayType(DoubleType()))
def _counts(low: pa.Array) -> pa.Array:
    values = low.cast(pa.large_string())
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    at = np.flatnonzero((raw >= 97) & (raw <= 122))  # bytes of ASCII letters stand in no other character
    row = np.searchsorted(offsets - offsets[0], at, side="right") - 1
    counts = np.bincount(26 * row + (raw[at] - 97), minlength=26 * len(values)).astype(np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * 26), pa.array(counts))


def letters(text: Column) -> Column:
    """A fixture embedding that SQL can express: how often each letter from a to z stands in the text."""
    return _counts(F.lower(F.coalesce(text, F.lit(""))))


def _letters(text: str) -> str:
    return f"list_transform(range(97, 123), lambda c: (length(lower({text})) - length(replace(lower({text}), chr(c::INT), '')))::DOUBLE)"


def _source(n: int) -> Column:
    return F.concat(F.lit("src"), ((F.col("query_id") + n) % 25).cast("string"))


def _asked(queries: DataFrame) -> DataFrame:
    """Filters of each kind: met ones, an unknown region, an unknown type with and without another way, and none at all; some by user."""
    own, turn = F.array(_source(0), _source(7)), F.col("query_id") % 5
    none = F.array(F.lit("none"))
    return queries.select(
        "query_id", "text", letters(F.col("text")).alias("embedding"), F.when(turn == 3, "pis").otherwise("report").alias("kind"), F.when(turn < 2, own).when(turn < 4, none).alias("document_type"),
        F.when(turn == 0, F.when(F.col("query_id") % 2 == 0, F.array(F.lit("en"))).otherwise(F.array(F.lit("de"), F.lit("fr")))).when(turn == 1, F.array(F.lit("xx"))).when(turn == 2, F.array(F.lit("de"))).alias("region"),
        F.when(F.col("query_id") % 7 == 0, F.array(F.lit("u1"), F.lit("u2"))).alias("user_id"),
    )


ASKED_SQL = f"""lq AS MATERIALIZED (SELECT item_id AS query_id, text, {_letters('text')} AS e, CASE WHEN item_id % 5 = 3 THEN 'pis' ELSE 'report' END AS kind,
  CASE WHEN item_id % 5 < 2 THEN ['src' || (item_id % 25), 'src' || ((item_id + 7) % 25)] WHEN item_id % 5 < 4 THEN ['none'] END AS types,
  CASE item_id % 5 WHEN 0 THEN CASE WHEN item_id % 2 = 0 THEN ['en'] ELSE ['de', 'fr'] END WHEN 1 THEN ['xx'] WHEN 2 THEN ['de'] END AS regions, CASE WHEN item_id % 7 = 0 THEN ['u1', 'u2'] END AS users FROM benchmark)"""
DOCS_SQL = f"ld AS MATERIALIZED (SELECT doc_id, text, {_letters('text')} AS e, source AS kind, lang AS region, 'u' || (doc_id % 5) AS usr, source AS section FROM documents WHERE text IS NOT NULL)"
PAST_SQL = f"ld AS MATERIALIZED (SELECT conv_id * 100 + turn AS doc_id, text, {_letters('text')} AS e, CASE role WHEN 'assistant' THEN 'past_cases' ELSE 'question' END AS kind, NULL::VARCHAR AS region, 'u' || (conv_id % 9) AS usr, role AS section FROM conversations WHERE text IS NOT NULL)"
PAST_ASKED_SQL = f"lq AS MATERIALIZED (SELECT item_id AS query_id, text, {_letters('text')} AS e, 'past_cases' AS kind, ['past_cases'] AS types, NULL::VARCHAR[] AS regions, ['u' || (item_id % 9)] AS users FROM benchmark)"


def ladder_sql(asked: str, docs: str) -> str:
    """CTEs of the whole search: every query against every document, level by level."""

    def hits(name: str, queries: str, types: str, regions: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT q.*, d.doc_id, list_cosine_similarity(q.e, d.e) AS s FROM ({queries}) q JOIN ld d ON ({types} IS NULL OR list_contains({types}, d.kind)) AND ({regions} IS NULL OR list_contains({regions}, d.region)) AND (q.users IS NULL OR list_contains(q.users, d.usr))
  WHERE list_sum(q.e) > 0 AND list_sum(d.e) > 0 QUALIFY row_number() OVER (PARTITION BY q.query_id, q.ord ORDER BY round(s, 9) DESC, d.doc_id) <= {K})"""

    base = "SELECT *, 0 AS ord FROM lq"
    fixed = ", ".join(f"'{t}'" for t in ladder.FIXED_TYPES)
    return f"""{docs}, {asked},
{hits('b0', base, 'q.types', 'q.regions')},
{hits('b1', base + ' WHERE regions IS NOT NULL AND query_id NOT IN (SELECT query_id FROM b0)', 'q.types', 'NULL::VARCHAR[]')},
{hits('b2', base + f' WHERE types IS NOT NULL AND kind NOT IN ({fixed}) AND query_id NOT IN (SELECT query_id FROM b0) AND query_id NOT IN (SELECT query_id FROM b1)', 'NULL::VARCHAR[]', 'q.regions')},
bs AS (SELECT *, 0 AS level FROM b0 UNION ALL SELECT *, 1 FROM b1 UNION ALL SELECT *, 2 FROM b2),
br AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM bs),
lv AS MATERIALIZED (SELECT lq.*, coalesce(l, 0) AS level, coalesce(n, 0) AS n_base, coalesce(n, 0) < {max(3, K // 2)} AS short FROM lq LEFT JOIN (SELECT query_id, max(level) AS l, count(*) AS n FROM bs GROUP BY 1) USING (query_id)),
tc AS MATERIALIZED ({composed.ORACLES['term_corpus']}), td AS (SELECT term AS doc_id, term AS text FROM tc),
ph AS MATERIALIZED (WITH {BM25_SQL.replace('FROM documents', 'FROM td')} SELECT query_id, doc_id AS term, score FROM sc WHERE score > 0),
bt AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, term) AS rank FROM ph WHERE query_id IN (SELECT query_id FROM lv WHERE short) QUALIFY rank <= 5),
qw AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) AS term FROM benchmark),
fw AS (SELECT query_id, unnest(regexp_extract_all(lower(d.text), '[a-z]{{2,}}')) AS term FROM br JOIN ld d USING (doc_id) WHERE rank <= 3),
ft AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, term) AS rank FROM fw WHERE term NOT IN ({STOP_LIST}) AND (query_id, term) NOT IN (SELECT (query_id, term) FROM qw) GROUP BY query_id, term QUALIFY rank <= 5),
cn AS (SELECT query_id, synonym AS term, rank FROM ({scoring.ORACLES['concept_variants']})),
vr AS (SELECT query_id, 0 AS ord, 'base' AS source, '' AS term FROM lq UNION ALL SELECT query_id, rank, 'concept', term FROM cn UNION ALL SELECT query_id, rank + 100, 'prf', term FROM ft UNION ALL SELECT query_id, rank + 200, 'bm25', term FROM bt),
vx AS (SELECT query_id, ord, source, trim(text || ' ' || term) AS text FROM vr JOIN lq USING (query_id)),
vd AS MATERIALIZED (SELECT query_id, min(ord) AS ord, arg_min(source, ord) AS source, arg_min(text, ord) AS text FROM vx GROUP BY query_id, lower(text)),
vq AS MATERIALIZED (SELECT vd.query_id, vd.ord, {_letters('vd.text')} AS e, CASE WHEN level <> 2 THEN types END AS types, CASE WHEN level <> 1 THEN regions END AS regions, users FROM vd JOIN lv USING (query_id) WHERE ord > 0),
{hits('vh', 'SELECT * FROM vq', 'q.types', 'q.regions')},
fo AS MATERIALIZED (SELECT query_id, 0 AS ord, doc_id, s FROM bs UNION ALL SELECT query_id, ord, doc_id, s FROM vh),
fv AS (SELECT query_id, doc_id, min(ord) AS ord, arg_min(s, ord) AS score FROM fo GROUP BY ALL),
al AS ({scoring.ORACLES['query_alpha']}),
fh AS (SELECT fv.*, d.text, d.section, al.alpha, list_filter(regexp_extract_all(lower(lq.text), '[a-z]{{2,}}'), lambda x: NOT list_contains([{STOP_LIST}], x)) AS query_tokens, query_id IN (SELECT query_id FROM ph) AS has FROM fv JOIN ld d USING (doc_id) JOIN lq USING (query_id) JOIN al USING (query_id)),
bo AS (SELECT query_id, doc_id, sum(CASE WHEN contains(lower(text), term) THEN p.score ELSE 0 END) AS boost FROM fh JOIN ph p USING (query_id) GROUP BY ALL),
fq AS (SELECT fh.*, coalesce(boost, 0) AS boost, length(text) AS n, len(query_tokens) AS asked, len(list_filter(query_tokens, lambda t: contains(lower(text), t))) AS found FROM fh LEFT JOIN bo USING (query_id, doc_id)),
fs AS (SELECT *, CASE WHEN has THEN alpha * score + (1 - alpha) * boost / 10 END AS hybrid, greatest(-0.4, least(0.85, CASE WHEN n BETWEEN 400 AND 1200 THEN 0.2 WHEN n < 200 THEN -0.15 WHEN n > 1600 THEN -0.1 ELSE 0.0 END + CASE WHEN asked = 0 THEN 0.0 WHEN found > 0 THEN least(0.2, 0.25 * found / asked) ELSE -0.18 END + CASE WHEN contains(section, 'src1') THEN 0.25 WHEN contains(section, 'src2') THEN 0.15 ELSE 0.0 END))::DOUBLE AS quality FROM fq),
fr AS (SELECT *, coalesce(hybrid, score) * (1 + quality) AS final, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(hybrid, score) * (1 + quality), 9) DESC, doc_id) AS rank FROM fs QUALIFY rank <= {K}),
vn AS (SELECT query_id, string_agg(source || ':' || coalesce(n, 0), ',' ORDER BY ord) AS variants FROM vd LEFT JOIN (SELECT query_id, ord, count(*) AS n FROM fo GROUP BY ALL) USING (query_id, ord) GROUP BY 1)"""


HITS_SQL = "SELECT query_id, doc_id, ord::BIGINT AS variant_ord, round(score, 4) AS score, round(boost, 4) AS bm25_boost, round(final, 4) AS final_score, rank FROM fr"
META_SQL = """SELECT query_id, level::BIGINT AS level, level = 1 AS fallback_region, level = 2 AS fallback_type, n_base, short, (SELECT coalesce(string_agg(term, ',' ORDER BY rank), '') FROM cn WHERE cn.query_id = lv.query_id) AS concepts,
  (SELECT coalesce(string_agg(term, ',' ORDER BY rank), '') FROM ft WHERE ft.query_id = lv.query_id) AS prf_terms, (SELECT coalesce(string_agg(term, ',' ORDER BY rank), '') FROM bt WHERE bt.query_id = lv.query_id) AS bm25_terms,
  (SELECT count(*) FROM ph WHERE ph.query_id = lv.query_id) AS n_scored_terms, variants FROM lv JOIN vn USING (query_id)"""


def _search(spark: SparkSession, sf_dir: str, docs: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    corpus = H.term_corpus(table(spark, sf_dir, "documents"), composed.PHRASES, composed.TRIGGERS)
    concepts = scoring.concept_variants(spark, sf_dir).withColumnRenamed("synonym", "term")
    return ladder.search(docs.where("text is not null").withColumn("embedding", letters(F.col("text"))), queries, letters, corpus, concepts, scoring.GROUPS, K, scoring.SECTIONS)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("document_type"), F.col("lang").alias("region"), F.concat(F.lit("u"), (F.col("doc_id") % 5).cast("string")).alias("user_id"), F.col("source").alias("section"))


def _hits(found: DataFrame) -> DataFrame:
    return found.select("query_id", "doc_id", F.col("ord").cast("long").alias("variant_ord"), *[F.round(c, 4).alias(c) for c in ("score", "bm25_boost", "final_score")], F.col("rank").cast("long").alias("rank"))


@register(f"WITH {ladder_sql(ASKED_SQL, DOCS_SQL)} {HITS_SQL}")
def ladder_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters relaxed where they leave nothing, concept, feedback and phrase variants, blended, rated and cut."""
    return _hits(_search(spark, sf_dir, _documents(spark, sf_dir), _asked(_passages(spark, sf_dir)))[0])


@register(f"WITH {ladder_sql(ASKED_SQL, DOCS_SQL)} {META_SQL}")
def ladder_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stages of the search each query came to, and what they added."""
    meta = _search(spark, sf_dir, _documents(spark, sf_dir), _asked(_passages(spark, sf_dir)))[1]
    counts = F.array_join(F.transform("variants", lambda v: F.concat_ws(":", v["source"], v["n_hits"].cast("string"))), ",")
    return meta.select("query_id", F.col("level").cast("long").alias("level"), "fallback_region", "fallback_type", "n_base", "short", *[F.array_join(c, ",").alias(c) for c in ("concepts", "prf_terms", "bm25_terms")], "n_scored_terms", counts.alias("variants"))


@register(f"WITH {ladder_sql(PAST_ASKED_SQL, PAST_SQL)} {HITS_SQL}")
def past_case_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search among a user's own past cases, a type whose filter is never dropped; cases are the answers of conversations."""
    c = table(spark, sf_dir, "conversations")
    docs = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "text", F.when(F.col("role") == "assistant", "past_cases").otherwise("question").alias("document_type"), F.lit(None).cast("string").alias("region"), F.concat(F.lit("u"), (F.col("conv_id") % 9).cast("string")).alias("user_id"), F.col("role").alias("section"))
    user = F.array(F.concat(F.lit("u"), (F.col("query_id") % 9).cast("string")))
    queries = _passages(spark, sf_dir).select("query_id", "text", letters(F.col("text")).alias("embedding"), F.lit("past_cases").alias("kind"), F.array(F.lit("past_cases")).alias("document_type"), F.lit(None).cast("array<string>").alias("region"), user.alias("user_id"))
    return _hits(_search(spark, sf_dir, docs, queries)[0])


#: Fixture: what is asked behind a user's turn, so that every intent, kind of rule and reason is met.
PHRASES = (
    "side effects and risk for the heart in children?", "what is the dose, 5 mg twice daily", "tell me about warfarin", "how to treat asthma by therapy", "interaction with other drug", "nausea and headache after it",
    "under 12 years baby", "for old people", "breast milk while pregnant", "avoid, not recommended", "half-life and clearance", "monitor the ecg and liver test", "", "fda approved labeling",
    "pediatric dose for a child", "renal toxicity warning, is it safe", "how much to give", "hepatic adverse reactions of warfarin",
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _intent_sql() -> str:
    """Every rule as a row, joined with every query; word borders as in the features' SQL."""
    phrases = ", ".join(map(_quoted, PHRASES))
    features = catalogue.FEATURES_SQL.replace(catalogue.FEATURES_SQL[catalogue.FEATURES_SQL.index("WITH x AS (") : catalogue.FEATURES_SQL.index(", y AS (")], f"WITH x AS (SELECT conv_id * 100 + turn AS doc_id, lower(trim(text || ' ' || ([{phrases}])[(conv_id + turn) % {len(PHRASES)} + 1])) AS q FROM conversations WHERE role = 'user')")
    border = r"[^\p{L}\p{N}_]"
    held = lambda r: f"regexp_matches(' ' || q || ' ', {_quoted(r.condition.replace(chr(92) + 'b', border))})" if r.kind == "pattern" else f"contains(q, {_quoted(r.condition)})" if r.kind == "keyword" else f"({r.condition})"
    rules = " UNION ALL ".join(f"SELECT doc_id, {I.INTENTS.index(r.intent)} AS ord, {r.weight}::DOUBLE AS w FROM g WHERE {held(r)}" for r in I.RULES)
    names = ", ".join(f"({n}, {_quoted(i)})" for n, i in enumerate(I.INTENTS))
    said = ", ".join(f"CASE WHEN intent = {_quoted(i)} AND ({c}) THEN {_quoted(w)} END" for i, c, w in I.REASONS)
    return f"""WITH f AS MATERIALIZED ({features}), x2 AS (SELECT conv_id * 100 + turn AS doc_id, lower(trim(text || ' ' || ([{phrases}])[(conv_id + turn) % {len(PHRASES)} + 1])) AS q FROM conversations WHERE role = 'user'), g AS MATERIALIZED (SELECT * FROM f JOIN x2 USING (doc_id)),
m AS MATERIALIZED ({rules}), i(ord, intent) AS (VALUES {names}),
s AS (SELECT g.doc_id, i.ord, i.intent, coalesce(sum(w), 0.0) AS score FROM g CROSS JOIN i LEFT JOIN m ON m.doc_id = g.doc_id AND m.ord = i.ord GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS r FROM s),
t AS (SELECT doc_id, max(CASE WHEN r = 1 THEN intent END) AS intent, max(score) AS score, round(CASE WHEN sum(score) > 0 THEN max(score) / sum(score) ELSE 0.5 END, 6) AS confidence, string_agg(intent || ':' || round(score, 1), ',' ORDER BY r) FILTER (WHERE r > 1) AS alternatives FROM k WHERE r <= 3 GROUP BY 1)
SELECT t.* RENAME (doc_id AS turn_id), 'Classified as ' || replace(intent, '_', ' ') || ' because: ' || coalesce(nullif(concat_ws('; ', {said}), ''), {_quoted(I.NO_REASON)}) AS reasoning, (SELECT count(*) FROM m WHERE m.doc_id = t.doc_id) AS n_rules,
  CASE intent {' '.join(f"WHEN {_quoted(i)} THEN {k}" for i, k, *_ in I.STRATEGIES)} ELSE 10 END::BIGINT AS top_k, intent <> 'dosing_inquiry' AS expand_query, CASE intent {' '.join(f"WHEN {_quoted(i)} THEN {_quoted(x)}" for i, *_, x in I.STRATEGIES)} ELSE '' END AS sections
FROM t JOIN g USING (doc_id)"""


@register(_intent_sql())
def classified_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen intents by pattern, keyword, feature and context, with two alternatives, reasons and what to fetch."""
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), ((F.col("conv_id") + F.col("turn")) % len(PHRASES) + 1).cast("int"))
    asked = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null").select((F.col("conv_id") * 100 + F.col("turn")).alias("turn_id"), F.concat_ws(" ", "text", phrase).alias("text"))
    found = H.strategies(I.classified(asked), I.STRATEGIES)
    named = F.array_join(F.transform("alternatives", lambda a: F.concat_ws(":", a["intent"], a["score"].cast("string"))), ",")
    return found.select("turn_id", "intent", "score", F.round("confidence", 6).alias("confidence"), named.alias("alternatives"), "reasoning", F.col("n_rules").cast("long").alias("n_rules"), F.col("top_k").cast("long").alias("top_k"), "expand_query", "sections")


#: Fixture ontology with synonyms of one to three words, and what stands behind a user's turn.
PHRASE_CONCEPTS = (
    ("infarction", "myocardial infarction"), ("infarction", "acute myocardial infarction"), ("infarction", "heart attack"), ("infarction", "MI"), ("heart", "heart"), ("heart", "cardiac muscle"), ("pain", "chest pain"), ("pain", "angina pectoris"),
    ("pain", "pain"), ("articles", "the"), ("articles", "of the"), ("articles", "une"), ("imaging", "x-ray"), ("imaging", "chest x-ray film"), ("imaging", "radiograph"),
)
TAILS = ("a heart attack", "acute myocardial infarction/chest pain", "my heart, an attack", "Chest X-ray film of the heart", "", "x ray", "chest   x-ray")


def _words(text: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


@register(
    f"""WITH u AS (SELECT conv_id * 100 + turn AS query_id, text || ' ' || ([{', '.join(map(_quoted, TAILS))}])[(conv_id + turn) % {len(TAILS)} + 1] AS text FROM conversations WHERE role = 'user'),
c AS (SELECT DISTINCT concept, array_to_string({_words('synonym')}, ' ') AS phrase FROM (VALUES {', '.join(f"({_quoted(a)}, {_quoted(b)})" for a, b in PHRASE_CONCEPTS)}) v(concept, synonym)),
w AS (SELECT query_id, {_words('text')} AS ws FROM u),
g AS (SELECT query_id, n, unnest(range(greatest(len(ws) - n + 1, 0))) AS pos, ws FROM w, (VALUES (1), (2), (3)) l(n)),
m AS (SELECT DISTINCT query_id, pos, n, phrase FROM (SELECT query_id, pos, n, array_to_string(ws[pos + 1 : pos + n], ' ') AS phrase FROM g) JOIN c USING (phrase)),
o AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m y WHERE y.query_id = m.query_id AND y.n > m.n AND y.pos <= m.pos AND y.pos + y.n >= m.pos + m.n)),
e AS (SELECT DISTINCT o.query_id, s.phrase FROM o JOIN c USING (phrase) JOIN c s ON s.concept = c.concept JOIN u ON u.query_id = o.query_id WHERE NOT contains(lower(u.text), s.phrase))
SELECT query_id, phrase AS synonym, row_number() OVER (PARTITION BY query_id ORDER BY phrase) AS rank FROM e QUALIFY rank <= 6"""
)
def phrase_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R11 with synonyms of several words: the longest phrase that stands in a turn names the concept."""
    tail = F.element_at(F.array(*map(F.lit, TAILS)), ((F.col("conv_id") + F.col("turn")) % len(TAILS) + 1).cast("int"))
    asked = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.concat_ws(" ", "text", tail).alias("text"))
    concepts = spark.createDataFrame(PHRASE_CONCEPTS, "concept string, synonym string")
    return S.phrase_concepts(asked, concepts).select("query_id", "synonym", F.col("rank").cast("long").alias("rank"))


#: Fixture: the documents as an earlier state knew them: without every third one of three sources, without one source, and with a source that is gone.
CHANGED = ("src1", "src2", "src3")
NOW = "2024-06-01 12:00:00"


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("source") != "src5", F.col("source")).alias("part"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("changed"))
    before = docs.where(~(F.coalesce(F.col("part").isin(*CHANGED), F.lit(False)) & (F.col("doc_id") % 3 == 0)) & F.coalesce(F.col("part") != "src4", F.lit(True)))
    return docs, before.unionByName(docs.where("part = 'src6'").withColumn("part", F.lit("gone")))


def _refreshed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, before = _states(spark, sf_dir)
    now = F.lit(NOW).cast("timestamp")
    old = F.when(F.col("part") == "src7", now - F.expr("interval 3601 seconds")).otherwise(now - F.expr("interval 3600 seconds"))
    store = written(corpus.counted(before, "part", "changed", composed.PHRASES, composed.TRIGGERS, old), "store")
    return corpus.refreshed(store, docs, "part", "changed", composed.PHRASES, composed.TRIGGERS, now)


@register(composed.ORACLES["term_corpus"])
def refreshed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term corpus after a refresh of an earlier state equals a full build."""
    return corpus.merged(_refreshed(spark, sf_dir)[0])


@register(
    """WITH d AS (SELECT doc_id, nullif(source, 'src5') AS part FROM documents), n AS (SELECT part, CASE WHEN part = 'src4' THEN 'new' WHEN part IN ('src1', 'src2', 'src3') AND count(*) FILTER (WHERE doc_id % 3 = 0) = count(*) THEN 'new' WHEN part IN ('src1', 'src2', 'src3') AND count(*) FILTER (WHERE doc_id % 3 = 0) > 0 THEN 'changed' WHEN part = 'src7' THEN 'aged' ELSE 'same' END AS state FROM d GROUP BY part)
SELECT state, count(*) AS n_parts, coalesce(string_agg(part, ',' ORDER BY part), '') AS parts FROM (SELECT * FROM n UNION ALL SELECT DISTINCT 'gone', 'gone' FROM d WHERE part = 'src6') GROUP BY 1"""
)
def corpus_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts the refresh counted again, and why; the others were taken over."""
    met = _refreshed(spark, sf_dir)[1]
    return met.groupBy("state").agg(F.count(F.lit(1)).alias("n_parts"), F.array_join(F.array_sort(F.collect_list("part")), ",").alias("parts"))


#: Fixture: what the corpus is built around.
SEEDS = ("the heat of the house", "de la maison et les", "und der die das", "quick brown fox", "que el de los")
SEED_TYPES = ("src1", "src2", "src3")


@register(
    f"""WITH {DOCS_SQL}, sd AS (SELECT s, {_letters('s')} AS e, k FROM (VALUES {', '.join(f'({_quoted(x)})' for x in SEEDS)}) v(s), (VALUES {', '.join(f'({_quoted(x)})' for x in SEED_TYPES)}) t(k)),
sh AS (SELECT doc_id FROM sd JOIN ld ON ld.kind = sd.k WHERE list_sum(ld.e) > 0 QUALIFY row_number() OVER (PARTITION BY s, k ORDER BY round(list_cosine_similarity(sd.e, ld.e), 9) DESC, doc_id) <= 50)
SELECT * FROM ({composed.ORACLES['term_corpus'].replace('FROM documents)', 'FROM documents WHERE doc_id IN (SELECT doc_id FROM sh))', 1)})"""
)
def seeded_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the fifty nearest documents of every seed and type."""
    docs = _documents(spark, sf_dir).where("text is not null").withColumn("embedding", letters(F.col("text")))
    return corpus.seeded(docs, spark.createDataFrame([(s,) for s in SEEDS], "seed string"), SEED_TYPES, letters, composed.PHRASES, composed.TRIGGERS)
