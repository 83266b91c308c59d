"""Queries of the catalogue, of requests and of queries' features over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankframe.functions import queries as Q
from rankframe.functions import text as T
from rankframe.operators import catalogue as C
from rankframe.operators import dense, monitoring
from rankframe.plans.common import registering, table
from rankframe.sources import logs
from rankframe.sources.scratch import scratch

QUERIES: dict = {}
ORACLES: dict = {}
register = registering(QUERIES, ORACLES)

NAMES = ("PI", " prescribing information ", "Label-Data", "history", "product label", "leaflet", "")
PLACES = ("us", "Europe", " EU", "uk", "global", "fr", "")


def _named(names: tuple[str, ...]) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int"))


def _list(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + f"][doc_id % {len(names)} + 1]"


def _values(rows: dict) -> str:
    return ", ".join("('" + k + "', [" + ", ".join(f"'{v}'" for v in vs) + "])" for k, vs in rows.items())


@register(
    f"""WITH d AS (SELECT doc_id, {_list(NAMES)} AS name, lower(trim({_list(NAMES)})) AS n FROM documents), t AS (SELECT * FROM (VALUES {_values(Q.DOCUMENT_TYPES)}) v(canonical, names)),
u AS (SELECT canonical, unnest(list_distinct(list_append(names, canonical))) AS n FROM t), e AS (SELECT canonical, list_sort(list_distinct(list(lower(n)) || list(upper(n)))) AS variants FROM u GROUP BY 1)
SELECT doc_id, CASE WHEN name <> '' THEN coalesce(u.canonical, n) END AS canonical, CASE WHEN name = '' THEN '' ELSE array_to_string(coalesce(variants, [n, upper(n)]), '|') END AS variants FROM d LEFT JOIN u USING (n) LEFT JOIN e ON e.canonical = u.canonical"""
)
def document_type_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type that each document's label stands for, and all its names."""
    found = table(spark, sf_dir, "documents").select("doc_id", Q.document_type(_named(NAMES)).alias("t"))
    return found.select("doc_id", "t.canonical", F.array_join("t.variants", "|").alias("variants"))


@register(
    f"""WITH d AS (SELECT doc_id, {_list(PLACES)} AS name FROM documents), r AS (SELECT canonical, list_sort(list_distinct(list_append(names, upper(canonical)))) AS variants FROM (VALUES {_values(Q.REGIONS)}) v(canonical, names))
SELECT doc_id, CASE WHEN name <> '' THEN CASE WHEN variants IS NULL THEN upper(name) ELSE upper(trim(name)) END END AS canonical, CASE WHEN name = '' THEN '' ELSE array_to_string(coalesce(variants, [upper(name)]), '|') END AS variants FROM d LEFT JOIN r ON lower(trim(name)) = r.canonical"""
)
def region_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region that each document's label stands for, and its aliases."""
    found = table(spark, sf_dir, "documents").select("doc_id", Q.region(_named(PLACES)).alias("t"))
    return found.select("doc_id", "t.canonical", F.array_join("t.variants", "|").alias("variants"))


@register(f"SELECT doc_id FROM documents WHERE lower(trim({_list(NAMES)})) = 'pi'")
def typed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3."""
    return table(spark, sf_dir, "documents").where(Q.of_type(_named(NAMES), " Pi ")).select("doc_id")


@register("WITH r AS (SELECT source, CASE WHEN n_chars % 2 = 0 THEN ' ' ELSE text END AS t, row_number() OVER (PARTITION BY source ORDER BY n_chars % 2, doc_id) AS rank FROM documents) SELECT source, coalesce(bool_or(rank <= 15 AND trim(t) <> ''), false) AS has_content FROM r GROUP BY 1")
def content_in_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: whether one of the first fifteen hits of each source has text."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.col("n_chars") % 2, "doc_id"))
    hits = table(spark, sf_dir, "documents").select("source", F.when(F.col("n_chars") % 2 == 0, " ").otherwise(F.col("text")).alias("t"), rank.alias("rank"))
    return hits.groupBy("source").agg(Q.has_content(F.col("t"), F.col("rank")).alias("has_content"))


_PARTS = r"regexp_replace(q, '([^\p{L}\p{N}_])', '\1\1', 'g')"
FEATURES_SQL = (
    r"WITH x AS (SELECT doc_id, lower(left(text, 400) || CASE doc_id % 5 WHEN 0 THEN ' dose of warfarin 5 mg, side effects and risk?' WHEN 1 THEN ' liver test in children q8h' WHEN 2 THEN ' fda half-life ecg' ELSE '' END) AS q FROM documents), y AS (SELECT *, ' ' || " + _PARTS + r" || ' ' AS z FROM x) "
    "SELECT doc_id, len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')) AS length, ends_with(q, '?') AS has_question_mark, regexp_matches(q, '^(what|how|why|when|where|which)') AS starts_with_wh, "
    + ", ".join(rf"regexp_matches(' ' || q || ' ', '[^\p{{L}}\p{{N}}_]({p})[^\p{{L}}\p{{N}}_]') AS {n}" for n, p in Q.FEATURE_TERMS.items())
    + ", "
    + ", ".join(rf"len(regexp_extract_all(z, '[^\p{{L}}\p{{N}}_]({Q.FEATURE_TERMS[of].replace(' ', '  ')})[^\p{{L}}\p{{N}}_]')) AS {n}" for n, of in Q.COUNTED.items())
    + " FROM y"
)


def _asked() -> F.Column:
    more = F.when(F.col("doc_id") % 5 == 0, " dose of warfarin 5 mg, side effects and risk?").when(F.col("doc_id") % 5 == 1, " liver test in children q8h").when(F.col("doc_id") % 5 == 2, " fda half-life ecg").otherwise("")
    return F.concat(F.left("text", F.lit(400)), more)


@register(FEATURES_SQL)
def query_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen flags and three counts of queries made of each document's start and some terms."""
    found = table(spark, sf_dir, "documents").select("doc_id", Q.features(_asked()).alias("f")).select("doc_id", "f.*")
    return found.select("doc_id", F.col("length").cast("long").alias("length"), *[c for c in found.columns[2:] if c not in Q.COUNTED], *[F.col(c).cast("long").alias(c) for c in Q.COUNTED])


@register(
    "WITH x AS (SELECT doc_id, left(text, 400) || CASE doc_id % 5 WHEN 0 THEN ' dose of warfarin 5 mg, side effects and risk?' WHEN 1 THEN ' liver test in children q8h' WHEN 2 THEN ' fda half-life ecg' ELSE '' END AS q FROM documents) SELECT doc_id, len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')) AS word_count, ends_with(q, '?') AS has_question_mark, "
    + ", ".join("(" + " OR ".join(f"contains(lower(q), '{t}')" for t in ts) + f") AS {n}" for n, ts in Q.FEEDBACK_TERMS.items())
    + ", CASE "
    + " ".join("WHEN " + " OR ".join(f"contains(lower(q), '{t}')" for t in ts) + f" THEN '{n}'" for n, ts in Q.CATEGORIES.items())
    + " ELSE 'general' END AS category FROM x"
)
def query_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a feedback entry keeps of its query, and the query's category."""
    found = table(spark, sf_dir, "documents").select("doc_id", Q.feedback_metadata(_asked()).alias("m"), Q.category(_asked()).alias("category"))
    return found.select("doc_id", F.col("m.word_count").cast("long").alias("word_count"), *[f"m.{c}" for c in ("has_question_mark", *Q.FEEDBACK_TERMS)], "category")


_TITLES = ("5 WARNINGS", "2 Dosage and use", "8.4 Pediatric use", "Description")
_ASKS = ("safety of it", "which dose", "pediatric dose", "cost")


@register(
    f"WITH h AS (SELECT source, ['safety of it', 'which dose', 'pediatric dose', 'cost'][ascii(right(source, 1)) % 4 + 1] AS q, lower({_list(_TITLES)}) AS t FROM documents) SELECT source, round(avg(CASE WHEN contains(q, 'safety') AND (contains(t, 'warning') OR contains(t, 'adverse') OR contains(t, 'contraindication')) OR contains(q, 'dose') AND contains(t, 'dosage') OR contains(q, 'pediatric') AND (contains(t, 'pediatric') OR contains(t, 'children')) THEN 1.0 ELSE 0.0 END), 6) AS section_relevance FROM h GROUP BY 1"
)
def section_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the sections of each source's hits answer its query."""
    asked = F.element_at(F.array(*map(F.lit, _ASKS)), (F.ascii(F.right("source", F.lit(1))) % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.avg(Q.section_relevance(asked, _named(_TITLES))), 6).alias("section_relevance"))


@register("SELECT d.doc_id, source FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id) WHERE coalesce(toxic, 0) <> 1")
def active_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2: documents that no label has removed, newest first."""
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return C.active(table(spark, sf_dir, "documents").join(marks, "doc_id", "left"), F.col("toxic") == 1, "doc_id", "source").select("doc_id", "source")


REQUEST_SQL = """WITH r AS (SELECT doc_id, doc_id % 7 AS k, doc_id % 3 = 0 AS has_file FROM documents), s AS (SELECT doc_id, k, has_file, CASE k WHEN 0 THEN 'api' WHEN 1 THEN 'upload' WHEN 2 THEN 'manual' WHEN 3 THEN 'manual' WHEN 4 THEN 'mail' END AS source_type FROM r),
e AS (SELECT doc_id, source_type, list_filter([CASE WHEN k = 6 THEN 'not a JSON object' END, CASE WHEN k = 5 THEN 'missing source_type' END, CASE WHEN k = 4 THEN 'unknown source_type' END, CASE WHEN k = 1 AND NOT has_file THEN 'file needed' END, CASE WHEN k = 3 THEN 'text needed' END], lambda x: x IS NOT NULL) AS errors FROM s)
SELECT doc_id, source_type, CASE WHEN len(errors) = 0 THEN source_type END AS route, array_to_string(errors, ',') AS errors FROM e"""


@register(REQUEST_SQL)
def ingestion_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: a request made of each document, of every kind and with every error."""
    k = F.col("doc_id") % 7
    kind = F.when(k == 0, "api").when(k == 1, "upload").when(k.isin(2, 3), "manual").when(k == 4, "mail")
    body = F.to_json(F.struct(F.col("doc_id").cast("string").alias("instance_id"), F.col("source").alias("document_type"), kind.alias("source_type"), F.when(k == 2, F.left("text", F.lit(20))).alias("manual_text")))
    requests = table(spark, sf_dir, "documents").select("doc_id", F.when(k == 6, "{broken").otherwise(body).alias("body"), (F.col("doc_id") % 3 == 0).alias("has_file"))
    return C.validated(requests).select("doc_id", "source_type", "route", F.array_join("errors", ",").alias("errors"))


@register("SELECT p.page_id, p.url, c.turn, c.text FROM pages p LEFT JOIN (SELECT conv_id AS page_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) c ON p.page_id = c.page_id AND r <= 3")
def page_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turns of each page; a page without any is there too."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), "turn", "text")
    return C.histories(table(spark, sf_dir, "pages").select("page_id", "url"), turns, "page_id", "turn", 3).select("page_id", "url", "turn", "text")


@register("WITH s AS (SELECT conv_id AS page_id, max(turn) AS last_activity, count(*) AS n_messages, min(text) AS first_message FROM conversations GROUP BY 1) SELECT page_id, last_activity, n_messages, first_message, CASE WHEN page_id % 2 = 0 THEN url WHEN length(first_message) > 50 THEN left(first_message, 50) || '...' ELSE first_message END AS title FROM s JOIN pages USING (page_id) ORDER BY last_activity DESC, page_id LIMIT 50")
def page_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty pages last active, by their titles or first messages."""
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "page_id")
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("").alias("title"))
    return C.page_sessions(turns, pages, "page_id", "turn", "text")


@register(
    """WITH e AS (SELECT user_id, event_type, value, ts FROM events), c AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL), m AS (SELECT user_id, arg_min(event_type, struct_pack(a := -n, b := event_type)) AS category FROM c GROUP BY 1)
SELECT user_id, count(*) AS n, round(avg(length(event_type)), 6) AS avg_chars, category, count(*) FILTER (ts > TIMESTAMP '2024-01-20' - INTERVAL 10 DAY AND ts <= TIMESTAMP '2024-01-20') AS n_recent FROM e JOIN m USING (user_id) GROUP BY user_id, category"""
)
def page_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of each user as a page, their commonest kind and the recent ones."""
    found = C.page_analytics(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "event_type", F.col("event_type"), "ts", F.lit("2024-01-20").cast("timestamp"), 10)
    return found.select("user_id", "n", F.round("avg_chars", 6).alias("avg_chars"), "category", "n_recent")


@register("SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, event_type, count(*) AS n, count(DISTINCT hour(ts)) AS n_hours FROM events GROUP BY ALL")
def daily_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E30 by day."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.hour(ts)).alias("n_hours"))


@register(
    """WITH h AS (SELECT source AS query, d.doc_id, quality = 1 AS relevant, row_number() OVER (PARTITION BY source ORDER BY d.doc_id) AS rank FROM documents d JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id))
SELECT query, array_to_string(list(doc_id ORDER BY rank) FILTER (relevant), ',') AS positive_docs, array_to_string(list(doc_id ORDER BY rank), ',') AS all_retrieved FROM h WHERE rank <= 20 GROUP BY 1 HAVING count(*) FILTER (relevant) >= 2"""
)
def training_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives and all hits of queries with two relevant ones at least."""
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    hits = table(spark, sf_dir, "documents").select("doc_id", "source").join(marks, "doc_id").select(F.col("source").alias("query"), "doc_id", (F.col("quality") == 1).alias("relevant"), rank.alias("rank"))
    found = C.training_export(hits, 2)
    return found.select("query", F.array_join(F.col("positive_docs").cast("array<string>"), ",").alias("positive_docs"), F.array_join(F.col("all_retrieved").cast("array<string>"), ",").alias("all_retrieved"))


@register("WITH b AS (SELECT user_id % 50 AS monitor, avg(value) AS baseline, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1 HAVING count(*) >= 10) SELECT monitor, round(baseline, 6) AS baseline, n FROM b")
def stored_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: baselines written and read again."""
    events = table(spark, sf_dir, "events").withColumn("failed", F.col("event_type") == "error").withColumn("monitor", F.col("user_id") % 50)
    path = scratch(spark, "baseline")
    logs.store_baseline(monitoring.baseline(events, F.col("failed"), "value", "monitor"), path)
    return logs.load_baseline(spark, path).select("monitor", F.round("baseline", 6).alias("baseline"), "n")


@register(
    r"""WITH a AS (SELECT conv_id * 100 + turn AS answer_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+|\n\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM conversations) SELECT answer_id, len(s) AS total, generate_subscripts(s, 1) - 1 AS index, unnest(s) AS sentence FROM a"""
)
def answer_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as their sentences."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), "text")
    return C.sentences(c).select("answer_id", F.col("total").cast("long").alias("total"), F.col("index").cast("long").alias("index"), "sentence")


@register()
def embedded_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages against all documents by hashed embeddings, whole and halved, as two search functions; the ten nearest of each."""
    docs = C.embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", T.hashed_embedding).drop("text")
    queries = C.embedded(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "text", T.hashed_embedding)

    def search(most: int):
        def run(q: DataFrame) -> DataFrame:
            cut = q.withColumn("embedding", F.slice("embedding", 1, most))
            return dense.nearest(docs.withColumn("embedding", F.slice("embedding", 1, most)), cut, 10)

        return run

    return C.compared(queries, {"whole": search(64), "half": search(32)}).withColumn("score", F.round("score", 4))
