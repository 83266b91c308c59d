"""Queries of conversations, citations and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.functions import text as T
from rankframe.operators import conversations as V
from rankframe.plans.common import registering, table

QUERIES: dict = {}
ORACLES: dict = {}
register = registering(QUERIES, ORACLES)


@register("SELECT c.conv_id, c.turn, c.text AS user_query, n.text AS assistant_response FROM conversations c JOIN conversations n ON c.conv_id = n.conv_id AND n.turn = c.turn + 1 AND n.role = 'assistant' WHERE c.role = 'user'")
def turns_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM8: user turns with their answers."""
    return V.turns_paired(table(spark, sf_dir, "conversations"))


@register("WITH s AS (SELECT conv_id, max(turn) AS last_activity, count(*) AS n_messages, min(text) AS first FROM conversations GROUP BY 1) SELECT conv_id, last_activity, n_messages, CASE WHEN length(first) > 50 THEN left(first, 50) || '...' ELSE first END AS title FROM s ORDER BY last_activity DESC, conv_id LIMIT 50")
def chat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty conversations last active."""
    return V.sessions(table(spark, sf_dir, "conversations"), None, "conv_id", "turn", "text")


@register("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the')")
def conversation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E29."""
    return V.searched(table(spark, sf_dir, "conversations"), "the", "text").select("conv_id", "turn")


@register("SELECT role, count(*) AS n, round(avg(length(text)), 6) AS avg_chars, sum((turn < 3)::INT)::BIGINT AS n_early FROM conversations GROUP BY 1")
def conversation_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E28."""
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 6).alias("avg_chars"), F.sum((F.col("turn") < 3).cast("long")).alias("n_early"))


@register("SELECT date_trunc('hour', ts)::VARCHAR AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def activity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity by hour."""
    return table(spark, sf_dir, "events").groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@register(
    """SELECT user_id, arg_min(event_type, struct_pack(a := ts, b := event_type)) AS event_type, arg_max(value, struct_pack(a := ts, b := value)) AS value, floor(epoch(min(ts)))::BIGINT AS registered_at, floor(epoch(max(ts)))::BIGINT AS updated_at FROM events GROUP BY 1"""
)
def page_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first kind of event and the last value of each user."""
    found = V.upserted(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", ("event_type",), ("value",))
    return found.select("user_id", "event_type", "value", F.unix_seconds("registered_at").alias("registered_at"), F.unix_seconds("updated_at").alias("updated_at"))


@register("WITH n AS (SELECT page_id, 'doc_' || (page_id % 40) || '.pdf' AS name FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id) - 1 AS n FROM n) SELECT page_id, CASE WHEN n > 0 THEN replace(name, '.pdf', '') || '_' || n || '.pdf' ELSE name END AS object_name FROM r")
def object_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17."""
    names = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("doc_"), (F.col("page_id") % 40).cast("string"), F.lit(".pdf")).alias("name"))
    return V.collision_safe(names, "name", ("page_id",)).select("page_id", "object_name")


@register("WITH n AS (SELECT doc_id, source, text || ' (new)' AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT doc_id, source, text FROM (SELECT doc_id, source, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n) WHERE trim(text) <> ''")
def replaced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New texts of the labelled documents replace the old rows of their key."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return V.replaced(docs, docs.join(labelled, "doc_id", "left_semi").withColumn("text", F.concat("text", F.lit(" (new)"))), "doc_id")


@register("SELECT source, count(*) AS n, count(DISTINCT lang) AS n_langs, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY 1")
def namespace_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16, E22, E24."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("n_langs"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))


@register("WITH u AS (SELECT lang, unnest(['source', 'n_chars', 'text']) AS field, unnest([source, n_chars::VARCHAR, text]) AS value FROM documents) SELECT lang, field, count(nullif(value, '')) AS n_filled, count(DISTINCT value) AS n_distinct FROM u GROUP BY ALL")
def field_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E23, A12."""
    return V.fill_counts(table(spark, sf_dir, "documents"), "lang", ("source", "n_chars", "text"))


@register(r"WITH t AS (SELECT doc_id, source, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source, t ORDER BY doc_id) AS r FROM t WHERE length(t) >= 20) SELECT doc_id, source FROM r WHERE r = 1")
def distinct_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each text of a source, whatever its case and spaces."""
    return V.first_passage(table(spark, sf_dir, "documents"), "source", F.col("text"), ("doc_id",)).select("doc_id", "source")


CITED = "concat('See [', conv_id % 7 + 1, '.', turn % 5 + 1, '] and [', conv_id % 3 + 1, '.1] or [', conv_id % 7 + 1, '.', turn % 5 + 1, '].')"
REFERENCES_SQL = (
    f"an AS (SELECT conv_id * 100 + turn AS answer_id, {CITED} AS text FROM conversations), "
    r"ci AS (SELECT answer_id, i, p FROM (SELECT answer_id, unnest(regexp_extract_all(text, '\[\d+\.\d+\]')) AS p, generate_subscripts(regexp_extract_all(text, '\[\d+\.\d+\]'), 1) AS i FROM an)), "
    "cu AS (SELECT answer_id, min(i) AS ord, regexp_extract(p, '(\\d+)\\.', 1)::INT AS doc_num, regexp_extract(p, '\\.(\\d+)', 1)::INT AS pos FROM ci GROUP BY answer_id, p), "
    "ch AS (SELECT conv_id * 100 + turn AS answer_id, (k % 4) + 1 AS doc_num, (k // 4) + 1 AS pos, 'src' || (k % 4) AS source FROM conversations, range(12) t(k))"
)


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations")
    answers = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), F.expr(CITED).alias("text"))
    chunks = answers.select("answer_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k")).select("answer_id", (F.col("k") % 4 + 1).cast("int").alias("doc_num"), (F.floor(F.col("k") / 4) + 1).cast("int").alias("pos"), F.concat(F.lit("src"), (F.col("k") % 4).cast("string")).alias("source"))
    return answers, chunks


@register(f"WITH {REFERENCES_SQL} SELECT answer_id, doc_num, pos, source, row_number() OVER (PARTITION BY answer_id, doc_num ORDER BY ord) AS display_pos FROM cu JOIN ch USING (answer_id, doc_num, pos)")
def precise_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of an answer resolved to its numbered chunks."""
    return V.references(*_answers(spark, sf_dir)).withColumn("display_pos", F.col("display_pos").cast("long"))


@register(f"WITH {REFERENCES_SQL} SELECT answer_id, doc_num, pos FROM cu WHERE (answer_id, doc_num, pos) NOT IN (SELECT (answer_id, doc_num, pos) FROM ch)")
def orphan_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations that no chunk answers."""
    return V.orphans(*_answers(spark, sf_dir))


@register(r"WITH w AS (SELECT conv_id * 100 + turn AS answer_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM conversations) SELECT answer_id, len(ws) AS total, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS index, regexp_matches(unnest(ws), '^\[\d+\.\d+\]') AS is_citation FROM w")
def answer_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as running words."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), "text")
    return V.segments(c).select("answer_id", F.col("total").cast("long").alias("total"), F.col("index").cast("long").alias("index"), "word", "is_citation")


@register(
    "WITH c AS (SELECT source AS answer_id, ascii(lang)::BIGINT AS category_ord, doc_id AS rank, lang || (doc_id % 6) AS source FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY answer_id, category_ord ORDER BY rank) AS r FROM c), k AS (SELECT *, min(category_ord * 1000000000 + rank) OVER (PARTITION BY answer_id, source) AS f FROM r WHERE r <= 5), "
    "d AS (SELECT *, dense_rank() OVER (PARTITION BY answer_id ORDER BY f) AS doc_num FROM k) SELECT answer_id, rank, source, doc_num, row_number() OVER (PARTITION BY answer_id, doc_num ORDER BY category_ord, rank) AS pos FROM d"
)
def numbered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five chunks of each category, documents numbered across categories."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("source").alias("answer_id"), F.ascii("lang").alias("category_ord"), F.col("doc_id").alias("rank"), F.concat("lang", (F.col("doc_id") % 6).cast("string")).alias("source"))
    return V.numbered(chunks).select("answer_id", "rank", "source", F.col("doc_num").cast("long").alias("doc_num"), F.col("pos").cast("long").alias("pos"))


@register(
    """WITH n AS (SELECT doc_id, CASE WHEN doc_id % 11 = 5 THEN 'doc_' || (doc_id % 3) || '_' || (doc_id % 4 + 1) || '.pdf' ELSE 'doc_' || (doc_id % 3) || '.pdf' END AS name FROM documents)
SELECT count(*) AS n_documents, count(*) AS n_names, count(DISTINCT name) AS n_kept FROM n"""
)
def literal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object names stay distinct where documents are literally called like a numbered one; each name is kept by one document."""
    k = F.col("doc_id")
    base = F.concat(F.lit("doc_"), (k % 3).cast("string"))
    name = F.when(k % 11 == 5, F.concat(base, F.lit("_"), (k % 4 + 1).cast("string"), F.lit(".pdf"))).otherwise(F.concat(base, F.lit(".pdf")))
    found = V.collision_safe(table(spark, sf_dir, "documents").select("doc_id", name.alias("name")), "name", ("doc_id",))
    return found.agg(F.count(F.lit(1)).alias("n_documents"), F.count_distinct("object_name").alias("n_names"), F.count_distinct(F.when(F.col("name") == F.col("object_name"), F.col("name"))).alias("n_kept"))


TOLD_SQL = r"replace(text, '. ', '.' || chr(10) || chr(10)) || CASE conv_id % 4 WHEN 0 THEN '\n\nno LRD document [1.2] found' WHEN 1 THEN chr(10) || chr(10) || 'see past cases [2.1][3.1]' ELSE '' END"


def _told() -> F.Column:
    more = F.when(F.col("conv_id") % 4 == 0, "\\n\\nno LRD document [1.2] found").when(F.col("conv_id") % 4 == 1, "\n\nsee past cases [2.1][3.1]").otherwise("")
    return F.concat(F.replace("text", F.lit(". "), F.lit(".\n\n")), more)


@register(
    f"""WITH a AS (SELECT conv_id * 100 + turn AS answer_id, {TOLD_SQL} AS t FROM conversations), p AS (SELECT answer_id, list_filter(list_transform(string_split(replace(replace(t, '\\n\\n', chr(10) || chr(10)), '\\n', chr(10)), chr(10) || chr(10)), lambda x: list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')), lambda w: len(w) > 0) AS ps FROM a),
e AS (SELECT answer_id, ps, unnest(range(len(ps))) AS paragraph FROM p), f AS (SELECT answer_id, paragraph, ps[paragraph + 1] AS ws, coalesce(list_sum(list_transform(ps[1 : paragraph], lambda w: len(w))), 0) AS before, list_sum(list_transform(ps, lambda w: len(w))) AS total, lower(array_to_string(ps[paragraph + 1], ' ')) AS low FROM e),
w AS (SELECT *, unnest(range(len(ws))) AS i FROM f), z AS (SELECT *, CASE WHEN i > 0 THEN ' ' ELSE '' END || ws[i + 1] AS token FROM w)
SELECT answer_id, paragraph, CASE WHEN contains(low, 'no source 1') OR contains(low, 'no pi document') THEN 'PIS' WHEN contains(low, 'no source 2') OR contains(low, 'no lrd document') THEN 'LRD' WHEN contains(low, 'no source 3') OR contains(low, 'past cases') THEN 'OTHER' WHEN paragraph = 0 THEN 'PIS' WHEN paragraph = 1 THEN 'LRD' ELSE 'OTHER' END AS source_type,
  (before + i)::BIGINT AS index, total::BIGINT AS total_tokens, token, regexp_matches(token, '\\[\\d+\\.\\d+\\]') AS is_citation FROM z"""
)
def answer_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers word by word with the source of each paragraph."""
    told = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), _told().alias("text"))
    return V.tokens(told).withColumns({c: F.col(c).cast("long") for c in ("paragraph", "index", "total_tokens")})


@register(
    """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang, n_chars, doc_id % 2 = 0 AS even, CASE WHEN doc_id % 5 <> 0 THEN [source, NULL, lang] END AS tags FROM documents)
SELECT doc_id, concat_ws(';', 'even=' || even, 'lang=' || lang, 'n_chars=' || n_chars, 'tags=' || CASE WHEN tags IS NOT NULL THEN to_json(list_filter(tags, lambda x: x IS NOT NULL))::VARCHAR END) AS metadata FROM d"""
)
def cleaned_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata without nulls, all values as text."""
    k = F.col("doc_id")
    values = {"even": k % 2 == 0, "lang": F.when(k % 3 != 0, F.col("lang")), "n_chars": F.col("n_chars"), "tags": (F.when(k % 5 != 0, F.array("source", F.lit(None), "lang")), "list")}
    found = table(spark, sf_dir, "documents").select("doc_id", T.cleaned_metadata(values).alias("m"))
    return found.select("doc_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("metadata"))


@register(r"""WITH p AS (SELECT page_id, [regexp_replace(html, '<[^>]*>', ' ', 'g'), url, CASE WHEN page_id % 2 = 0 THEN html END] AS es FROM pages), b AS (SELECT page_id, list_transform(es, lambda x: regexp_replace(coalesce(x, ''), '^\s+|\s+$', '', 'g')) AS bs FROM p) SELECT page_id, length(bs[list_position(list_transform(bs, lambda x: length(x)), list_max(list_transform(bs, lambda x: length(x))))]) AS n_chars, list_position(list_transform(bs, lambda x: length(x)), list_max(list_transform(bs, lambda x: length(x)))) = 3 AS is_raw FROM b""")
def longest_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest of three extractions of each page."""
    pages = table(spark, sf_dir, "pages")
    found = pages.select("page_id", T.longest(F.regexp_replace("html", "<[^>]*>", " "), F.col("url"), F.when(F.col("page_id") % 2 == 0, F.col("html"))).alias("t"), "html")
    return found.select("page_id", F.length("t").cast("long").alias("n_chars"), F.coalesce((F.col("page_id") % 2 == 0) & (F.col("t") == F.regexp_replace("html", r"^\s+|\s+$", "")) & (F.regexp_replace("html", "<[^>]*>", " ") != F.col("html")), F.lit(False)).alias("is_raw"))
