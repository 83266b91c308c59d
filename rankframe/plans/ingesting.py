"""Queries of sections, chunks and their diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.functions import tables
from rankframe.functions import text as T
from rankframe.operators import chunking as C
from rankframe.operators import records
from rankframe.plans import texts
from rankframe.plans.common import dealt, registering, table

QUERIES: dict = {}
ORACLES: dict = {}
register = registering(QUERIES, ORACLES)

LINES_SQL = r"""
l AS (SELECT doc_id, i, trim(line) AS line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
c AS (SELECT *, len(regexp_extract_all(line, '[A-Za-z]')) AS letters, len(regexp_extract_all(line, '[A-Z]')) AS caps, len(list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '')) AS nw, len(regexp_extract_all(line, '(^|\s)[A-Z]')) AS titled FROM l),
h AS (SELECT *, line <> '' AND length(line) <= 150 AND (regexp_matches(line, '^\d') OR (length(line) >= 10 AND letters > 0 AND caps >= 0.7 * letters AND NOT regexp_matches(coalesce(nxt, ''), '^\s*[a-z]')) OR (nw >= 3 AND titled >= 0.6 * nw AND length(coalesce(nxt, '')) < 100) OR regexp_matches(line, '^[-*•]\s*[A-Z]')) AS header FROM c),
g AS (SELECT *, sum(header::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM h),
s AS (SELECT doc_id, sec, coalesce(max(CASE WHEN header THEN line END), '') AS section_title, string_agg(CASE WHEN NOT header AND line <> '' THEN line END, chr(10) ORDER BY i) AS content FROM g GROUP BY ALL)"""


@register(f"WITH {LINES_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS section_index, section_title, content FROM s WHERE content IS NOT NULL")
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, W7."""
    return C.sections(table(spark, sf_dir, "documents")).withColumn("section_index", F.col("section_index").cast("long"))


PACK_SQL = r"""
n AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents),
se AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM n)"""


@register(
    f"""WITH RECURSIVE {PACK_SQL}, st AS (SELECT doc_id, ss, list_transform(ss, lambda x: length(x)) AS ln FROM se WHERE len(ss) > 0),
w AS (
  SELECT doc_id, ss, ln, 0 AS i, 0 AS start, 0 AS size, 0 AS held, NULL::INT AS out_start, NULL::INT AS out_end FROM st
  UNION ALL
  SELECT doc_id, ss, ln, i + 1, CASE WHEN cl THEN greatest(i - least(held, 4), 0) ELSE start END, CASE WHEN cl THEN coalesce(list_sum(ln[i - least(held, 4) + 1 : i]), 0) ELSE size END + ln[i + 1], CASE WHEN cl THEN least(held, 4) ELSE held END + 1,
    CASE WHEN cl THEN start END, CASE WHEN cl THEN i - 1 END
  FROM (SELECT *, (held > 0 AND size + ln[i + 1] > 500 AND size >= 200) OR size >= 750 AS cl FROM w WHERE i < len(ln))),
e AS (SELECT doc_id, ss, out_start AS s, out_end AS e FROM w WHERE out_end IS NOT NULL UNION ALL SELECT doc_id, ss, start, i - 1 FROM w WHERE i = len(ln))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1 AS chunk_index, s::BIGINT AS start_sentence_index, e::BIGINT AS end_sentence_index, array_to_string(ss[s + 1 : e + 1], ' ') AS text FROM e"""
)
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences packed with overlap."""
    made = C.chunks(dealt(table(spark, sf_dir, "documents")))
    return made.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("start_sentence_index").cast("long").alias("start_sentence_index"), F.col("end_sentence_index").cast("long").alias("end_sentence_index"), "text")


@register(
    f"""WITH ck AS ({ORACLES["document_chunks"]}), {PACK_SQL}, un AS (SELECT doc_id, i, ss[i + 1] AS sentence FROM (SELECT doc_id, ss, unnest(range(len(ss))) AS i FROM se)),
ok AS (SELECT un.doc_id, i, bool_or(contains(ck.text, sentence)) AS ok FROM un LEFT JOIN ck ON un.doc_id = ck.doc_id GROUP BY ALL)
SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (ok) AS n_covered, (count(*) FILTER (ok))::DOUBLE / count(*) AS coverage FROM ok GROUP BY 1"""
)
def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each document's sentences stand in some chunk."""
    docs = dealt(table(spark, sf_dir, "documents"))
    return C.coverage(docs, C.chunks(docs))


@register(
    f"""WITH {LINES_SQL}, k AS (SELECT doc_id, content AS text FROM s WHERE content IS NOT NULL), p AS (SELECT lang, doc_id, left(k.text, 80) AS head, count(*) AS n, min(length(k.text)) AS lo, max(length(k.text)) AS hi, sum(length(k.text)) AS chars FROM k JOIN documents USING (doc_id) GROUP BY ALL)
SELECT lang, sum(n)::BIGINT AS n_chunks, min(lo) AS min_chars, max(hi) AS max_chars, round(sum(chars)::DOUBLE / sum(n), 1) AS avg_chars, sum(n - 1)::BIGINT AS n_duplicates FROM p GROUP BY 1"""
)
def section_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K12, K14."""
    docs = table(spark, sf_dir, "documents")
    made = C.sections(docs).select("doc_id", F.col("content").alias("text")).join(docs.select("doc_id", "lang"), "doc_id")
    found = C.statistics(made, "lang").withColumn("avg_chars", F.round("avg_chars", 1))
    return found.select("lang", "n_chunks", F.col("min_chars").cast("long").alias("min_chars"), F.col("max_chars").cast("long").alias("max_chars"), "avg_chars", "n_duplicates")


@register(
    f"""WITH {LINES_SQL}, k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS chunk_index, content AS text, length(content) AS n FROM s WHERE content IS NOT NULL),
i AS (SELECT *, sum((n >= 550 OR chunk_index = 0)::INT) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS island FROM k)
SELECT doc_id, island::BIGINT AS island, min(chunk_index) AS first_index, count(*) AS n_merged, length(string_agg(text, chr(10) ORDER BY chunk_index)) AS char_count FROM i GROUP BY ALL"""
)
def merged_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: small sections join the one before."""
    made = C.sections(table(spark, sf_dir, "documents")).select("doc_id", F.col("section_index").alias("chunk_index"), F.col("content").alias("text")).withColumn("char_count", F.length("text"))
    found = C.merged(made)
    return found.select("doc_id", "island", F.col("first_index").cast("long").alias("first_index"), "n_merged", F.col("char_count").cast("long").alias("char_count"))


SIMPLE_SQL = r"""
d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END AS t FROM documents),
p AS (SELECT doc_id, length(t) AS n, list_transform(string_split(t, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS ps, list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS ss FROM d),
m AS (SELECT *, CASE WHEN NOT (len(ps) = 1 OR (len(ps) = 2 AND ps[2] = '')) THEN 'paragraphs' WHEN n < 100 THEN 'runs' ELSE 'sentences' END AS mode, greatest(1, len(ss) // least(len(ss), greatest(2, len(ss) // 2 + 1))) AS per FROM p),
ru AS (SELECT doc_id, k, regexp_replace(array_to_string(ss[k * per + 1 : k * per + per], ' '), '^\s+|\s+$', '', 'g') AS text FROM (SELECT *, unnest(range((len(ss) + per - 1) // per)) AS k FROM m WHERE mode = 'runs')),
pk AS (SELECT doc_id, mode, CASE mode WHEN 'sentences' THEN ' ' ELSE chr(10) || chr(10) END AS gap, least(500, greatest(n // 3, 50)) AS most, list_filter(CASE mode WHEN 'sentences' THEN ss ELSE ps END, lambda x: x <> '') AS parts FROM m WHERE mode <> 'runs'),
f AS (SELECT doc_id, mode, gap, most, parts, 0 AS i, 0 AS start, 0 AS size, NULL::INT AS os, NULL::INT AS oe FROM pk WHERE len(parts) > 0
  UNION ALL SELECT doc_id, mode, gap, most, parts, i + 1, CASE WHEN fl THEN i ELSE start END, CASE WHEN fl OR size = 0 THEN ln ELSE size + length(gap) + ln END, CASE WHEN fl THEN start END, CASE WHEN fl THEN i - 1 END
  FROM (SELECT *, length(parts[i + 1]) AS ln, size + length(parts[i + 1]) > most AND size > 0 AS fl FROM f WHERE i < len(parts))),
e AS (SELECT doc_id, mode, gap, parts, os AS s, oe AS e FROM f WHERE oe IS NOT NULL UNION ALL SELECT doc_id, mode, gap, parts, start, i - 1 FROM f WHERE i = len(parts))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1 AS chunk_index, CASE mode WHEN 'sentences' THEN array_to_string(parts[s + 1 : e + 1], ' ') ELSE array_to_string(parts[s + 1 : e + 1], chr(10) || chr(10)) END AS text, mode FROM e
UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1, text, 'runs' FROM ru WHERE text <> ''"""


@register(f"WITH RECURSIVE {SIMPLE_SQL}")
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: every second document with its lines as paragraphs, the others by sentences, short ones in equal runs."""
    shown = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("text"))
    made = C.simple_chunks(dealt(table(spark, sf_dir, "documents")).select("doc_id", shown.alias("text")))
    return made.withColumn("chunk_index", F.col("chunk_index").cast("long"))


_PLAIN_LANG = texts.LANG_SQL[texts.LANG_SQL.index("x AS (SELECT doc_id, text, lower(left") :]


@register(
    f"""WITH ck AS MATERIALIZED (SELECT doc_id * 100000 + chunk_index AS doc_id, text FROM ({ORACLES['document_chunks']})),
fe AS ({texts.ORACLES['text_features'].replace('FROM documents', 'FROM ck')}), kw AS ({texts.ORACLES['text_keywords'].replace('FROM documents', 'FROM ck')}), la AS (WITH m0 AS (SELECT * FROM ck), {_PLAIN_LANG})
SELECT doc_id // 100000 AS doc_id, doc_id % 100000 AS chunk_index, language, (doc_id // 100000) % 5 + 1 AS page, ((doc_id // 100000) % 9) || '.1 Part' AS section_title, ((doc_id // 100000) % 9) || '.1' AS section_code,
  coalesce((SELECT string_agg(token, ',' ORDER BY rank) FROM kw WHERE kw.doc_id = ck.doc_id), '') AS keywords, has_numeric_data, contains(lower(text), 'license') AS has_domain_patterns, text_density,
  trim(regexp_replace(regexp_replace(text, '-\\s*\\n\\s*', '', 'g'), '\\s+', ' ', 'g')) AS normalized_text, ((doc_id // 100000) % 5 + 1) || '.' || (doc_id % 100000 + 1) AS citation_id FROM ck JOIN fe USING (doc_id) JOIN la USING (doc_id)"""
)
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a chunk's record holds, of every chunk of all documents; the page and section are fixtures."""
    title = F.concat((F.col("doc_id") % 9).cast("string"), F.lit(".1 Part"))
    found = records.records(dealt(table(spark, sf_dir, "documents")), section_title=title, page=(F.col("doc_id") % 5 + 1).cast("int"), domain=("license",))
    return found.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "language", F.col("page").cast("long").alias("page"), "section_title", "section_code", F.array_join("keywords", ",").alias("keywords"), "has_numeric_data", "has_domain_patterns", F.round("text_density", 6).alias("text_density"), "normalized_text", "citation_id")


@register(
    f"""WITH ck AS ({ORACLES['document_chunks']}), k AS (SELECT source, doc_id % 5 + 1 AS page, (doc_id % 3)::VARCHAR AS section, left(c.text, 80) AS head, count(*) AS n, min(length(c.text)) AS lo, max(length(c.text)) AS hi, sum(length(c.text)) AS chars FROM ck c JOIN documents USING (doc_id) GROUP BY ALL)
SELECT source, sum(n)::BIGINT AS n_chunks, min(lo) AS min_chars, max(hi) AS max_chars, round(sum(chars)::DOUBLE / sum(n), 1) AS avg_chars, sum(n - 1)::BIGINT AS n_duplicates, count(*) FILTER (n > 1) AS n_duplicate_keys FROM k GROUP BY 1"""
)
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By page, section and first 80 characters, over the chunks of all documents of a source."""
    docs = dealt(table(spark, sf_dir, "documents"))
    made = C.chunks(docs).select("doc_id", "text").join(docs.select("doc_id", "source"), "doc_id").withColumns({"page": F.col("doc_id") % 5 + 1, "section": (F.col("doc_id") % 3).cast("string")})
    found = C.statistics(made, "source", ("page", "section")).withColumn("avg_chars", F.round("avg_chars", 1))
    return found.withColumns({c: F.col(c).cast("long") for c in ("min_chars", "max_chars")})


@register(ORACLES["document_chunks"])
def lateral_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of all documents by a table function in SQL."""
    tables.register_tables(spark)
    return spark.sql(
        "SELECT d.doc_id, CAST(c.chunk_index AS BIGINT) AS chunk_index, CAST(c.start_sentence_index AS BIGINT) AS start_sentence_index, CAST(c.end_sentence_index AS BIGINT) AS end_sentence_index, c.text FROM {docs} d, LATERAL text_chunks(d.text) c",
        docs=dealt(table(spark, sf_dir, "documents")),
    )
