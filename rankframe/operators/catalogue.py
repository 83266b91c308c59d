"""Catalogue and requests: active rows, validated requests, page histories and analytics, training exports, embedding and search plugs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How a document may be sent in.
SOURCE_TYPES = ("api", "upload", "manual")
REQUIRED = ("instance_id", "document_type", "source_type")


def active(rows: DataFrame, deleted: Column, newest: str, tie: str) -> DataFrame:
    """The rows that aren't deleted (null is not deleted), newest first."""
    return rows.where(~F.coalesce(deleted, F.lit(False))).orderBy(F.col(newest).desc_nulls_last(), tie)


def validated(requests: DataFrame, body: str = "body") -> DataFrame:
    """Adds to requests (JSON text in `body`, has_file): source_type, route and errors array<string>; route is null where there are errors.

    A body must be a JSON object with all required fields, a known source_type, and what that type needs: a file or text.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*REQUIRED, "manual_text")] + [T.StructField("_corrupt", T.StringType())])
    rows = requests.withColumn("_j", F.from_json(body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    broken = F.col("_j").isNull() | F.col("_j._corrupt").isNotNull()
    kind = F.col("_j.source_type")
    missing = [F.when(~broken & F.col(f"_j.{c}").isNull(), F.lit(f"missing {c}")) for c in REQUIRED]
    unknown = F.when(~broken & kind.isNotNull() & ~kind.isin(*SOURCE_TYPES), "unknown source_type")
    needs = [F.when(~broken & (kind == "upload") & ~F.coalesce("has_file", F.lit(False)), "file needed"), F.when(~broken & (kind == "manual") & (F.coalesce(F.col("_j.manual_text"), F.lit("")) == ""), "text needed")]
    rows = rows.withColumn("errors", F.array_compact(F.array(F.when(broken, "not a JSON object"), *missing, unknown, *needs)))
    return rows.withColumn("source_type", kind).withColumn("route", F.when(F.size("errors") == 0, kind)).drop("_j")


def histories(pages: DataFrame, turns: DataFrame, key: str = "page_id", order: str = "created_at", limit: int = 50) -> DataFrame:
    """Each page with its last `limit` turns, newest first; a page without any stands once, with null turns. pages: one row per key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return pages.join(turns.withColumn("r", rank).where(F.col("r") <= limit), key, "left")


def page_sessions(turns: DataFrame, pages: DataFrame, key: str, order: str, query: str, title: str = "title", limit: int = 50, cut: int = 50) -> DataFrame:
    """(key, last_activity, n_messages, first_message, title): pages last active; the page's title, else the first message, cut."""
    per = turns.groupBy(key).agg(F.max(order).alias("last_activity"), F.count(F.lit(1)).alias("n_messages"), F.min(query).alias("first_message"))
    shown = F.when(F.length("first_message") > cut, F.concat(F.left("first_message", F.lit(cut)), F.lit("..."))).otherwise(F.col("first_message"))
    named = per.join(pages.select(key, F.col(title).alias("_title")), key).withColumn("title", F.coalesce(F.nullif("_title", F.lit("")), shown)).drop("_title")
    return named.orderBy(F.desc("last_activity"), key).limit(limit)


def page_analytics(turns: DataFrame, key: str, query: str, category: Column, ts: str, as_of: Column, days: int = 30) -> DataFrame:
    """(key, n, avg_chars, category, n_recent): turns, mean length of the query, the commonest category (ties: the least), those of the last days."""
    rows = turns.withColumn("_c", category)
    common = rows.groupBy(key, "_c").count().groupBy(key).agg(F.max(F.struct("count", F.lit(None).cast("string").alias("_")))["count"].alias("_most"))
    ranked = rows.groupBy(key, "_c").agg(F.count(F.lit(1)).alias("_n")).join(common, key).where(F.col("_n") == F.col("_most")).groupBy(key).agg(F.min("_c").alias("category"))
    per = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.length(query)).alias("avg_chars"), F.count_if((F.col(ts) > as_of - F.make_dt_interval(F.lit(days))) & (F.col(ts) <= as_of)).alias("n_recent"))
    return per.join(ranked, key)


def training_export(hits: DataFrame, least: int = 1, first: int = 20, query: str = "query", doc: str = "doc_id", rank: str = "rank", relevant: str = "relevant") -> DataFrame:
    """(query, positive_docs, all_retrieved) of queries with at least `least` relevant hits among their first ones, in rank order."""
    held = hits.where(F.col(rank) <= first).groupBy(query).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(doc).alias("d"), F.col(relevant).alias("y")))).alias("h"))
    positive = F.transform(F.filter("h", lambda x: x["y"]), lambda x: x["d"])
    return held.select(query, positive.alias("positive_docs"), F.transform("h", lambda x: x["d"]).alias("all_retrieved")).where(F.size("positive_docs") >= least)


def compared(queries: DataFrame, variants: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The hits of each search function (queries to query_id, doc_id, score, rank) under the name of its variant."""
    out = None
    for name, search in variants.items():
        part = search(queries).select(F.lit(name).alias("variant"), "query_id", "doc_id", "score", "rank")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no search function")
    return out


def embedded(rows: DataFrame, text: str, embed: Callable[[Column], Column], name: str = "embedding", most_chars: int = 2000) -> DataFrame:
    """Adds the embedding of the first characters of the text by any expression, built-in or pandas UDF, from text to array<float>."""
    return rows.withColumn(name, embed(F.left(F.coalesce(F.col(text), F.lit("")), F.lit(most_chars))))


def sentences(answers: DataFrame, text: str = "text", key: str = "answer_id") -> DataFrame:
    """(key, index, total, sentence): each answer as its sentences in order, cut at runs of . ! ? and blank lines, trimmed; blank ones don't count."""
    parts = F.filter(F.transform(F.split(text, r"[.!?]+|\n\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return answers.select(key, F.size(parts).alias("total"), F.posexplode(parts).alias("index", "sentence"))


def delete_namespace(spark: SparkSession, path: str, key: str, value: object, dry_run: bool = True) -> int:
    """Rows of one value of the partition column `key`; they are deleted unless it is a dry run, all other partitions staying as they are."""
    rows = spark.read.parquet(path).where(F.col(key) == F.lit(value))
    found = rows.count()
    if found and not dry_run:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}={value}")
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    return found


def register_functions(spark: SparkSession, functions: Mapping[str, tuple[Sequence[str], str, str]]) -> None:
    """Makes SQL functions of a session: name to (parameters with types, type of the result, SQL expression)."""
    for name, (parameters, kind, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(parameters)}) RETURNS {kind} RETURN {body}")


#: Functions that register_functions can give a session.
SQL_FUNCTIONS = {
    "normalised_text": (("t STRING",), "STRING", r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\r\\n?', '\n'), '[ \\t]+', ' '), '\\n{3,}', '\n\n'), '^\\s+|\\s+$', '')"),
    "word_jaccard": (("a STRING", "b STRING"), "DOUBLE", r"size(array_intersect(filter(split(lower(a), '\\s+'), x -> x <> ''), filter(split(lower(b), '\\s+'), x -> x <> ''))) / greatest(size(array_union(filter(split(lower(a), '\\s+'), x -> x <> ''), filter(split(lower(b), '\\s+'), x -> x <> ''))), 1)"),
}
