"""Sources and sinks: judgements, ontologies, daily logs and file routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankframe.sources.scratch import written

#: Extensions and leading bytes of files.
MAGIC = (("pdf", "25504446"), ("docx", "504B0304"))


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id) of JSON files {"query": ["id", ...]}."""
    maps = spark.read.text(path, wholetext=True).select(F.from_json("value", T.MapType(T.StringType(), T.ArrayType(T.StringType()))).alias("m"))
    return maps.select(F.explode("m").alias("query_id", "ids")).select("query_id", F.explode("ids").alias("doc_id")).distinct()


def write_judgements(qrels: DataFrame, path: str) -> None:
    """One JSON line for each query: {"query_id", "doc_ids"}."""
    qrels.groupBy("query_id").agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids")).write.mode("overwrite").json(path)


def ontology(spark: SparkSession, path: str, buckets: tuple[str, ...]) -> DataFrame:
    """(bucket, concept, synonym) of a JSON file {bucket: [{name, synonyms}]}; a concept is its own synonym."""
    entry = T.StructType([T.StructField("name", T.StringType()), T.StructField("synonyms", T.ArrayType(T.StringType()))])
    rows = spark.read.schema(T.StructType([T.StructField(b, T.ArrayType(entry)) for b in buckets])).json(path, multiLine=True)
    long = rows.select(F.explode(F.create_map(*[x for b in buckets for x in (F.lit(b), F.col(b))])).alias("bucket", "entries")).select("bucket", F.explode("entries").alias("e"))

    def plain(x: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))

    names = F.array_union(F.array(F.col("e.name")), F.coalesce("e.synonyms", F.array().cast("array<string>")))
    return long.select("bucket", plain(F.col("e.name")).alias("concept"), F.explode(F.transform(names, plain)).alias("synonym")).where("synonym <> ''").distinct()


def with_judgements(qrels: DataFrame, more: DataFrame) -> DataFrame:
    """Judgements (query_id, doc_id) and further ones, each once."""
    return qrels.select("query_id", "doc_id").unionByName(more.select("query_id", "doc_id")).distinct()


def append_daily(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Appends rows (feedback, measurements, conversation turns) as JSON lines in a folder for each day."""
    rows.withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").json(path)


def daily_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All lines of all days of a log, with _corrupt_record: the line itself where it is no JSON of this schema. Blank lines don't count."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).json(path)


def daily(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The sound lines of all days of a log; rejected() has the others."""
    return daily_lines(spark, path, schema).where("_corrupt_record is null").drop("_corrupt_record")


def rejected(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(line): the lines that daily() leaves out."""
    return written(daily_lines(spark, path, schema), "lines").where("_corrupt_record is not null").select(F.col("_corrupt_record").alias("line"))


def export(rows: DataFrame, path: str) -> None:
    """Rows with nested structs (triplets, training examples, reports) as JSON lines, replacing an earlier export."""
    rows.write.mode("overwrite").json(path)


def store_baseline(base: DataFrame, path: str) -> None:
    base.write.mode("overwrite").parquet(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def download_link(url: Column) -> Column:
    """The direct download of a shared file's link (…/d/<id>/… or …?id=<id>); any other link as it is."""
    key = F.coalesce(F.nullif(F.regexp_extract(url, r"/d/([^/]+)", 1), F.lit("")), F.nullif(F.regexp_extract(url, r"[?&]id=([^&]+)", 1), F.lit("")))
    return F.when(url.contains("drive.google.com") & key.isNotNull(), F.concat(F.lit("https://drive.google.com/uc?export=download&id="), key)).otherwise(url)


def routed(files: DataFrame) -> DataFrame:
    """Adds kind and text to binaryFile rows: by extension, then by leading bytes, else text; bytes that aren't UTF-8 are Latin-1."""
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.lit("text")
    for name, head in reversed(MAGIC):
        kind = F.when(extension == name, name).when(F.startswith(F.hex("content"), F.lit(head)), name).otherwise(kind)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.withColumn("kind", kind).withColumn("text", F.when(F.col("kind") == "text", text))


def replace_partitions(rows: DataFrame, path: str, key: str) -> None:
    """Writes rows so that the partitions of their keys replace the old ones and all others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
