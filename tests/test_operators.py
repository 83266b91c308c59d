"""Operators on small inputs: golden values from their formulas, and streams against their batch form."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankframe.functions import lang, queries
from rankframe.functions import text as T
from rankframe.operators import bm25, catalogue, chunking, graph, metrics, monitoring, records, scoring
from rankframe.plans.common import dealt
from rankframe.sources import logs
from rankframe.streaming import measurements


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, k, k) for k in range(1, 9)], "query_id long, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, k) for k in (4, 5, 6, 8)], "query_id long, doc_id long")
    r = metrics.per_query(ranked, qrels).first()
    ideal = 1 + 1 / math.log2(3) + 1 / 2 + 1 / math.log2(5)
    assert (r.precision, r.recall, r.mrr, r.map, r.p_1, r.p_3, r.p_5, r.p_10) == (0.5, 1.0, 0.25, 0.4125, 0.0, 0.0, 0.4, 0.4)
    assert math.isclose(r.f1, 2 / 3) and math.isclose(r.ndcg, sum(1 / math.log2(k + 1) for k in (4, 5, 6, 8)) / ideal)
    none = metrics.per_query(ranked, qrels.where("false")).first()
    assert none.precision == 0 and none.mrr is None and not none.has_truth


def test_normal_cdf(spark):
    rows = spark.createDataFrame([(x / 10,) for x in range(-40, 41)], "x double").withColumn("p", monitoring.normal_cdf(F.col("x"))).collect()
    assert all(abs(r.p - 0.5 * (1 + math.erf(r.x / math.sqrt(2)))) < 1e-6 for r in rows)


def test_first_variant(spark):
    found = spark.createDataFrame([(1, 5, 1, 0.3), (1, 5, 0, 0.2), (1, 6, 2, 0.9)], "query_id long, doc_id long, variant_ord int, score double")
    assert {(r.doc_id, r.score) for r in scoring.first_variant(found).collect()} == {(5, 0.2), (6, 0.9)}


def test_sources(spark, tmp_path):
    (tmp_path / "truth.json").write_text('{"q1": ["a", "b"], "q2": ["a"]}')
    assert {tuple(r) for r in logs.judgements(spark, str(tmp_path / "truth.json")).collect()} == {("q1", "a"), ("q1", "b"), ("q2", "a")}
    (tmp_path / "o.json").write_text('{"drugs": [{"name": "Alpha-1", "synonyms": ["One!"]}], "other": []}')
    assert {tuple(r) for r in logs.ontology(spark, str(tmp_path / "o.json"), ("drugs", "other")).collect()} == {("drugs", "alpha 1", "alpha 1"), ("drugs", "alpha 1", "one")}
    files = tmp_path / "files"
    files.mkdir()
    for name, data in (("a.txt", "é".encode()), ("b", b"%PDF-1"), ("c.log", b"\xe9")):
        (files / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.text) for r in logs.routed(spark.read.format("binaryFile").load(str(files))).collect()}
    assert got == {"a.txt": ("text", "é"), "b": ("pdf", None), "c.log": ("text", "é")}


def test_replaced_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    logs.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, "k")
    logs.replace_partitions(spark.createDataFrame([(2, "c")], "k int, v string"), path, "k")
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}


def events(spark):
    return spark.sql("select id, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 97) ts, id % 3 monitor, id % 7 = 0 failed, cast(id as double) value, id % 5 user_id, concat('a', id % 2) alert_type from range(400)")


def streamed(spark, frame, make, tmp_path, name, mode="append"):
    frame.repartition(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/{name}")
    late = frame.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp")).withColumn("monitor", F.lit(-1)).withColumn("user_id", F.lit(-1)).withColumn("alert_type", F.lit("late"))
    late.write.mode("append").parquet(f"{tmp_path}/{name}")
    source = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/{name}")
    query = make(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c-{name}").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    frame = events(spark)
    got = {tuple(r) for r in streamed(spark, frame, measurements.windowed, tmp_path, "windows").where("monitor >= 0").collect()}
    per = frame.groupBy(F.window("ts", "5 minutes"), "monitor").agg(F.count("*"), F.avg(F.col("failed").cast("double")), F.avg(F.when(~F.col("failed"), F.col("value"))))
    assert got == {(r[0].start, *r[1:]) for r in per.collect()}


def test_cooldown_stream(spark, tmp_path):
    frame = events(spark).where("failed")
    got = {tuple(r) for r in streamed(spark, frame, measurements.cooled, tmp_path, "cooled").where("alert_type <> 'late'").collect()}
    assert got == {tuple(r) for r in monitoring.cooled(frame, "alert_type").collect()} and got


def test_cooldown_out_of_order(spark, tmp_path):
    """Alerts that come late by less than the watermark, in several batches, fire as the fold over all of them in order does."""
    r = random.Random(8)
    rows = [(k, 10 * n + r.randint(0, 500) + r.random()) for n in range(0, 2400, 3) for k in ("a", "b")] + [("one", 77.25)]
    frame = spark.createDataFrame(rows, "alert_type string, s double").select("alert_type", F.timestamp_micros(F.round(F.col("s") * 1e6).cast("long")).alias("ts"))
    parts = [frame.where((F.unix_seconds("ts") >= lo) & (F.unix_seconds("ts") < lo + 6000)) for lo in range(0, 30000, 6000)]
    for part in [*parts, spark.createDataFrame([("late", None)], "alert_type string, ts timestamp").withColumn("ts", F.lit("2030-01-01").cast("timestamp"))]:
        part.orderBy(F.xxhash64("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = measurements.cooled(source, 900).writeStream.format("memory").queryName("disordered").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(query.recentProgress) > 3
    got = {tuple(x) for x in spark.table("disordered").where("alert_type <> 'late'").collect()}
    assert got == {tuple(x) for x in monitoring.cooled(frame, "alert_type", 900).collect()} and len(got) > 40


def test_late_rows_are_counted(spark, tmp_path):
    """The listener's counts equal the rows fed: read, kept, and late behind the watermark of an earlier batch."""
    fed = [[("00:01:00", 1), ("02:00:00", 2), ("02:00:00", 2)], [("00:02:00", 3), ("00:03:00", 4), ("01:58:00", 5), ("03:00:00", 6)], [("00:00:00", 7), ("04:00:00", 8)]]
    counts = measurements.RowCounts()
    spark.streams.addListener(counts)
    try:
        for part in fed:
            frame = spark.createDataFrame([(f"2024-01-01 {t}", k) for t, k in part], "ts string, k int").withColumn("ts", F.col("ts").cast("timestamp"))
            frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            query = measurements.counted(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), "k").writeStream.format("parquet").queryName("late").option("checkpointLocation", f"{tmp_path}/c").start(f"{tmp_path}/out")
            query.processAllAvailable()
            query.stop()
        for _ in range(100):
            if sum(b[0] for b in counts.batches.values()) == 9:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counts)
    total = counts.written(spark, f"{tmp_path}/counts").agg(*[F.sum(c).alias(c) for c in ("n_read", "n_kept", "n_late")]).first()
    assert tuple(total) == (9, 5, 3) and {r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1, 2, 5, 6, 8}


def test_metric_means_stream_equals_batch(spark, tmp_path):
    frame = events(spark).withColumn("metrics", F.create_map(F.lit("a"), F.col("value"), F.lit("b"), F.when(F.col("failed"), F.lit(None)).otherwise(F.lit(2.0))))
    got = {tuple(r) for r in streamed(spark, frame, measurements.metric_means, tmp_path, "means").where("monitor >= 0").collect()}
    assert got == {tuple(r) for r in measurements.metric_means(frame).collect()} and len({r[2] for r in got}) == 2


def test_late_rows_are_dropped(spark, tmp_path):
    """A row older than the watermark, which an earlier batch has passed, doesn't count; one within it does."""
    rows = [(f"2024-01-01 {t}", 1, False, 1.0) for t in ("00:01:00", "01:00:00")], [(f"2024-01-01 {t}", 1, False, 9.0) for t in ("00:02:00", "00:58:00")], [("2024-01-01 09:00:00", 2, False, 0.0)]
    for k, part in enumerate(rows):
        frame = spark.createDataFrame(part, "ts string, monitor int, failed boolean, value double").withColumn("ts", F.col("ts").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = measurements.windowed(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").start(f"{tmp_path}/out")
        query.processAllAvailable()
        query.stop()
    got = {(str(r.start), r.n) for r in spark.read.parquet(f"{tmp_path}/out").where("monitor = 1").collect()}
    assert got == {("2024-01-01 00:00:00", 1), ("2024-01-01 00:55:00", 1), ("2024-01-01 01:00:00", 1)}


def test_session_stream_equals_batch(spark, tmp_path):
    frame = events(spark)
    got = {(r.user_id, str(r.start), r.n) for r in streamed(spark, frame, measurements.sessions, tmp_path, "sessions").where("user_id >= 0").collect()}
    per = frame.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n")).collect()
    assert got == {(r.user_id, str(r.session_window.start), r.n) for r in per}


def test_cooldown_of_a_hot_key(spark):
    """One key with nearly all alerts, in bursts and alone, against a plain loop; null keys and times don't fire."""
    r = random.Random(4)
    times = [("hot", r.randint(0, 400) * 1000 + r.choice((0, 0, 900))) for _ in range(3000)] + [("cold", t) for t in (5, 3605, 7204, 7206, 20000)] + [(None, 1), ("hot", None)]
    frame = spark.createDataFrame(times, "k string, s long").withColumn("ts", F.timestamp_seconds("s")).repartition(5)
    want, last = set(), {}
    for k, t in sorted((k, t) for k, t in times if k is not None and t is not None):
        if k not in last or t - last[k] >= 3600:
            last[k] = t
            want.add((k, t))
    assert {(x.k, int(x.ts.timestamp())) for x in monitoring.cooled(frame, "k").collect()} == {(k, t) for k, t in want} and monitoring.cooled(frame.limit(0), "k").count() == 0


def test_metric_drops_by_hand(spark):
    base = spark.createDataFrame([("q", 0.8, 0.5, 0.6)], "query string, precision double, recall double, f1 double")
    rows = spark.createDataFrame([("q", 0.73, 0.43, 0.53), ("q", 0.71, 0.42, 0.52), ("x", 0.0, 0.0, 0.0)], "query string, precision double, recall double, f1 double")
    got = {(r.metric, r.value) for r in monitoring.metric_drops(rows, base, "query").collect()}
    assert got == {("precision", 0.71), ("recall", 0.42), ("f1", 0.52)}


def test_recommendations_and_activation(spark):
    patterns = spark.createDataFrame([("safety", 0.2), ("dosing", 0.9), ("general", 0.4)], "category string, mean_precision double")
    assert {tuple(r) for r in monitoring.recommendations(patterns, {"safety": "rank sections first"}).collect()} == {("safety", "rank sections first"), ("general", "review the ranking")}


def test_query_expressions(spark):
    texts = ["What is the dose of warfarin 5 mg in children, risk and danger?", "straße altes ältalt", "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i int, q string").select("i", queries.features(F.col("q")).alias("f"), queries.category(F.col("q")).alias("c"), queries.feedback_metadata(F.col("q")).alias("m")).orderBy("i").collect()
    f = rows[0].f
    assert (f.length, f.has_question_mark, f.starts_with_wh, f.has_drug_names, f.has_dosage_terms, f.has_age_terms, f.has_hepatic_terms) == (13, True, True, True, True, True, False)
    assert (f.drug_count, f.safety_term_count, f.age_term_count, rows[0].c, rows[0].m.contains_dosing_terms, rows[0].m.word_count) == (1, 2, 1, "dosing", True, 13)
    assert not rows[1].f.has_hepatic_terms and rows[2].f.length == 0 and rows[3].c == "general"
    names = spark.createDataFrame([("Pi ",), ("USA",), ("us",), ("",), (None,)], "n string").select(queries.document_type(F.col("n")).alias("t"), queries.region(F.col("n")).alias("r")).collect()
    assert names[0].t.canonical == "pis" and "PRODUCT INFORMATION" in names[0].t.variants and names[0].t.variants == sorted(names[0].t.variants)
    assert (names[1].r.canonical, names[1].r.variants) == ("USA", ["USA"]) and names[2].r.variants == ["UNITED STATES", "UNITED_STATES", "US", "USA"]
    assert names[3].t.variants == [] and names[4].r.canonical is None and names[1].t.variants == ["usa", "USA"]


def test_language_rules(spark):
    texts = {"مرحبا بالعالم العربي": "ar", "你好世界这是中文文本测试": "zh", "これはにほんごのぶんしょうです": "ja", "안녕하세요 세계 여러분": "ko", "Привет мир, как дела": "ru", "el gato de la casa con los perros": "es", "short": "en", "   el la de   ": "en", "plain words without any votes": "en"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lang.detect(F.col("t")).alias("l")).collect()
    assert {r.t: r.l for r in got} == texts
    assert spark.range(1).select(lang.name(F.lit("tr")), lang.name(F.lit("xx"))).first()[:] == ("Turkish", "Unknown")


def test_logs_and_exports(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", 1.5, "2024-01-01"), ("b", 2.5, "2024-01-02")], "q string, v double, d string").withColumn("ts", F.col("d").cast("timestamp")).drop("d")
    logs.append_daily(rows, path)
    logs.append_daily(rows.limit(1), path)
    (tmp_path / "log" / "date=2024-01-01" / "more.json").write_text('not json\n\n{"q": "c", "v": 3.0}\n')
    schema = rows.drop("ts").schema
    assert sorted(r.q for r in logs.daily(spark, path, schema).collect()) == ["a", "a", "b", "c"]
    assert [r.line for r in logs.rejected(spark, path, schema).collect()] == ["not json"]
    truth = spark.createDataFrame([("q", "1")], "query_id string, doc_id string")
    assert logs.with_judgements(truth, spark.createDataFrame([("q", "1"), ("q", "2")], truth.schema)).count() == 2
    logs.export(rows.select("q", F.struct("v").alias("nested")), str(tmp_path / "out"))
    assert {(r.q, r.nested.v) for r in spark.read.json(str(tmp_path / "out")).collect()} == {("a", 1.5), ("b", 2.5)}
    links = spark.createDataFrame([("https://drive.google.com/file/d/XY/view",), ("https://drive.google.com/open?id=Z&x=1",), ("https://a.b/c",)], "u string").select(logs.download_link(F.col("u")).alias("l")).collect()
    assert [r.l for r in links] == ["https://drive.google.com/uc?export=download&id=XY", "https://drive.google.com/uc?export=download&id=Z", "https://a.b/c"]


def test_guarded_delete(spark, tmp_path):
    path = str(tmp_path / "ns")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "ns string, v int").write.partitionBy("ns").parquet(path)
    assert catalogue.delete_namespace(spark, path, "ns", "a") == 2 and spark.read.parquet(path).count() == 3
    assert catalogue.delete_namespace(spark, path, "ns", "a", dry_run=False) == 2 and [r.v for r in spark.read.parquet(path).collect()] == [3]
    assert catalogue.delete_namespace(spark, path, "ns", "none", dry_run=False) == 0


def test_requests(spark):
    bodies = ['{"instance_id": "1", "document_type": "x", "source_type": "api"}', "{oops", "[1]", '{"instance_id": "1", "source_type": "fax"}', None]
    frame = spark.createDataFrame([(k, b, False) for k, b in enumerate(bodies)], "i int, body string, has_file boolean")
    got = {r.i: (r.route, r.errors) for r in catalogue.validated(frame).collect()}
    assert got[0] == ("api", []) and got[1] == (None, ["not a JSON object"]) and got[3] == (None, ["missing document_type", "unknown source_type"]) and got[4][0] is None and got[2][0] is None


def test_sql_functions(spark):
    catalogue.register_functions(spark, catalogue.SQL_FUNCTIONS)
    row = spark.sql(r"SELECT normalised_text(' a \t b\r\n\n\n\nc ') AS t, word_jaccard('A b c', 'b C d') AS j").first()
    assert row.t == "a b\n\nc" and row.j == 0.5


def test_embedding_and_search_plugs(spark):
    frame = spark.createDataFrame([(1, "red green blue"), (2, ""), (3, None), (4, "green red blue")], "i int, t string")
    got = {r.i: np.array(r.embedding) for r in catalogue.embedded(frame, "t", T.hashed_embedding).collect()}
    assert math.isclose(np.linalg.norm(got[1]), 1, rel_tol=1e-6) and not got[2].any() and not got[3].any() and np.allclose(got[1], got[4])
    assert spark.range(1).select(T.padded(F.array(F.lit(1.0).cast("float")), 3)).first()[0] == [1.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        catalogue.compared(frame, {})


def test_passages_of_any_length_and_script(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "Привет мир, как дела"), (3, "x"), (4, None), (5, "zz two three z")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "two three"), (2, "мир, как"), (3, "x"), (4, "two three four five"), (5, "zz")], "query_id long, text string")
    want = {(1, 1), (1, 5), (2, 2), (3, 3), (5, 5), (4, 1)}
    assert {tuple(r) for r in bm25.containing(docs, asked).collect()} == want
    assert bm25.containing(docs.limit(0), asked).count() == 0 and bm25.search(docs, asked.limit(0), 3).count() == 0


def test_bm25_against_plain_loops(spark):
    """The running top k over several tasks and blocks of queries against scores by the formula."""
    r = random.Random(5)
    texts = [" ".join(r.choice(["aa", "bb", "cc", "dd", "ee", "ff", f"w{chr(97 + r.randint(0, 25))}"]) for _ in range(r.randint(0, 12))) for _ in range(80)]
    asks = [" ".join(r.choice(["aa", "bb", "ff", "wq", "we", "none"]) for _ in range(r.randint(1, 5))) for _ in range(9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = bm25.search(docs, spark.createDataFrame(list(enumerate(asks)), "query_id long, text string"), 7).collect()
    tokens, n = [t.split() for t in texts], len(texts)
    average = sum(map(len, tokens)) / n
    terms = {w for a in asks for w in a.split()}
    df = {w: sum(w in t for t in tokens) for w in terms if any(w in t for t in tokens)}
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    want = []
    for q, a in enumerate(asks):
        scores = [(round(sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / average)) for w in a.split() if w in idf), 9), d) for d, t in enumerate(tokens)]
        want += [(q, d, k + 1) for k, (s, d) in enumerate(sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1]))[:7])]
    assert sorted((r.query_id, r.doc_id, r.rank) for r in found) == sorted(want)


def test_hub_entities_in_expansion(spark):
    """An entity of all documents brings the smallest ids that the results lack, whatever is held already."""
    mentioned = spark.createDataFrame([(d, "hub") for d in range(500)] + [(7, "rare"), (400, "rare")], "doc_id long, entity string")
    results = spark.createDataFrame([(1, d, 1.0) for d in range(0, 12)], "query_id long, doc_id long, score double")
    related = spark.createDataFrame([(1, "hub"), (1, "rare"), (2, "rare")], "query_id long, entity string")
    got = graph.expanded(results, related, mentioned, most=3).collect()
    assert sorted(r.doc_id for r in got if r.query_id == 1 and r.score < 1) == [12, 13, 14] and sorted(r.doc_id for r in got if r.query_id == 2) == [7, 400]


def test_rolling_rate_of_a_hot_key(spark):
    """Dense and sparse days, a null key and a null time, against a plain loop."""
    r = random.Random(7)
    made = [("hot", r.choice((0, 0, 0, 1, 5, 9, 30)) * 86400 + r.randint(0, 80000)) for _ in range(700)] + [("rare", d * 86400) for d in range(40)] + [(None, 5), (None, 7), ("rare", None)]
    rows = [(k, s, i, r.random() < 0.3) for i, (k, s) in enumerate(made)]
    frame = spark.createDataFrame(rows, "k string, s long, event_id int, bad boolean").withColumn("ts", F.timestamp_seconds("s")).repartition(4)
    got = {x.event_id: x.error_rate for x in monitoring.rolling_error_rate(frame, F.col("bad"), "k", last=25).collect()}
    assert len(got) == len(rows)
    for key in ("hot", "rare", None):
        mine = sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        for i, x in enumerate(mine):
            near = [y[3] for y in mine[max(0, i - 24) : i + 1]]
            assert math.isclose(got[x[2]], sum(near) / len(near))


def test_language_of_odd_texts_and_one_sample(spark):
    """Words count once each, between single spaces or at the ends; the sample stands in the plan once, however many words are looked for."""
    texts = [None, "", "el", "el la de", "der und die das haus", "der\tund\ndie das haus", "de de de de de de", "EL  LOS LAS para", "la le de du", "x" * 600, "Ğ" + " der die das"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = {r.k: r.x for r in frame.select("k", lang.detect(F.col("text")).alias("x")).collect()}

    def plain(t):
        if len((t or "").strip()) < lang.LEAST_CHARS:
            return "en"
        spaced = f" {t[:lang.SAMPLE].lower()} "
        votes = [sum(f" {w} " in spaced for w in ws) for ws in lang.KEYWORDS.values()]
        return list(lang.KEYWORDS)[votes.index(max(votes))] if max(votes) >= lang.LEAST_VOTES else "en"

    assert got == {k: plain(t) for k, t in enumerate(texts)}
    assert frame.select(lang.detect(F.col("text")).alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


def test_relations_take_whole_words_of_any_script(spark):
    """Pairs as the plain pattern finds them, without overlaps; with kinds, pairs of other words don't leave their row."""
    texts = ["a causes b causes c treats d", "été  causes\u00a0haus causes causes b", "a_1 causes b2, x causes y", "acauses b causesc d causes", None, "causes causes causes causes causes causes"]
    chunks = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    entities = spark.createDataFrame([(k, e) for k, t in enumerate(texts) for e in set(re.findall(r"\w+", t or ""))], "doc_id long, entity string")
    want = {}
    for k, t in enumerate(texts):
        for v in ("treats", "causes"):
            for a, b in re.findall(rf"(\w+)\s+{v}\s+(\w+)", t or ""):
                want[a, b] = max(want.get((a, b), (-1, "")), (k, v))
    for kinds in ((), (r"\S+",), ("[a-z]", "b2")):
        found = graph.relations(chunks, entities, ("treats", "causes"), kinds=kinds)
        whole = re.compile("|".join(f"(?:{p})" for p in kinds) or r"\S+")
        assert {(r.src, r.dst): (r.doc_id, r.relationship) for r in found.collect()} == {k: v for k, v in want.items() if all(whole.fullmatch(w) for w in k)}
        assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_neighbourhood_of_repeated_edges(spark):
    """Repeated edges give each entity once, and no task has to make all edges distinct."""
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (2, 3), (3, 4), (2, 1)], "src long, dst long")
    found = graph.neighbourhood(edges, spark.createDataFrame([(9, 1), (9, 1)], "key long, entity long"))
    assert sorted(map(tuple, found.collect())) == [(9, 2, 1), (9, 3, 2)]
    assert "Aggregate [src" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_dealt_counts_splits_with_rows(spark, tmp_path):
    """One row group in many splits is read by one task: it is dealt to as many as there are cores."""
    spark.range(60_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        scan = spark.read.parquet(str(tmp_path / "t"))
        assert scan.rdd.getNumPartitions() >= 4 and dealt(scan).select(F.spark_partition_id().alias("p")).distinct().count() == 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_cooccurrences_count_numbers(spark, monkeypatch):
    plain, tables = graph.written, {}
    monkeypatch.setattr(graph, "written", lambda df, name: tables.setdefault(name, plain(df, name)))
    rows = [(1, "b"), (1, "a"), (1, "é"), (1, "once"), (2, "a"), (2, "b"), (2, "b"), (2, "é"), (3, "é"), (3, "b"), (4, "b"), (None, "a")]
    found = graph.cooccurrences(spark.createDataFrame(rows, "doc_id long, entity string"), 2)
    assert {tuple(r) for r in found.collect()} == {("a", "b", 2), ("a", "é", 2), ("b", "é", 3)}
    # what stands once isn't numbered, and the numbers rise as the entities do
    assert [r.entity for r in tables["numbers"].orderBy("e").collect()] == ["a", "b", "é"]


def test_mentions_try_runs_of_letters_once(spark):
    assert graph.from_start("[a-z]*ment[a-z]*") == "(?<![a-z])[a-z]*ment[a-z]*" and graph.from_start("[a-z]*?ment") == "[a-z]*?ment" and graph.from_start("ment") == "ment"
    patterns = ("[a-z]*tion[a-z]*", "[a-z]*mente", "[a-z]*ment[a-z]*")
    text = "Momentemente xmenteyment, a1mente2 stationtion éction mentementes tion-tion MENTE moment"
    got = {r.entity for r in graph.mentions(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), patterns).collect()}
    assert got == {m for p in patterns for m in re.findall(p, text.lower())}


def test_records_of_chunks_as_their_columns(spark):
    """What steps over whole documents find is what the columns of each chunk say, on odd texts and sizes."""
    odd = [None, "", " ", ".", "a \u2028", "la de el \u2028", "c \x85 ", "d. \u2028 e", "f- \n g.\r\nh.\x0b i. \t j", "x" * 499 + " de la el " + "y " * 300, "de la " * 83 + "delta el los las", "x " * 247 + "el lade que", "\u0130 " * 249 + "la de el los"]
    some = "the la de el los que der die das und Licensed 5 mg p<0.05 3/4 \u0663 \uff15% \u00bd 7\u00d7 \u0130stanbul \u03a3\u0391\u03a3. pol\u00edtica e\u0301s \u212aelvin ab_cd abc1def word-\nbreak co-\n\n -- a-b with banana banana zebra apple ABCDEFGHIJ internationalization U.S.A. ... ?! \u043f\u0440\u0438\u0432\u0435\u0442 \u4f60\u597d \u3053\u308c\u306f \uc548\ub155".split(" ")
    r = random.Random(5)
    gaps = [" "] * 9 + ["  ", "\n", "\n\n\n", "\r\n", "\t", ". ", ".  ", "! \n ", ".\x0b", "-\n", "\u2028"]
    texts = odd + ["".join(r.choice(some[: r.choice((6, 20, 99))]) + r.choice(gaps) for _ in range(r.choice((3, 30, 300)))) for _ in range(120)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    fixed = {"section_title": F.concat(F.col("doc_id").cast("string"), F.lit(".1 Part")), "page": (F.col("doc_id") % 5 + 1).cast("int"), "domain": ("license",)}
    for sizes in ({}, {"target": 60, "least": 20, "most": 90, "overlap": 1}):
        got = records.records(docs, **sizes, **fixed)
        want = chunking.described(chunking.chunks(docs, **sizes).select("doc_id", "chunk_index", "text"), **fixed).select(got.columns)
        key = lambda x: (x.doc_id, x.chunk_index)
        assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    assert records.records(docs.where("doc_id < 3"), **fixed).count() == 0 and {r.language for r in got.collect()} > {"en", "es", "de", "ru"}


def test_records_of_a_long_sentence(spark):
    """A chunk's words are counted in one pass: one sentence of 40,000 different words, each against each, took 54 s."""
    words = ["w" + "".join(chr(97 + k // 26**i % 26) for i in range(4)) for k in range(40_000)]
    docs = spark.createDataFrame([(1, " ".join(words + words[70:60:-1]))], "doc_id long, text string")
    began = time.time()
    for found in (records.records(docs), chunking.described(chunking.chunks(docs).select("doc_id", "chunk_index", "text"))):
        assert found.first().keywords == sorted(words[61:71])[:8]
    assert time.time() - began < 20
