"""Refreshing the term corpus: equal to a full build, and only what changed is counted again; phrases by the longest match."""

import datetime

from pyspark.sql import functions as F

from rankframe.operators import corpus
from rankframe.operators import scoring as S

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "doc_id int, text string, part string, changed timestamp"


def at(text):
    return F.lit(text).cast("timestamp")


def row(k, text, part, day=0):
    return (k, text, part, T0 + datetime.timedelta(days=day))


def states(met):
    return {r["part"]: r["state"] for r in met.collect()}


def test_refresh(spark):
    now, just = at("2024-01-02 00:00:00"), at("2024-01-01 23:30:00")
    old = spark.createDataFrame([row(1, "Motion of light", "a"), row(2, "nation", "b"), row(3, "of x", None), row(4, "ration", "c"), row(5, None, "e")], SCHEMA)
    new = spark.createDataFrame([row(1, "Motion of light", "a"), row(2, "station", "b", 1), row(3, "of x", None), row(6, "motion", "d"), row(5, None, "e"), row(7, "of light", "e")], SCHEMA)
    store = corpus.counted(old, "part", "changed", ["[a-z]+tion"], ["of"], just)
    after, met = corpus.refreshed(store, new, "part", "changed", ["[a-z]+tion"], ["of"], now)
    assert states(met) == {"a": "same", "b": "changed", None: "same", "c": "gone", "d": "new", "e": "changed"}
    full = corpus.merged(corpus.counted(new, "part", "changed", ["[a-z]+tion"], ["of"], now))
    assert set(map(tuple, corpus.merged(after).collect())) == set(map(tuple, full.collect())) == {("motion", 2), ("of light", 2), ("station", 1), ("of x", 1)}
    # what was taken over keeps its time, what was counted again has the new one
    assert {r["part"] for r in after.where(F.col("built_at") == just).select("part").distinct().collect()} == {"a", None}
    later = at("2024-01-02 00:30:01")
    assert states(corpus.changes(store, old, "part", "changed", later)) == dict.fromkeys(["a", "b", None, "c", "e"], "aged")
    nothing, met = corpus.refreshed(store.limit(0), new, "part", "changed", ["[a-z]+tion"], ["of"], now)
    assert set(states(met).values()) == {"new"} and corpus.merged(nothing).count() == 4
    assert corpus.refreshed(store, new.limit(0), "part", "changed", ["x"], [], now)[0].count() == 0


def test_phrases(spark):
    concepts = spark.createDataFrame([("c", "New York City"), ("c", "NYC"), ("s", "New York"), ("s", "Empire State"), ("n", "new"), ("n", "fresh")], "concept string, synonym string")
    queries = spark.createDataFrame([(1, "in new-york city"), (2, "New York/new things"), (3, None), (4, "york new"), (5, "new york city new york")], "query_id int, text string")
    found = {(r["query_id"], r["at"], r["phrase"]) for r in S.phrase_matches(queries, concepts.select(F.lower("synonym").alias("phrase"))).collect()}
    assert found == {(1, 1, "new york city"), (2, 0, "new york"), (2, 2, "new"), (4, 1, "new"), (5, 0, "new york city"), (5, 3, "new york")}
    got = {}
    for r in S.phrase_concepts(queries, concepts).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["synonym"]))
    assert {q: [s for _, s in sorted(v)] for q, v in got.items()} == {1: ["new york city", "nyc"], 2: ["empire state", "fresh"], 4: ["fresh"], 5: ["empire state", "nyc"]}
