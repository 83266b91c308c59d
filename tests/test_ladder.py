"""The stages of the search in stages: each fires for the queries that need it, and only for those."""

import pytest
from pyspark.sql import functions as F

from rankframe.operators import bm25, ladder

SCHEMA = "doc_id string, text string, embedding array<double>, document_type string, region string, user_id string, section string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"d{k}", f"red fox number n{k} meets the zeta", [1.0, k / 10], "a" if k < 3 else "b", "en" if k % 2 else "de", f"u{k % 2}", None) for k in range(12)]
    return spark.createDataFrame([*rows, ("null", None, None, "a", "en", "u0", None)], SCHEMA)


def asked(spark, *rows):
    return spark.createDataFrame([(q, t, [1.0, 0.5], *rest) for q, t, *rest in rows], "query_id string, text string, embedding array<double>, kind string, document_type array<string>, region array<string>, user_id array<string>")


def test_levels(spark, docs):
    queries = asked(spark, ("all", "x", "r", ["a"], ["en"], None), ("region", "x", "r", ["a"], ["fr"], None), ("type", "x", "r", ["q"], ["en"], None), ("fixed", "x", "pis", ["q"], ["en"], None), ("both", "x", "r", ["q"], ["fr"], None), ("user", "x", "r", ["a"], ["fr"], ["u1"]), ("free", "x", None, None, None, None))
    base = ladder.base_hits(docs, queries, 10)
    got = {r["query_id"]: (r["level"], set(r["d"])) for r in base.groupBy("query_id").agg(F.max("level").alias("level"), F.collect_set("doc_id").alias("d")).collect()}
    # the type filter goes, the region filter stays: a failed step does not loosen the next one
    assert got == {"all": (0, {"d1"}), "region": (1, {"d0", "d1", "d2"}), "type": (2, {f"d{k}" for k in range(1, 12, 2)}), "user": (1, {"d1"}), "free": (0, got["free"][1])} and len(got["free"][1]) == 10
    active = {r["query_id"]: r for r in ladder.active_filters(queries, base, 10).collect()}
    assert {q for q, r in active.items() if r["short"]} == {"all", "region", "fixed", "both", "user"} and active["both"]["n_base"] == 0
    assert active["region"]["region"] is None and active["region"]["document_type"] == ["a"] and active["type"]["document_type"] is None and active["fixed"]["document_type"] == ["q"]


def test_whole_search(spark, docs):
    queries = asked(spark, ("short", "zeta fox", "r", ["a"], ["en"], None), ("long", "zeta", None, None, None, None), ("none", "zeta", "pis", ["q"], None, None))
    corpus = spark.createDataFrame([("the zeta",), ("fox den",), ("unrelated words",)], "term string")
    concepts = spark.createDataFrame([("short", "vixen", 1), ("short", "FOX zeta", 2)], "query_id string, term string, rank int")
    hits, meta = ladder.search(docs, queries, lambda t: F.array(F.lit(1.0), F.length(t) / 100.0), corpus, concepts, {}, 8, ())
    m = {r["query_id"]: r for r in meta.collect()}
    assert [v["source"] for v in m["short"]["variants"]] == ["base", "concept", "concept", "prf", "prf", "prf", "bm25", "bm25"]
    assert set(m["short"]["bm25_terms"]) == {"the zeta", "fox den"} and m["long"]["bm25_terms"] == [] and m["long"]["n_scored_terms"] == 1
    assert m["none"]["n_base"] == 0 and [v["n_hits"] for v in m["none"]["variants"]] == [0, 0] and not m["none"]["fallback_type"]
    rows = hits.collect()
    assert {r["doc_id"] for r in rows if r["query_id"] == "short"} == {"d1"} and sum(r["query_id"] == "long" for r in rows) == 8
    # variants that differ from the query by case alone are not run
    same = ladder.query_variants(queries, spark.createDataFrame([("long", "", 1)], "query_id string, term string, rank int"), concepts.limit(0), concepts.limit(0))
    assert same.where("query_id = 'long'").count() == 1


def test_intents(spark):
    """Golden queries worked out by hand from the rule table; ties go to the first intent, queries without a rule are .5 sure."""
    from rankframe.functions import intents as I

    rows = [(1, "What is the dose of warfarin for children?"), (2, " "), (3, None), (4, "Contraindicated with another drug"), (5, "renal toxicity")]
    got = {r["q"]: r for r in I.classified(spark.createDataFrame(rows, "q int, text string")).collect()}
    # dosing: pattern 2.5, features 3 + 1; pediatric: pattern 3, feature 1, context 2; information: keyword 1.5, features 2 + 1
    assert (got[1]["intent"], got[1]["score"]) == ("dosing_inquiry", 6.5) and [tuple(a) for a in got[1]["alternatives"]] == [("pediatric_concerns", 6.0), ("drug_information", 4.5)]
    assert abs(got[1]["confidence"] - 6.5 / 17) < 1e-9 and got[1]["reasoning"] == "Classified as dosing inquiry because: contains dosage-related terms; age-specific dosing query"
    for k in (2, 3):
        assert (got[k]["intent"], got[k]["score"], got[k]["confidence"], got[k]["n_rules"]) == ("safety_concerns", 0.0, 0.5, 0) and got[k]["reasoning"].endswith(I.NO_REASON)
    assert (got[4]["intent"], got[4]["score"]) == ("contraindication", 3.0) and got[4]["alternatives"][0]["intent"] == "drug_interaction"
    # pattern 3, keyword 2, features 3 + 1.5, context 2
    assert got[5]["score"] == 11.5 and got[5]["text"] == "renal toxicity"


def test_every_intent_is_met(spark):
    from rankframe.functions import intents as I
    from rankframe.plans import laddering

    phrases = spark.createDataFrame([(p,) for p in laddering.PHRASES], "text string")
    met = {r["intent"] for r in I.classified(phrases).select("intent").distinct().collect()}
    assert met == set(I.INTENTS) - {"general_medical"}  # no rule speaks for it


def test_texts_are_embedded_once(spark, docs):
    met = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def embedded(text):
        met.add(1)
        return [1.0, float(len(text))]

    queries = asked(spark, ("region", "zeta", "r", ["a"], ["fr"], None), ("type", "zeta", "r", ["q"], ["en"], None))
    some = docs.where("text is not null").withColumn("embedding", embedded("text"))
    concepts = spark.createDataFrame([("region", "vixen", 1)], "query_id string, term string, rank int")
    hits, _ = ladder.search(some, queries, lambda t: F.array(F.lit(1.0), F.length(t) / 100.0), spark.createDataFrame([("the zeta",)], "term string"), concepts, {}, 8, ())
    assert hits.count() and met.value == 12  # not once more for each stage


def test_terms_held_by_texts(spark):
    texts = spark.createDataFrame([(1, "bathe cats äöü"), (2, ""), (3, None), (4, "the ca"), (5, "aaa")], "doc_id long, text string")
    terms = ["the ca", "the cats", "öü", "a", "aaaa", "zeta", "athe c"]
    got = {(r["doc_id"], r["term"]) for r in bm25.held_terms(texts, spark.createDataFrame([(t,) for t in terms], "term string"), block=2).collect()}
    assert got == {(d, t) for d, x in ((1, "bathe cats äöü"), (4, "the ca"), (5, "aaa")) for t in terms if t in x}
    hits = spark.createDataFrame([(9, 1, "Bathe cats"), (8, 1, "Bathe cats"), (9, 5, "aaa")], "query_id long, doc_id long, text string")
    scores = spark.createDataFrame([(9, "the ca", 2.0), (9, "a", 0.5), (8, "zeta", 4.0)], "query_id long, term string, score double")
    assert sorted((r["query_id"], r["doc_id"], r["bm25_boost"]) for r in bm25.phrase_boost(hits, scores).collect()) == sorted((r["query_id"], r["doc_id"], r["bm25_boost"]) for r in bm25.term_boost(hits, scores).collect())
