"""Operators whose queries have no SQL, against brute-force versions over all documents and golden texts."""

import re

import pytest
from pyspark.sql import functions as F

from rankframe.functions import text as T
from rankframe.operators import chunking, grounding, scoring, search, training
from rankframe.plans import composed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def flat_lines(t):
    t = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", t or ""))).strip()
    return t, [x.strip(" ") for x in re.split(r"\n+", t) if x.strip(" ")]


def by_document(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.doc_id, r.chunk_index)):
        out.setdefault(r.doc_id, []).append(r.text)
    return out


def packed(parts, size):
    done, cur = [], ""
    for p in parts:
        if cur and len(cur) + len(p) > size:
            done.append(cur)
            cur = p
        else:
            cur = f"{cur}\n\n{p}" if cur else p
    return done + [cur] if cur else done


def test_fallback_chunks(spark, texts):
    want = {i: packed(flat_lines(t)[1], 1200) for i, t in texts.items()}
    assert by_document(composed.fallback_chunks(spark, SF)) == {i: c for i, c in want.items() if c}


def test_overlapped_paragraphs(spark, texts):
    def brute(parts):
        done, cur = [], ""
        for p in parts:
            if cur and len(cur) + len(p) + 2 > 1000:
                done.append(cur)
                cur = " ".join(cur.split()[-3:]) + " " + p
            else:
                cur = f"{cur}\n\n{p}" if cur else p
        if cur and done and len(cur) < 100:
            done[-1] += "\n\n" + cur
        elif cur:
            done.append(cur)
        return done

    want = {i: brute(flat_lines(t)[1]) for i, t in texts.items()}
    assert by_document(composed.overlapped_paragraphs(spark, SF)) == {i: c for i, c in want.items() if c}


def test_dispatched_chunks(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    cut = {}
    for r in chunking.sections(docs.withColumn("text", T.normalised(F.col("text")))).collect():
        cut.setdefault(r.doc_id, []).append(r.content)
    modes = {r.doc_id: r.modes for r in composed.dispatched_chunks(spark, SF).groupBy("doc_id").agg(F.collect_set("mode").alias("modes")).collect()}
    got = by_document(composed.dispatched_chunks(spark, SF))
    for i, t in texts.items():
        t, lines = flat_lines(t)
        parts = cut.get(i, [])
        simple = len(t) <= 500 or not parts or len(parts) == 1 and len(parts[0]) > 750
        if lines:
            assert modes[i] == ["simple" if simple else "section"]
        if simple:
            assert got.get(i, []) == packed(lines, min(500, max(len(t) // 3, 50)))


def test_grounding(spark):
    sentence = [f"the {a} of the {b} was seen by all who came that day." for a, b in (("castle", "north"), ("river", "south"), ("bridge", "east"), ("tower", "west"))]
    text = " ".join(sentence)
    rows = [
        (1, text, "The RIVER of\nthe south was seen"), (2, text, sentence[1].replace("castle", "house").replace("that day", "that one day")), (3, text, "a wholly other line with nothing to find in it at all"),
        (4, text, ""), (5, None, "some passage"), (6, text, "the bridge of the east was seen by all people from abroad arriving yesterday evening"),
        (7, "start " + "zyx. " * 60 + "the bridge of the east was seen by all people who came but none of it was written down", "the bridge of the east was seen by all people who went"),
        (8, "we know that " + sentence[0][6:40] + " some, and also all who ever came that day to the place", "xx " + sentence[0] + " zz"),
        (9, "q. " * 90 + "kjhgf vbnm ert yuio " + sentence[0][14:43] + " plmok nijb uhvy gctf " + "q. " * 90, sentence[0]),
    ]
    got = {r.id: r for r in grounding.grounded(spark.createDataFrame(rows, "id int, text string, passage string")).collect()}
    assert [got[i].match_type for i in range(1, 6)] == ["exact", "full", "none", "none", "none"] and got[1].match_start == text.index("the river")
    # a page that shares only the beginning, or only the middle, has no match; one that goes on alike has
    assert [got[i].match_type for i in (6, 9)] == ["none", "none"] and got[7].match_type in ("prefix", "partial", "full")
    for r in got.values():
        if r.match_type in ("prefix", "middle"):
            assert r.similarity > (0.6 if r.match_type == "prefix" else 0.5) and r.match_start is not None


def test_grounding_against_a_plain_loop(spark):
    """Beginnings and middles of passages in texts that share more or less of the rest, worked out loop by loop."""
    import random

    def sets(a, b, whole):
        x, y = (set(a), set(b)) if whole else (set(a.split()), set(b.split()))
        return len(x & y) / len(x | y) if x | y else 0.0

    like = lambda a, b: 0.3 * sets(a, b, True) + 0.7 * sets(a, b, False)

    def plain(t, p):
        w, n = p.split(" "), len(p)
        for k in range(len(w), max(len(w) // 2, 4), -1):
            h = " ".join(w[:k])
            if len(h) >= 30 and h in t and like(p, t[t.index(h) : t.index(h) + n]) > 0.6:
                return "prefix", t.index(h)
        m = p[n // 4 : n // 4 + max(30, n // 2)] if n >= 50 else ""
        if len(m.strip()) >= 20 and m in t:
            at = t.index(m)
            if like(p, t[max(0, at - 100) : at + len(m) + 100]) > 0.5:
                return "middle", at
        return "none", None

    r, rows = random.Random(1), []
    words = ["castle", "north", "river", "seen", "walk", "old", "bridge", "people", "quiet", "stone"]
    for k in range(300):
        passage = " ".join(r.choice(words) for _ in range(r.randint(8, 16)))
        cut = r.randint(4, 16)
        kept = passage.split()[r.choice([0, 0, 2, 3]) :][:cut]
        text = " ".join([r.choice(words[5:]) for _ in range(r.randint(0, 12))] + kept + [r.choice(words[:7]) for _ in range(r.randint(0, 12))])
        rows.append((k, text, passage))
    got = {x.id: x for x in grounding.grounded(spark.createDataFrame(rows, "id int, text string, passage string")).collect()}
    met = set()
    for k, text, passage in rows:
        if got[k].match_type in ("prefix", "middle", "none"):
            met.add(got[k].match_type)
            assert (got[k].match_type, got[k].match_start) == plain(text, passage)
    assert met == {"prefix", "middle", "none"}


def test_grounded_passages(spark, texts):
    passages = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    flat = lambda t: re.sub(r"\s+", " ", re.sub(r"-\s*\n\s*", "", t)).strip().lower()
    rows = composed.grounded_passages(spark, SF).collect()
    assert rows and all((r.match_type == "exact") == (flat(passages[r.query_id]) in flat(texts[r.doc_id])) for r in rows)


def test_citations(spark):
    rows = spark.createDataFrame([("One. Two. Three. [1.1] [2.1]",), ("One. Two. [1.1][1.2][3.1]",), ("Alone. [1.1]",), ("One [1.1]. Two.\n\nOne. Two. [1.1] [2.2]",), ("",)], "t string")
    got = [r[0] for r in rows.select(T.redistributed_citations(F.col("t"))).collect()]
    assert got == ["One. Two. [1.1] Three. [2.1]", "One. [1.1] Two. [1.2][3.1]", "Alone. [1.1]", "One [1.1]. Two.\n\nOne. [1.1] Two. [2.2]", ""]


def test_canonical(spark):
    row = spark.createDataFrame([("ﬁne ½ Ⅳ x² “é” – ™ a​b\x07 …",)], "t string").select(T.canonical(F.col("t"))).first()
    assert row[0] == 'fine 1/2 IV x2 "e" - TM ab ...'


def test_adaptive(spark):
    found = spark.createDataFrame([(1, d, d, 0.9 - 0.05 * d, f"k{d % 3}", f"s{d}", f"word{d} shared") for d in range(1, 13)] + [(2, d, d, 0.2, "k", "s", "x") for d in range(1, 13)], "query_id long, doc_id long, pos int, score double, kind string, src string, text string")
    positives = spark.createDataFrame([(1, "shared word1"), (2, "other")], "query_id long, text string")
    rows = training.adaptive(found, positives, "kind", F.col("src")).collect()
    first, second = ([r for r in rows if r.query_id == q] for q in (1, 2))
    assert {(r.strategy, r.k) for r in first} == {("diverse", 5)} and len(first) == 5 and first[0].quality >= 0.6
    assert {(r.strategy, r.k) for r in second} == {("diverse", 10)} and len(second) == 10


def test_variants(spark):
    queries = spark.createDataFrame([(1, "Big house")], "query_id long, text string")
    extra = spark.createDataFrame([(1, "home", 1), (1, "HOME", 2)], "query_id long, term string, ord int")
    assert sorted((r.ord, r.text) for r in search.variants(queries, extra).collect()) == [(0, "Big house"), (1, "Big house home")]
    assert scoring.first_variant(search.multi_query(queries.select(F.col("query_id").alias("doc_id"), "text"), queries, extra, 3)).count() <= 1


def test_ingest_replaces(spark, tmp_path):
    from rankframe.streaming import ingest

    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, "Old text."), (2, "Stays.")], [(1, "New text.")]):
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, text string").parquet(source)
        ingest.ingest(stream, path, str(tmp_path / "progress")).awaitTermination()
    assert {(r.doc_id, r.text) for r in ingest.current(spark, path).collect()} == {(1, "New text."), (2, "Stays.")}


def test_mining_statistics_count_the_negatives(spark):
    from rankframe.plans import composed

    each = composed.adaptive_negatives(spark, "/root/testdata/sf0.001").collect()
    got = {(r.strategy, r.n_queries, r.n_negatives) for r in composed.mining_statistics(spark, "/root/testdata/sf0.001").collect()}
    assert got == {(s, len({r.query_id for r in each if r.strategy == s}), sum(r.strategy == s for r in each)) for s in {r.strategy for r in each}}


def test_object_names(spark):
    """Numbers give way to literal names, in chains too; repeated rows and null names don't stop it."""
    from rankframe.operators import conversations

    names = ["x.pdf", "x.pdf", "x_1.pdf", "x_1.pdf", "x.pdf", "x_1_1.pdf", "y", "y", "y_1", None, None, "x.pdf"]
    got = conversations.collision_safe(spark.createDataFrame(list(enumerate(names)), "id int, name string"), "name", ("id",)).collect()
    by_id = {r.id: r.object_name for r in got}
    made = [v for v in by_id.values() if v is not None]
    assert len(got) == len(names) and len(set(made)) == len(made) == 10 and by_id[9] is None
    assert [by_id[i] for i in (0, 2, 5, 6, 8)] == ["x.pdf", "x_1.pdf", "x_1_1.pdf", "y", "y_1"] and {by_id[i] for i in (1, 4, 11)} == {"x_2.pdf", "x_3.pdf", "x_4.pdf"}
