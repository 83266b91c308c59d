"""The training-data operators against brute-force versions on small tables with nulls, ties, repeats and odd texts."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from rankframe.llm import bpe, language_id, license_scan, media, mixing, pitman_yor, quality_rules, resampling, simhash, toxicity, webp
from rankframe.llm.common import ASCII_LOWER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
PROSE = {"en": "the of and to house with that is water for green", "de": "der und die das wasser mit nicht haus ein grün", "fr": "le la et les maison avec eau est dans été"}


def words_of(text):
    return (text or "").encode().translate(ASCII_LOWER).split()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = []
    for k in range(150):
        lang = r.choice(sorted(PROSE))
        text = " ".join(r.choice(PROSE[lang].split()) + r.choice(["", "", "ing", "s"]) for _ in range(r.randint(1, 60)))
        out.append((k, text.capitalize() + "." * r.randint(0, 1), lang, r.choice(["a", "a", "a", "b", "é", None]), len(text), "x"))
    long_text = " ".join(f"w{k}" for k in range(4000))
    odd = [None, "", " ", "\n\n", "a", "A a\tA\n\na", "!!! 123", "naïve 中文 😀😀 été", "Under  the MIT-License. cc by nc cc by nc", "x y 　z", "\x00\x01 é", long_text, long_text]
    out += [(1000 + k, t, None if k % 2 else "en", "b", 0, None) for k, t in enumerate(odd)]
    out += [out[3], out[3], (None, "no id here", "en", "a", 1, None), (None, None, None, None, None, None), (2001, out[9][1], "en", "a", 1, "copy")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame):
    return Counter(tuple(map(str, r)) for r in frame.collect())


def is_held(doc_id, n, k):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % n == k


def images():
    r = np.random.RandomState(0)

    def noise(h, w, colours):
        return r.randint(0, 2**32, colours, dtype=np.uint64).astype(np.uint32)[r.randint(0, colours, (h, w))]

    return [noise(5, 7, 3), noise(1, 1, 1), noise(9, 16, 200), np.zeros((4, 4), np.uint32), np.tile(noise(1, 8, 8), (20, 2)), noise(40, 16, 500)]


@pytest.mark.parametrize("options", [{"cache_bits": c} for c in (0, 1, 7, 11)] + [{"transforms": t} for t in ((0,), (1,), (2,), (0, 1, 2), (2, 1, 0))] + [{"groups": 3, "cache_bits": 4}, {"transforms": (0, 1), "groups": 2}])
def test_webp_round_trip(options):
    made = webp.decode(webp.encode(images(), **options))
    assert all(np.array_equal(a, b) for a, b in zip(images(), made, strict=True))


def test_webp_chooses_transforms():
    """Each image takes the transforms that make it smallest: a gradient the predictor, grey noise the green, few colours a palette."""
    r = np.random.RandomState(1)
    y, x = np.mgrid[:64, :48]
    slope = ((255 << 24) | ((x * 3 + y) % 256 << 16) | ((x * 3 + y * 2) % 256 << 8) | ((x + y * 3) % 256)).astype(np.uint32)
    grey = r.randint(0, 256, (64, 64)).astype(np.uint32) * np.uint32(0x10101)
    few = r.choice(np.array([0x11223344, 0x99887766, 0x1, 0xFF00FF00, 5, 6, 7], dtype=np.uint32), (40, 40))
    text = np.frombuffer(" ".join(r.choice(" ".join(PROSE.values()).split(), 900)).encode()[:3200], dtype="<u4").reshape(-1, 16)
    made = [slope, grey, few, text, *images()]
    plain, best = webp.encode(made, 7), webp.encode(made, 7, None)
    assert all(np.array_equal(a, b) for a, b in zip(made, webp.decode(best), strict=True))
    assert all(len(a) <= len(b) for a, b in zip(best, plain, strict=True))
    assert len(best[0]) * 10 < len(plain[0]) and len(best[1]) * 3 < len(plain[1]) * 2 and len(best[2]) < len(plain[2]) and best[3] == plain[3]
    modes = webp._fitted_modes(slope, 4) >> np.uint32(8)
    assert modes.shape == (4, 3) and modes.max() < 14 and len(webp.encode([], 7, None)) == 0


def test_webp_palettes():
    few = [i for i in images() if len(np.unique(i)) <= 256]
    for more in ((), (0,), (1,)):
        made = webp.decode(webp.encode(few, transforms=(webp.PALETTE, *more)))
        assert all(np.array_equal(a, b) for a, b in zip(few, made, strict=True))


def test_webp_by_hand():
    """A file written bit by bit: one red pixel by simple codes; broken files are refused."""
    bits = "".join(format(v, f"0{n}b")[::-1] for v, n in [(0x2F, 8), (0, 14), (0, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)])
    for symbol in (0, 255, 0, 255, 0):
        bits += "".join(format(v, f"0{n}b")[::-1] for v, n in [(1, 1), (0, 1), (1, 1), (symbol, 8)])
    data = int(bits[::-1], 2).to_bytes(-(-len(bits) // 8), "little")
    data += bytes(len(data) & 1)
    file = b"RIFF" + (len(data) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data
    assert webp.decode([file])[0].tolist() == [[0xFFFF0000]]
    with pytest.raises(ValueError):
        webp.decode([b"not webp" * 5])
    assert webp.decode([]) == []
    assert (webp.NEAR[:5] == [[0, 1], [1, 0], [1, 1], [-1, 1], [0, 2]]).all() and len(webp.NEAR) == 120


def test_webp_of_another_encoder():
    """Public one-pixel files, by which browsers are asked whether they read lossless WebP."""
    files = [base64.b64decode(x) for x in ("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==", "UklGRh4AAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA=")]
    assert [i.tolist() for i in webp.decode(files)] == [[[0]], [[0xFFFFFFFF]]]


def test_long_images_are_finished_alone(monkeypatch):
    """One by one or in lockstep, with all features of the format, the pixels are the same; broken streams are refused both ways."""
    long = [np.frombuffer(random.Random(k).randbytes(64 * n) if k else (b"ab cd ef " * 8 * n)[: 64 * n], dtype="<u4").reshape(-1, 16) for k, n in enumerate((500, 30, 2))]
    for few in (0, 100):
        monkeypatch.setattr(webp, "FEW", few)
        for options in ({"cache_bits": 7}, {"cache_bits": 0}, {"groups": 3, "cache_bits": 5}, {"transforms": (0, 1, 2)}):
            files = webp.encode([*images(), *long], **options)
            assert all(np.array_equal(a, b) for a, b in zip([*images(), *long], webp.decode(files), strict=True))
            cut = files[-3][:20] + files[-3][20 : 20 + (len(files[-3]) - 20) // 2]
            with pytest.raises(ValueError):
                webp.decode([cut[:16] + (len(cut) - 20).to_bytes(4, "little") + cut[20:]])


def test_one_file_for_a_text_taller_than_the_format(spark):
    text = "".join(map(chr, np.random.RandomState(1).randint(32, 127, (1 << 20) + 70)))
    frame = spark.createDataFrame([(1, text, 9)], "doc_id long, text string, media long")
    kept = media.stored(frame, keep=("doc_id", "media"))
    assert kept.columns == ["doc_id", "media_kept", "n_bytes", "media"]
    (image,) = webp.decode([bytes(kept.first().media)])
    assert image.shape == (8193, 32)
    digest = media.digests(kept).first()
    data = text.encode() + bytes(-len(text) % 64)
    assert digest.payload_sha256 == hashlib.sha256(data).hexdigest() and digest.payload_bytes == len(data) and digest.media_sha256 == hashlib.sha256(bytes(kept.first().media)).hexdigest()


def test_media_query(docs, rows, empty):
    want = Counter()
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        data = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want[doc_id, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])] += 1
    kept = media.stored(docs)
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.digests(kept).collect())
    assert got == want
    assert media.digests(media.stored(empty)).count() == 0
    files = kept.collect()
    found = Counter((r.doc_id, r.media_bytes, r.media_sha256, r.feature) for r in media.digests(kept).collect())
    for r in files:  # the stored form and the feature by plain means
        data = webp.decode([bytes(r.media)])[0].astype("<u4").tobytes()
        whole = sum(data)
        bits = "".join(str(int(64 * sum(data[k * len(data) // 64 : (k + 1) * len(data) // 64]) > whole)) for k in range(64))
        found[r.doc_id, len(r.media), hashlib.sha256(bytes(r.media)).hexdigest(), f"{int(bits, 2):016x}"] -= 1
    assert not any(found.values())
    assert media.pixels(kept.where("doc_id = 1000")).first().pixels == [0] * 16


def test_mixing(docs, rows, empty):
    got = mixing.mixed_documents(docs).collect()
    size = defaultdict(int)
    for _, text, _, source, *_ in rows:
        size[source] += len(words_of(text))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    total = sum(size.values())
    while True:  # reshare until none is above its cap
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
        open_ -= over
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.last_position is None) == (r.taken == 0)
        taken[round(r.target, 6)] += r.taken
    assert len(got) == len(rows)
    for s in order:
        assert abs(sum(r.taken for r in got if math.isclose(r.target, target[s])) - sum(target[x] for x in order if math.isclose(target[x], target[s]))) <= 2
    assert by_id(mixing.mixed_documents(docs)) == Counter(tuple(map(str, r)) for r in got)
    assert mixing.mixed_documents(empty).count() == 0 and mixing.training_order(docs).columns == docs.columns


def test_mix_follows_the_schedules(spark):
    """Two small sources stand three times, half of the ids are null, one row repeats 300 times: each tenth of the mix asks for what the schedules say."""
    from pyspark.sql import functions as F

    texts = [(None if k % 2 else k, f"w{k} x y z", source, k) for source, n in (("a", 9000), ("b", 400), ("c", 500)) for k in range(n)]
    texts += [(None, "again and again", "c", k) for k in range(300)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, source string, size long").withColumn("at", F.lit(1)).withColumn("doc", F.lit("x"))
    order = mixing.training_order(frame, bucket_rows=64)
    assert order.columns == frame.columns
    rows = mixing.placed(frame, mixing.WEIGHTS, 3, 64, ["source"]).where("taken > 0").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), mixing._turns() - 1)))
    rows = rows.withColumn("t", mixing._position(F.col("turn"), mixing.KNOTS, mixing.SCHEDULES)).select("doc.source", "size", "t", "passes").collect()
    assert len(rows) == order.count() and {r.source: r.passes for r in rows if r.source != "a"} == {"b": 3, "c": 3}
    for k, source in enumerate("abc"):
        mine = [r for r in rows if r.source == source]
        area = lambda t: np.interp(t, np.linspace(0, 1, 2001), np.concatenate([[0], np.cumsum(np.interp((np.arange(2000) + 0.5) / 2000, mixing.KNOTS, mixing.SCHEDULES[k]) / 2000)]))
        for tenth in range(10):
            share = sum(r.size for r in mine if tenth / 10 <= r.t < (tenth + 1) / 10) / sum(r.size for r in mine)
            assert abs(share - (area((tenth + 1) / 10) - area(tenth / 10))) < 0.02
    places = mixing.mixed_documents(frame, bucket_rows=64).where("taken > size").collect()
    assert places and all(r.position <= r.last_position for r in places) and any(r.last_position - r.position > 0.5 for r in places)


def test_demand_inverse(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 101).select((F.col("id") / 100).alias("u"), (F.col("id") % 3).alias("o"))
    for r in rows.withColumn("t", mixing.demand_inverse(F.col("u"), F.col("o"))).collect():
        w = np.interp(np.linspace(0, r.t, 20001), mixing.KNOTS, mixing.SCHEDULES[r.o])
        assert abs(np.trapezoid(w, np.linspace(0, r.t, 20001)) - r.u) < 1e-4


def test_license_scan(spark, docs, rows, empty):
    def brute(text):
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        w = license_scan.words_of(lower)
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        more = set(labels)
        for t in license_scan.TEMPLATES:
            words, span = set(license_scan.words_of(t.notice)), license_scan.width(t)
            for block in range(0, len(w), span):
                held = set(w[block : block + 2 * span])
                rest = iter(w[block : block + 2 * span])
                in_order = len(words) >= 16 or all(x in rest for x in license_scan.words_of(t.notice))
                if len(words & held) >= (0.8 * len(words) if len(words) >= 16 else len(words)) and in_order and not held & set(t.without.split()):
                    more.add(t.label)
        return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(more))

    extra = ["Released under the MIT License", "this work is licensed under gnu general public license version 3 or so", "cc by nc cc by nc by nc", "x\nlicensed CC BY NC 4 0 under\ny", "under the mit\nlicense under the MIT license"]
    wrapped = "Redistribution and use in source\n * and binary forms, with or without\n * modification, are permitted provided\n\n * that the following conditions are met:"
    none = ["Released under the Apache License", "Licensed under CC BY 4.0", "Licensed under the Mozilla License, Version 2.0", "This work is licensed under the GNU Lesser General Public License, version 3", "the MIT text was released under a BSD License"]
    extra += [wrapped, "filler " * 5003 + wrapped, *none, " ".join(f"x{k} mit" for k in range(3000)) + " Released under the MIT License"]
    table = docs.unionByName(spark.createDataFrame([(3000 + k, t, None, None, None, None) for k, t in enumerate(extra)], SCHEMA))
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in license_scan.license_scan(table).collect())
    want = Counter((r[0], *brute(r[1])) for r in rows) + Counter((3000 + k, *brute(t)) for k, t in enumerate(extra))
    assert got == want
    labels = {r.doc_id: r.labels for r in license_scan.license_scan(table.where("doc_id >= 3005")).collect()}
    assert [labels[3005 + k] for k in range(8)] == ["bsd", "bsd", "", "", "", "", "", "mit"]
    assert license_scan.license_scan(empty).count() == 0


def test_language(docs, rows, empty):
    got = language_id.identify(docs).collect()
    known = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 1000 and len(r[1].split()) >= 8}
    assert len(got) == len(rows) and all(r.held_out == is_held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == known[r.doc_id] for r in got if r.held_out and r.doc_id in known]) > 0.9
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002, 1006)} == {"und"}
    assert language_id.identify(empty).count() == 0


def test_presence_kernel_is_exact(rows):
    """Against sets of whole n-grams: toy texts, several scripts, and texts far longer than the landmarks, of which most n-grams are new."""
    texts = ["abcab", "bcd a", "zz", "中文字符中文", "Привет мир", "naïve été 😀"] + [r[1] for r in rows[:40:4]]
    marks = language_id.Landmarks(texts)
    more = texts + ["x y z " * 300, " ".join(r[1] for r in rows[:30])]
    sets = [{t.lower()[k : k + n] for n in language_id.ORDERS for k in range(len(t) - n + 1)} for t in more]
    want = [[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets[: len(texts)]] for a in sets]
    assert np.mean(np.abs(marks.spectrum.normalised(more) @ marks.matrix.T - want) > 1e-3) < 0.03  # hashes of 20 bits: few n-grams share one


def test_language_model_against_plain_ridge(spark, rows):
    """Weights from partial sums equal a ridge regression over the whole kernel matrix; short texts and large scripts get landmarks."""
    r = random.Random(2)
    some = [(k, "".join(r.choice("的一是不了人我在有他这中大来上") for _ in range(r.randint(3, 9))), "zh") for k in range(40)]
    some += [(k, f"{r.choice('xyz')} ok", "short") for k in range(40, 60)] + [(k, x[1], x[2]) for k, x in enumerate(rows[:100], 60)]
    frame = spark.createDataFrame(some, "doc_id long, text string, lang string")
    model = language_id.fit(frame)
    x = np.hstack([model.landmarks.features([t for _, t, _ in some]).astype(float), np.ones((len(some), 1))])
    y = np.where(np.array([s[2] for s in some])[:, None] == np.array(model.languages), 1.0, -1.0)
    want = np.linalg.solve(x.T @ x / len(x) + language_id.RIDGE * np.eye(x.shape[1]), x.T @ y / len(x))
    assert np.allclose(model.weights, want, atol=1e-2 * np.abs(want).max())
    found = {s.doc_id: s.lang_pred for s in language_id.predicted(frame, model).collect()}
    assert np.mean([found[k] == lang for k, _, lang in some]) > 0.95 and {"zh", "short"} <= set(found.values())


def test_identified_documents(spark, docs, rows):
    from pyspark.sql import functions as F

    odd = docs.withColumn("score", F.lit("mine")).withColumn("lang_pred", F.lit(1)).withColumn("_text", F.lit(2)).withColumn("doc", F.lit(3))
    kept = language_id.identified_documents(odd)
    assert kept.columns == odd.columns and {x.score for x in kept.collect()} == {"mine"}
    ids = {x.doc_id for x in kept.collect()}
    assert {r[0] for r in rows[:150]} <= ids and not ids & {1000, 1001, 1002, 1006}
    none = language_id.identified_documents(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r[0] for r in rows[:150]} <= {x.doc_id for x in none.collect()}
    assert language_id.identified_documents(docs.limit(0)).count() == 0
    kept = language_id.predicted(odd, None, keep=("doc_id", "score")).first()
    assert (kept.score_kept, kept.score, kept.lang_pred) == ("mine", 0.0, "und")


def test_pitman_yor(docs, rows, empty):
    counts = Counter()
    for doc_id, text, *_ in rows:
        if not is_held(doc_id, 7, 2):
            counts.update([*words_of(text), "END"])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for doc_id, text, *_ in rows:
        t = [*words_of(text), "END"]
        want[doc_id, is_held(doc_id, 7, 2), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)] += 1
    got = pitman_yor.score(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert pitman_yor.score(empty).count() == 0


def test_restaurants_sum_to_one():
    """The predictive probabilities of all words, and of one unknown word, sum to one in every context and sample."""
    r = np.random.RandomState(1)
    words, k = np.repeat(np.arange(50), 4), np.tile(np.arange(4), 50)
    n = r.randint(1, 200, 200)
    customers = np.bincount(k, weights=n, minlength=4).astype(float)
    model = pitman_yor.Restaurants(customers, np.where(np.arange(4) == pitman_yor.NONE, 0, 50.0), 50, (0.5, 0.6))
    seed = np.arange(50, dtype=np.uint64)
    for _, opened, guests, at_root in model.sampled(seed, words, k, n):
        assert (opened <= n).all() and (opened >= 1).all() and (at_root <= guests).all() and (opened[k == pitman_yor.NONE] == n[k == pitman_yor.NONE]).all()
        seated = np.where(k == pitman_yor.NONE, 0, opened)
        totals = (np.bincount(k, weights=seated, minlength=4), guests.sum(), at_root.sum())
        root, unknown = model.root(guests, at_root, totals), model.root(np.zeros(1), np.zeros(1), totals)
        assert math.isclose(root.sum() + unknown[0], 1)
        p = model.inside(k, n, opened) + model.back_off(totals)[k] * root[words]
        assert np.allclose(np.bincount(k, weights=p) + model.back_off(totals) * unknown, 1)


def test_table_draws_follow_the_seating():
    """Draws of the number of tables against all seatings of five customers, counted one by one; Stirling numbers likewise."""
    d, base, others, n = 0.4, 0.2, 3.0, 5
    weight = Counter()

    def seat(sizes, seated, w):
        if seated == n:
            weight[len(sizes)] += w
            return
        for j, size in enumerate(sizes):
            seat([*sizes[:j], size + 1, *sizes[j + 1 :]], seated + 1, w * (size - d))
        seat([*sizes, 1], seated + 1, w * (pitman_yor.STRENGTH + d * (others + len(sizes))) * base)

    seat([1], 1, 1.0)
    drawn = pitman_yor.redrawn(np.full(40_000, n), np.ones(40_000), np.full(40_000, base), d, np.full(40_000, others + 1), np.arange(40_000, dtype=np.uint64), pitman_yor.log_stirling(d))
    for t in range(1, n + 1):
        assert abs(np.mean(drawn == t) - weight[t] / sum(weight.values())) < 0.01


def test_model_score_against_plain_loops(spark, monkeypatch):
    """Each token's averaged probability, looked up by plain means in the seatings of a small corpus, gives the documents' scores."""
    r = random.Random(3)
    texts = [" ".join(r.choice("ab ab ab cd ef gh the the of".split()) + r.choice(["", "", str(r.randint(0, 30))]) for _ in range(r.randint(0, 40))) for _ in range(60)] + [None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    train = [t for k, t in enumerate(texts) if not is_held(k, 7, 2)]
    flat = Counter(w for t in train for w in words_of(t))
    total = sum(flat.values()) + len(train)
    known = {w for w, c in flat.items() if c >= max(8, -(-total // 10_000))}
    kept = {}
    inner = pitman_yor.scored_lexicon

    def spied(lexicon, model):
        kept["lexicon"] = {x.word: x for x in lexicon.collect()}
        kept["model"], kept["scored"] = model, {x.word: x for x in inner(lexicon, model).collect()}
        return inner(lexicon, model)

    monkeypatch.setattr(pitman_yor, "scored_lexicon", spied)
    for hot, cells in ((10**6, 10**6), (30, 10**6), (30, 20), (10**6, 0)):  # all is told to the tasks, or rare words and entries are joined
        monkeypatch.setattr(pitman_yor, "HOT_WORDS", hot)
        monkeypatch.setattr(pitman_yor, "HOT_ENTRIES", cells)
        got = {x.doc_id: x for x in pitman_yor.score(frame).collect()}
        m, scored = kept["model"], kept["scored"]
        hashes = dict(zip(sorted(known), pitman_yor.word_hashes(__import__("pyarrow").array(sorted(known))), strict=True))
        number = {w: 2 + sorted(hashes.values()).index(h) for w, h in hashes.items()}
        pairs = Counter()
        for t in train:
            before = pitman_yor.START
            for w in [*words_of(t), b"\n"]:
                pairs[w.decode(), before] += 1
                before = number.get(w, pitman_yor.NONE)
        assert {(w, k): n for w, x in kept["lexicon"].items() for k, n in zip(x.ks, x.ns, strict=True)} == pairs
        back = np.mean([m.back_off(s) for s in m.samples], axis=0)
        new = np.mean([m.root(np.zeros(1), np.zeros(1), s)[0] for s in m.samples])
        for k, t in enumerate(texts):
            want, before = 0.0, pitman_yor.START
            for w in [*words_of(t), b"\n"]:
                x = scored.get(w.decode())
                inside = dict(zip(x.ks, x.lps, strict=True)) if x else {}
                want += inside.get(before, math.log10((x.root_p if x else new) * back[before]))
                before = number.get(w, pitman_yor.NONE)
            assert math.isclose(got[k].score, want, rel_tol=1e-5, abs_tol=1e-5)


def brute_fingerprint(text, size):
    w = words_of(text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[k : k + size]), 42) for k in range(max(len(w) - size + 1, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("size", [3, 5])
def test_near_duplicates(docs, rows, empty, size):
    fps = [(r[0], brute_fingerprint(r[1], size)) for r in rows]
    distinct = sorted({f for _, f in fps})
    roots = brute_components([(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 3], distinct)
    least = {}
    for doc_id, f in fps:
        if doc_id is not None:
            least[roots[f]] = min(least.get(roots[f], doc_id), doc_id)
    got = Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs, size).collect())
    assert got == Counter((d, f, least.get(roots[f])) for d, f in fps)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicated(empty).count() == 0


def test_links_are_complete(spark):
    """Chains and clouds around centres: every pair at three bits or fewer is found, no other."""
    r = random.Random(3)
    made = set()
    for _ in range(40):
        centre = r.getrandbits(64)
        made |= {centre} | {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))) for _ in range(12)}
    signed = sorted(f - 2**64 if f >= 2**63 else f for f in made)
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = simhash.links(frame)
    assert {tuple(x) for x in got.collect()} == want
    roots = brute_components(want, signed)
    linked = {n for p in want for n in p}
    assert {x.node: x.root for x in simhash.components(got).collect() if x.node != x.root} == {n: roots[n] for n in linked if roots[n] != n}


def test_deduplicated_keeps_one_of_each(docs, rows):
    got = simhash.deduplicated(docs).collect()
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and got[0].__fields__ == docs.columns and 2001 not in ids
    assert [r.text for r in got if r.doc_id is None] == ["no id here"]  # the other row without an id has no word, like 1000


def test_different_texts_under_one_id_stay(spark):
    texts = [(1, "a b c d e f g h", "x"), (1, "one two three four five six", "x"), (1, "a b c d e f g h", "y"), (None, "p q r s t u", "x"), (None, "v w x y z", "x"), (None, "P q r s t u", "z")]
    frame = spark.createDataFrame(texts, "doc_id long, text string, extra string").repartition(3)
    got = [sorted(map(str, simhash.deduplicated(f).collect())) for f in (frame, frame.repartition(2))]
    assert got[0] == got[1] and len(got[0]) == 4


def test_near_copies_are_linked_by_few_pairs(spark):
    """A group of near copies comes together by about as many links as it has texts, not by all pairs."""
    r = random.Random(3)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    texts = []
    for k in range(240):
        copy = list(base)
        for _ in range(r.randint(0, 2)):
            copy[r.randrange(len(copy))] = f"x{k}{r.randrange(9)}"
        texts.append(" ".join(copy))
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    classes = simhash.shingle_classes(frame, 5).groupBy("sig").agg(__import__("pyspark").sql.functions.min("fp").alias("fp"))
    found = simhash.similar_sets(frame, classes, 5)
    n = classes.count()
    assert n > 150 and found.count() < 8 * n < n * (n - 1) / 4
    assert simhash.components(found).select("root").distinct().count() == 1 and simhash.deduplicated(frame).count() == 1


def test_lists_pair_only_sets_that_may_be_similar(spark, monkeypatch):
    # of 10 and 12 shingles similar sets share 9.8: 1 and 9 are enough, 1 and 7 are not, however many the smaller has left
    rows = spark.createDataFrame([(1, 5, 10, 9, 5), (1, 6, 12, 9, 6), (2, 5, 10, 8, 5), (2, 7, 12, 7, 7)], "shingle long, sig long, size int, rest int, c long")
    both = simhash._side(rows, "u").join(simhash._side(rows, "v"), "shingle").where("sig_u < sig_v")
    assert [(r.sig_u, r.sig_v) for r in both.where(simhash._may_be_similar()).collect()] == [(5, 6)]
    assert [tuple(r) for r in simhash.pairs_across(rows).collect()] == [(5, 6)]
    plain, rounds = simhash.written, []
    monkeypatch.setattr(simhash, "written", lambda df, name: rounds.append(name) or plain(df, name))
    star = spark.createDataFrame([(2, 1), (1, 3), (9, 8)], "u long, v long")  # in place already: no round is needed
    assert {(r.node, r.root) for r in simhash.components(star).collect()} == {(2, 1), (3, 1), (9, 8)} and len(rounds) == 1


def test_deduplicated_finds_all_similar_texts(spark, rows):
    """Edited copies around 0.8, short and long, chains of them, copies by case: the groups are those of brute-force Jaccard."""
    r = random.Random(8)
    texts = [t for _, t, *_ in rows if t is not None]
    for _ in range(60):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.choice((6, 12, 40, 120, 400)))]
        texts.append(" ".join(words))
        for _ in range(4):  # each edits the one before
            for _ in range(r.choice((1, 1, 2, 3))):
                words[r.randrange(len(words))] = "edit"
            texts.append(" ".join(words).upper())

    def shingles(text):
        w = words_of(text)
        return {b" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()

    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if a == b or 5 * len(a & b) >= 4 * len(a | b)]
    assert sum(sets[i] != sets[j] for i, j in pairs) > 100
    roots = brute_components(pairs, range(len(texts)))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(x.doc_id for x in simhash.deduplicated(frame).collect()) == sorted(set(roots.values()))


def labelled(spark, rows):
    return spark.createDataFrame([(r[0], int(r[1] is not None and "§" not in r[1]), int("stupid" in (r[1] or "")), None) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int, lang string")


def test_resampling(spark, docs, rows, empty):
    junk = [(5000 + k, " ".join(f"§§{w}$$$" for w in "the of and water green".split() * 8), "en", "a", 1, None) for k in range(40)]
    every = rows + junk
    table, labels = spark.createDataFrame(every, SCHEMA), labelled(spark, every)
    got = resampling.resampled(table, labels).collect()
    assert len(got) == len(every) and not any(r.kept for r in got if r.doc_id is not None and r.doc_id >= 5000)
    assert np.mean([r.kept for r in got if r.doc_id is not None and r.doc_id < 1000]) > 0.97
    top = resampling.resampled(table, labels, k=50).collect()
    least = sorted((r.key for r in top if r.kept), reverse=True)[49]
    assert all(r.drawn == (r.kept and r.key >= least) for r in top) and {r.doc_id for r in top if r.kept} == {r.doc_id for r in got if r.kept}
    heaviest = {r.doc_id for r in sorted(top, key=lambda r: -r.log_weight)[:50]}
    other = {r.doc_id for r in resampling.resampled(table, labels, k=50, seed=1).where("drawn").collect()}
    assert {r.doc_id for r in top if r.drawn} not in (heaviest, other)  # the draw decides
    assert abs(sum(r.drawn for r in got) - 0.5 * sum(r.kept for r in got)) < 8
    sample = resampling.resampled_documents(table, labels, sample=True)
    assert sample.count() == sum(r.drawn for r in got) and sample.columns == table.columns
    assert resampling.resampled(empty, labels).count() == 0
    assert all(r.kept for r in resampling.resampled(docs, labels.where("false")).collect())


def test_draw_follows_the_weights(spark):
    """Over seeds, a document is drawn first as often as its weight says; short and long texts of one kind weigh alike."""
    from pyspark.sql import functions as F

    weights = [1.0, 2.0, 3.0, 10.0]
    frame = spark.createDataFrame([(k, math.log(w)) for k, w in enumerate(weights)], "i int, lw double").crossJoin(spark.range(4000))
    frame = frame.withColumn("key", F.col("lw") + resampling.gumbel(F.xxhash64("i", F.lit("text"), F.concat(F.lit("gumbel "), F.col("id").cast("string")))))
    first = Counter(r[0] for r in frame.groupBy("id").agg(F.max_by("i", "key").alias("i")).select("i").collect())
    assert all(abs(first[k] / 4000 - w / sum(weights)) < 0.03 for k, w in enumerate(weights))


def test_registered_draw(spark):
    """Over the whole table of the query, seeds draw other documents (5% at least), and over fifty seeds heavier ones stand in more samples."""
    from pyspark.sql import functions as F

    from rankframe.llm import queries

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    one = {r.doc_id for r in queries.op7_importance_resampling(spark, sf).where("drawn").collect()}
    two = {r.doc_id for r in resampling.resampled(docs, labels, seed=1).where("drawn").collect()}
    assert len(one - two) >= 0.05 * len(one)
    kept = resampling.resampled(docs, labels).where("kept").join(docs.select("doc_id", "text"), "doc_id")
    keys = kept.crossJoin(spark.range(50).withColumnRenamed("id", "s")).select("s", "doc_id", "log_weight", (F.col("log_weight") + resampling.gumbel(F.xxhash64(F.col("doc_id").cast("string"), "text", F.concat(F.lit("gumbel "), F.col("s").cast("string"))))).alias("key"))
    samples = defaultdict(list)
    for r in keys.collect():
        samples[r.s].append((r.key, r.doc_id, r.log_weight))
    assert {d for _, d, _ in sorted(samples[0], reverse=True)[: len(one)]} == one
    times, weight = Counter(), {}
    for rows in samples.values():
        weight |= {d: w for _, d, w in rows}
        times.update(d for _, d, _ in sorted(rows, reverse=True)[: len(one)])
    order = sorted(weight, key=weight.get)
    share = [np.mean([times[d] / 50 for d in part]) for part in np.array_split(np.array(order), 4)]
    assert share == sorted(share) and share[0] + 0.3 < share[-1] and abs(np.mean([times[d] / 50 for d in order]) - 0.5) < 0.02


def test_weights_against_brute_force(spark, docs, rows):
    """Counts, ratios and weights of the bags of n-grams against a plain count of each text's words, pairs and shapes."""
    from pyspark.sql import functions as F

    some = [r[1] or "" for r in rows]
    ids = spark.createDataFrame([(r[0],) for r in rows if r[0] is not None and r[0] % 2], "doc_id long").distinct()
    counts = resampling.gram_counts(docs, ids)
    each = [resampling.grams(__import__("pyarrow").array([t]))[1] for t in some]
    want = np.zeros_like(counts)
    for r, bucket in zip(rows, each, strict=True):
        np.add.at(want[1], bucket, 1)
        if r[0] is not None and r[0] % 2:
            np.add.at(want[0], bucket, 1)
    assert (counts == want).all()
    for text, bucket in zip(some, each, strict=True):
        w = words_of(text)
        assert len(bucket) == len(w) + 2 * max(len(w) - 1, 0) and (len(w) > 99 or len(set(bucket[: len(w)])) == len(set(w)))
    ratios = resampling.log_ratios(counts)
    got = resampling.weighed(docs.select("doc_id", "text"), ratios).collect()
    brute = Counter((r[0], len(words_of(r[1])), round(sum(ratios[b] for b in bucket) * 64 / (64 + len(bucket)), 6) + 0.0) for r, bucket in zip(rows, each, strict=True))
    assert Counter((r.doc_id, r.n_words, round(r.log_weight, 6) + 0.0) for r in got) == brute


def test_kth_largest(spark):
    values = [random.Random(2).choice([0.5, -1e9, 3.25, 1e-12, 7.0]) for _ in range(300)] + [float(k) for k in range(100)]
    frame = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 7, 100, 250, 399):
        assert resampling.kth_largest(frame, k) == sorted(values, reverse=True)[k - 1]
    assert resampling.kth_largest(frame, 400) == -math.inf


def reference_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, rows, empty):
    encoding = reference_encoding()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array(encoding.encode_ordinary(text or ""), dtype="<u4")
        want[doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.digests(docs).collect()) == want
    assert bpe.digests(empty).count() == 0
    back = bpe.decoded(bpe.encoded(docs)).collect()
    assert Counter((r.doc_id, bytes(r.data)) for r in back) == Counter((r[0], (r[1] or "").encode()) for r in rows)
    spans = bpe.encoded(docs.where("doc_id = 1007"), offsets=True).first()
    assert len(spans.ids) == len(spans.starts) == len(spans.ends) and max(spans.ends) == len(rows[157][1])


def test_bpe_fuzz():
    encoding, codec = reference_encoding(), bpe.Codec.of(bpe.vocabulary_path())
    r = random.Random(4)
    texts = ["".join(r.choice("ab'\n\t 😀é1.,s\x85\x1c　\r") for _ in range(r.choice((3, 10, 50)))) for _ in range(1500)] + ["<|endoftext|> 's 'x", " a", "a ", "\n"]
    got = codec.encode(texts)
    assert got == [np.array(encoding.encode_ordinary(t), dtype="<u4").tobytes() for t in texts]
    assert codec.decode(got) == [t.encode() for t in texts]


def test_toxicity(spark, rows, empty):
    r = random.Random(9)
    insult = [(6000 + k, " ".join(r.choice(["the", "of", "stupid", "idiot", "water", "scum"]) for _ in range(30)) + " stupid", "en", "a", 1, None) for k in range(60)]
    every = rows + insult
    table, labels = spark.createDataFrame(every, SCHEMA), labelled(spark, every)
    got = toxicity.scored(table, labels).collect()
    assert len(got) == len(every) and all(x.held_out == is_held(x.doc_id, 3, 1) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)
    held = [x for x in got if x.held_out]
    assert np.mean([x.predicted for x in held if x.doc_id >= 6000]) > 0.9 and np.mean([x.predicted for x in held if x.doc_id < 1000]) < 0.05
    assert toxicity.scored(empty, labels).count() == 0
    assert not any(x.predicted for x in toxicity.scored(table, labels.where("false")).collect())


def test_pu_training_against_plain_rows(spark):
    """Steps over counted patterns, local or spread, equal steps over single rows; the cut is the best of all cuts."""
    r = np.random.RandomState(3)
    x = (r.rand(400, 6) < 0.3).astype(float)
    positive = np.concatenate([np.ones(60, bool), np.zeros(340, bool)])
    x[:60, :2] = r.rand(60, 2) < 0.8
    prior, w = 0.1, np.append(np.zeros(6), np.log(0.1 / 0.9))
    m, v = np.zeros(7), np.zeros(7)
    one = np.hstack([x, np.ones((400, 1))])
    for t in range(1, 41):
        z = one @ w
        rise = 1 / (1 + np.exp(-z))
        mean = lambda q, s: (one[s] * q[s][:, None]).mean(axis=0)
        bad = mean(rise, ~positive) - prior * mean(rise, positive)
        risk = np.logaddexp(0, z[~positive]).mean() - prior * np.logaddexp(0, z[positive]).mean()
        grad = -bad if risk < 0 else prior * mean(rise - 1, positive) + bad
        grad[:-1] += 1e-4 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    held = Counter((np.flatnonzero(a).astype(np.int32).tobytes(), bool(p)) for a, p in zip(x, positive, strict=True))
    keys = sorted({k for k, _ in held})
    counts = [[held[k, side] for k in keys] for side in (True, False)]
    local = toxicity.train(toxicity.Patterns(keys, np.array(counts[0]), np.array(counts[1]), 6).sums, 6, prior, steps=40)
    table = spark.createDataFrame([(bytearray(k), *n) for k, *n in zip(keys, *counts)], "places binary, positive long, unlabelled long").repartition(3)
    assert np.allclose(local, w, atol=1e-9)
    assert np.allclose(toxicity.spread_sums(table, local), toxicity.Patterns(keys, np.array(counts[0]), np.array(counts[1]), 6).sums(local))
    z = one @ w
    cut = toxicity.threshold(z.round(9), positive, ~positive)
    gain = lambda c: np.mean(z[positive] >= c) ** 2 / max(np.mean(z[~positive] >= c), 1 / 340)
    assert math.isclose(gain(cut), max(gain(c - 1e-6) for c in z[positive]))


def test_toxicity_spread_equals_local(spark, rows):
    every = rows + [(6000 + k, f"stupid scum {k} of the water", "en", "a", 1, None) for k in range(40)]
    table, labels = spark.createDataFrame(every, SCHEMA), labelled(spark, every)
    known, local = toxicity.fit(table, labels)
    again, spread = toxicity.fit(table, labels, local_places=0)
    assert (known.features == again.features).all() and np.allclose(local[:-1], spread[:-1], atol=1e-6) and abs(local[-1] - spread[-1]) < 0.01


def brute_rules(text):
    text = text or ""
    w = words_of(text)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    times = Counter(windows)
    covered = {i for k, x in enumerate(windows) if times[x] > 1 for i in range(k, k + 8)}
    raw = [x for x in text.encode().split()]  # windows compare words as they stand
    windows = [tuple(raw[k : k + 8]) for k in range(len(raw) - 7)]
    times = Counter(windows)
    covered = {i for k, x in enumerate(windows) if times[x] > 1 for i in range(k, k + 8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(raw), sum(len(x.decode()) for x in raw), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, rows, empty):
    extra = ["a b c d e f g h " * 3 + "x", "one line\none line\n\n \none line", "$$ ## | a\nb", "a b c d e f g h a b c d e f g h i"]
    table = docs.unionByName(spark.createDataFrame([(3000 + k, t, None, None, None, None) for k, t in enumerate(extra)], SCHEMA))
    got = quality_rules.rule_verdicts(table).collect()
    want = Counter((r[0], *brute_rules(r[1])) for r in rows) + Counter((3000 + k, *brute_rules(t)) for k, t in enumerate(extra))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality_rules.rule_verdicts(empty).count() == 0


def drawn_votes(n, rates, shares, seed=1):
    """Patterns of votes of rules that vote bad at the rates of good text (first) and of each kind."""
    r = random.Random(seed)
    patterns = Counter()
    for _ in range(n):
        rate = rates[r.choices(range(len(shares)), shares)[0]]
        patterns["".join("0" if r.random() < 0.1 else "-" if r.random() < x else "+" for x in rate)] += 1
    return patterns


def test_rule_estimates():
    """On votes drawn from known rates, each kind found by its own rules only, EM finds the shares and every rule's accuracy."""
    kinds = list(dict.fromkeys(x[3] for x in quality_rules.RULES))
    rates = [[0.004] * len(quality_rules.RULES)] + [[0.9 if x[3] == kind else 0.03 for x in quality_rules.RULES] for kind in kinds]
    found = quality_rules.estimate(drawn_votes(60_000, rates, [0.82] + [0.03] * len(kinds)))
    assert found["kinds"] == kinds and abs(found["shares"][0] - 0.82) < 0.15
    assert np.abs(found["errs"][0] - 0.004).max() < 0.01
    for k, kind in enumerate(kinds):
        mine = [i for i, x in enumerate(quality_rules.RULES) if x[3] == kind]
        if len(mine) > 1:  # a kind that one rule alone finds can't be told from that rule's own errors
            assert np.abs(found["errs"][k + 1][mine] - 0.9).max() < 0.1
    clean = "+" * len(quality_rules.RULES)
    assert found["posterior"][clean] > 0.95 and all(p < 0.5 for v, p in found["posterior"].items() if v[1:3] == "--" or v[3:5] == "--")


def test_rule_posterior_against_plain_loops():
    patterns = drawn_votes(500, [[0.05] * 8, [0.8] * 4 + [0.1] * 4], [0.8, 0.2], seed=4)
    rules = [(str(k), "", "", "ab"[k // 4]) for k in range(8)]
    found = quality_rules.estimate(patterns, rules, rounds=25)
    part = {}
    for v in patterns:
        hit = ["-" in v[:4], "-" in v[4:]]
        part[v] = [0.1, *[0.9 * h / sum(hit) for h in hit]] if any(hit) else [0.9, 0.05, 0.05]
    for _ in range(25):
        total = sum(patterns.values())
        share = [(sum(n * part[v][c] for v, n in patterns.items()) + 0.01) / (total + 0.03) for c in range(3)]
        err = [[(sum(n * part[v][c] for v, n in patterns.items() if v[k] == "-") + 0.01) / (sum(n * part[v][c] for v, n in patterns.items() if v[k] != "0") + 0.02) for k in range(8)] for c in range(3)]
        for v in patterns:
            like = [share[c] * math.prod({"-": err[c][k], "+": 1 - err[c][k], "0": 1}[v[k]] for k in range(8)) for c in range(3)]
            part[v] = [x / sum(like) for x in like]
    assert all(math.isclose(found["posterior"][v], part[v][0], abs_tol=1e-6) for v in patterns)


def test_rules_on_labelled_text(spark, rows):
    """Junk of three kinds beside prose: all junk goes, clean text of 40 words and more stays."""
    r = random.Random(6)
    prose = [" ".join(f"{a}{b}" for a, b in ((r.choice(["wa", "ter", "ho", "use"]), r.randint(0, 99)) for _ in range(r.randint(40, 90)))) for _ in range(400)]
    junk = [" ".join(f"{w}###" for w in t.split()) for t in prose[:30]] + ["again and again " * 30] * 20 + [" ".join(f"{w.upper()}LOUD!!" for w in t.split()) for t in prose[30:60]]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(prose + junk)], "doc_id long, text string")
    got = quality_rules.rule_verdicts(frame).collect()
    assert np.mean([x.kept for x in got if x.doc_id < 400]) > 0.99 and not any(x.kept for x in got if x.doc_id >= 400)


CLASHING = ("size", "target", "position", "taken", "source_size", "score", "lang_pred", "_text", "_kept", "doc", "key", "kept", "noise", "h", "id", "rid", "ids", "n_tokens", "_id", "extra")


def test_pipeline_stages(spark, docs, rows, tmp_path):
    """Each stage against its operator's plain result, over odd rows, with columns called like everything inside."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    wide = docs.drop("extra").select("*", *[F.lit(f"my {c}").alias(c) for c in CLASHING])
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    labelled(spark, rows).write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = table.count()

    def ids_and_texts(frame):
        return Counter((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect())

    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, table, str(tmp_path))
        assert after.columns == wide.columns, name
        path = f"{tmp_path}/{name.replace(' ', '-')}"
        after.write.parquet(path)
        was, table = ids_and_texts(table), spark.read.parquet(path)
        now = ids_and_texts(table)
        assert set(now) <= set(was) and table.where(" or ".join(f"`{c}` <> 'my {c}'" for c in CLASHING)).count() == 0
        if name == "SimHash near-dedup":  # one of each group, by brute force over five-word shingles
            texts = sorted(was, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
            sets = [shingle_set(t) for _, t in texts]
            roots = brute_components([(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if a == b or 5 * len(a & b) >= 4 * len(a | b)], range(len(texts)))
            assert len(set(roots.values())) == sum(now.values()) and {texts[k][0] for k in set(roots.values())} == {i for i, _ in now}
        if name == "language ID":
            assert all(any(map(str.isalpha, t or "")) for _, t in now)
    assert 0 < table.count() <= 3 * before
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "ids", "n_tokens"} <= set(out.columns) and out.count() == table.count()
    encoding = reference_encoding()
    want = Counter((r.doc_id, tuple(encoding.encode_ordinary(r.text))) for r in table.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in out.collect()) == want
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, wide.limit(0), str(tmp_path)).count() == 0, name


def shingle_set(text):
    w = words_of(text)
    return {b" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def compared(spark, name, frame, con):
    from rankframe.llm import queries

    cursor = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted((tuple(map(str, r)) for r in cursor.fetchall()))
    assert sorted(tuple(map(str, r)) for r in frame.select(*names).collect()) == want


def test_license_scan_against_sql(spark, docs, rows):
    """The SQL form over the odd rows (nulls, empty and long texts, repeats) and over whole documents."""
    duckdb = pytest.importorskip("duckdb")
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    compared(spark, "op3_license_scan", license_scan.license_scan(spark.read.parquet(path)), con)
    odd = duckdb.connect()
    odd.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    odd.executemany("INSERT INTO documents VALUES (?, ?)", [(r[0], None if r[1] is None else r[1].replace("\x00", "\x01")) for r in rows])
    clean = docs.selectExpr("doc_id", "replace(text, '\\0', '\\u0001') AS text")
    compared(spark, "op3_license_scan", license_scan.license_scan(clean), odd)


def test_models_learn_from_all_rows(spark):
    from pyspark.sql import functions as F

    rows = [(k, f"good words number {k % 7}" if k % 2 else f"$$ ## {k % 5} BAD", "en" if k % 3 else "de") for k in range(45_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    met = []
    kept, resampling.gram_counts = resampling.gram_counts, lambda d, ids: met.append(ids.count()) or kept(d, ids)
    try:
        resampling.resampled(docs, labels)
    finally:
        resampling.gram_counts = kept
    assert met == [docs.where("crc32(cast(doc_id as string)) % 5 != 2").count()]  # above the 20,000 of the bounded fit before
    some = docs.where("doc_id < 2400")
    marks = language_id.Landmarks(["good words number 1", "$$ ## 2 BAD"])
    gram, _ = language_id._ridge_parts(some, marks, ["de", "en"])
    assert gram[-1, -1] == 2400
    seen = []
    parts, language_id._ridge_parts = language_id._ridge_parts, lambda r, *x: seen.append(r.count()) or parts(r, *x)
    try:
        language_id.fit(some)
    finally:
        language_id._ridge_parts = parts
    assert seen == [2400]  # 500 of each language before


def test_quantile(spark):
    from pyspark.sql import functions as F

    values = [float(x) for x in np.random.RandomState(1).randn(301)]
    frame = spark.createDataFrame([(v,) for v in [*values, values[0]]], "key double")
    for share in (0.0, 0.002, 0.1, 0.37, 1.0):
        assert resampling.quantile(frame, share) == pytest.approx(frame.agg(F.percentile("key", share)).first()[0], abs=1e-12)
    assert resampling.quantile(frame.where("false"), 0.1) is None


def test_rare_contexts_have_restaurants(spark):
    """Held by the tasks or not, every word has a restaurant: the same text scores nearly the same, and tokens behind rare words are known."""
    r = random.Random(5)
    turns = [("the",), ("of",), ("and",), *[(f"k{i}", f"v{i}") for i in range(40)]]
    texts = [" ".join(x for _ in range(r.randint(0, 30)) for x in r.choice(turns)) for _ in range(80)] + [None, ""]
    rows = [*enumerate(texts), (3, texts[3]), (3, texts[3])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held, joined, none = ({x.doc_id: x for x in pitman_yor.score(frame, share=share, least=least).collect()} for share, least in ((10**6, 1), (8, 1), (8, 10**6)))
    assert pitman_yor.score(frame, share=8, least=1).where("doc_id = 3").count() == 3
    for k in held:
        assert held[k][:6] == joined[k][:6] or math.isclose(held[k].base_score, joined[k].base_score)
    total = [sum(x.score for x in got.values()) for got in (held, joined, none)]
    assert abs(total[0] - total[1]) < 0.05 * abs(total[0]) and total[2] < 1.1 * total[1]  # the rare ones have a discount of their own
