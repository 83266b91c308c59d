"""The registered queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.llm import bpe, centroids, language_id, license_scan, media, merkle, mixing, packing, pitman_yor, quality_rules, resampling, simhash, toxicity
from rankframe.llm.common import table


def op1_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.stored(table(spark, sf_dir, "documents")))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"), least=1)


def op6_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op9_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rule_verdicts(table(spark, sf_dir, "documents"))


def op11_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proved(table(spark, sf_dir, "documents"))


def op13_centroid_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings")).drop("n_measured")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_media_webp, op2_mix_sources, op3_license_scan, op4_language_id, op5_pitman_yor, op6_simhash_golay, op7_importance_resampling, op8_byte_bpe, op9_toxicity_nnpu, op10_quality_rules, op11_pack_sequences, op12_merkle_manifest, op13_centroid_threshold, pipeline)}

#: A word of the license scan.
LICENSE_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Water-filling, prefix sums in hash order and the inverse of the schedules' integrals, as in mixing.py.
MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')) AS h FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
numbered AS (SELECT source, source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS ordinal FROM per),
weighed AS (SELECT *, CAST(ordinal % 3 + 1 AS DOUBLE) AS w, 3.0 * CAST(source_size AS DOUBLE) AS cap FROM numbered),
levels AS (SELECT *,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM weighed),
final AS (SELECT arg_min(level, cap / w) AS level FROM levels WHERE NOT cap < level * w),
targets AS (SELECT source, ordinal, source_size, CASE WHEN cap < l.level * w THEN cap ELSE least(cap, f.level * w) END AS target FROM levels l, final f),
plan AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM targets),
passes AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS passes FROM plan),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.ordinal, p.quota, p.passes, p.quota - p.passes * p.source_size AS rest,
    coalesce(sum(s.size) OVER (PARTITION BY p.ordinal ORDER BY s.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes s JOIN passes p ON s.source IS NOT DISTINCT FROM p.source),
mixed AS (SELECT *, greatest(0, least(size, rest - before)) AS extra, row_number() OVER () AS rid FROM placed),
turns AS (SELECT *, CAST(passes * size + extra AS BIGINT) AS taken, unnest(CASE WHEN size = 0 OR passes * size + extra = 0 THEN [NULL] ELSE range(passes + CASE WHEN extra > 0 THEN 1 ELSE 0 END) END) AS turn FROM mixed),
timed AS (SELECT rid, doc_id, size, source_size, target, taken, ordinal, CAST(turn * source_size + before AS DOUBLE) / quota AS share FROM turns)
SELECT doc_id, size, source_size, target, taken, min(t) AS position, max(t) AS last_position FROM (
  SELECT *, CASE WHEN share IS NOT NULL THEN CASE ordinal % 3
    WHEN 1 THEN share
    WHEN 0 THEN (1.5 - sqrt(greatest(0.0, 2.25 - 2 * share)))
    ELSE (sqrt(greatest(0.0, 0.25 + 2 * share)) - 0.5) END END AS t FROM timed)
GROUP BY rid, doc_id, size, source_size, target, taken
"""

def _rows(pairs: Iterable[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in p) + ")" for p in pairs)


#: Places of the phrases among all words, and every template against every block of its width, without the join's filters.
LICENSE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, doc_id, regexp_extract_all(t, '{LICENSE_WORDS}') AS ws FROM d),
ph AS (SELECT label, regexp_extract_all(phrase, '{LICENSE_WORDS}') AS ps FROM (VALUES {_rows(license_scan.PHRASES.items())}) v(phrase, label)),
pl AS (SELECT rid, label, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1 : i + len(ps)] = ps)) AS place FROM w JOIN ph ON list_has_all(ws, ps)),
ba AS (SELECT rid, count(*) AS n, min(place) AS lo, max(place) AS hi, list(DISTINCT label) AS ls FROM pl GROUP BY rid),
no AS (SELECT label, regexp_extract_all(lower(notice), '{LICENSE_WORDS}') AS every, regexp_extract_all(lower(wo), '{LICENSE_WORDS}') AS wo FROM (VALUES {_rows(license_scan.TEMPLATES)}) v(label, notice, wo)),
te AS (SELECT row_number() OVER () AS template, label, list_distinct(every) AS ts, ' ' || array_to_string(every, ' .* ') || ' ' AS pattern, wo, greatest(8, 2 ** ceil(log2(1.25 * len(every))))::INT AS width FROM no),
bl AS (SELECT rid, width, block, ' ' || array_to_string(ws[block * width + 1 : block * width + 2 * width], '  ') || ' ' AS run, list_distinct(ws[block * width + 1 : block * width + 2 * width]) AS bs FROM (
  SELECT rid, ws, width, unnest(range(((len(ws) + width - 1) // width)::BIGINT)) AS block FROM w, (SELECT DISTINCT width FROM te))),
pr AS (SELECT rid, block, template, label, len(list_intersect(bs, ts)) AS shared, len(ts) AS size, list_has_any(bs, wo) AS other, run, pattern FROM bl JOIN te USING (width)),
mt AS (SELECT rid, list(DISTINCT label) AS ls, max(shared::DOUBLE / size) AS share, count(*) AS n FROM pr
  WHERE NOT other AND shared >= CASE WHEN size < {license_scan.SHORT} THEN size ELSE ceil({license_scan.CONTAINMENT} * size - 1e-9) END AND (size >= {license_scan.SHORT} OR regexp_matches(run, pattern)) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(ba.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(ba.ls, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(coalesce(ba.ls, []) || coalesce(mt.ls, []))), ',') AS labels,
  CASE WHEN ba.n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score, coalesce(mt.n, 0)::BIGINT AS n_blocks
FROM w LEFT JOIN ba USING (rid) LEFT JOIN mt USING (rid)
"""


def _levels(start: str, by: str, levels: int, first: str) -> str:
    """CTEs of the nodes <first>0, <first>1, ... of trees of up to 16^levels leaves, their runs, and the paths of all leaves through them."""
    out = [f"{first}0 AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY {by}) AS n FROM {start}), {first}f0 AS MATERIALIZED (SELECT *, pos AS p, h AS own, '' AS proof FROM {first}0)"]
    for k in range(levels):
        out.append(f"""{first}r{k} AS MATERIALIZED (SELECT {by}, pos // 16 AS run, any_value(n) AS n, list(h ORDER BY pos) AS hs FROM {first}{k} GROUP BY ALL),
{first}{k + 1} AS MATERIALIZED (SELECT {by}, run AS pos, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {first}r{k}),
{first}f{k + 1} AS MATERIALIZED (SELECT f.* REPLACE (f.p // 16 AS p, CASE WHEN r.n = 1 THEN f.folded ELSE sha256(array_to_string(hs[:f.p % 16], '') || f.folded || array_to_string(hs[f.p % 16 + 2:], '')) END AS folded,
  CASE WHEN r.n = 1 THEN f.proof ELSE f.proof || array_to_string(hs[:f.p % 16], '') || array_to_string(hs[f.p % 16 + 2:], '') END AS proof) FROM {first}f{k} f JOIN {first}r{k} r ON f.{by} = r.{by} AND f.p // 16 = r.run)""")
    return ",\n".join(out)


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 bit by bit over the digits of the id.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))))"
#: Trees of up to 16^5 documents and 16^4 sources, all levels written out.
MERKLE_SQL = f"""
WITH lf AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, sha256(concat({", ".join(_FIELD.format(c) for c in merkle.FIELDS)})) AS h,
  CASE WHEN {_CRC} % 5 = 0 THEN sha256(concat({", ".join(_FIELD.format(c) for c in merkle.FIELDS[:-1])}, CASE WHEN text IS NULL THEN '-' ELSE strlen({_LOW}) || ':' || {_LOW} END)) END AS t FROM documents),
ps AS (SELECT *, coalesce(t, h) AS folded, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM lf),
{_levels("ps", "tree", 5, "a")},
sr AS (SELECT tree AS source, h, h AS folded, '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos FROM a5),
{_levels("sr", "tree", 4, "b")},
fl AS (SELECT f.doc_id, f.own, f.folded AS at_source, f.proof AS below, s.h AS subroot, s.pos FROM af5 f JOIN sr s ON f.tree = s.source),
g0 AS (SELECT *, pos AS p, at_source AS folded FROM fl),
{", ".join(f"g{k + 1} AS (SELECT g.* REPLACE (g.p // 16 AS p, CASE WHEN r.n = 1 THEN g.folded ELSE sha256(array_to_string(hs[:g.p % 16], '') || g.folded || array_to_string(hs[g.p % 16 + 2:], '')) END AS folded) FROM g{k} g JOIN br{k} r ON g.p // 16 = r.run)" for k in range(4))}
SELECT doc_id, g4.own AS leaf, g4.subroot, b4.h AS root, sha256(below || bf4.proof) AS proof_sha256, g4.folded AS folded_root, g4.folded = b4.h AS verified, (len(below || bf4.proof) // 64)::BIGINT AS n_siblings
FROM g4 JOIN bf4 ON bf4.pos = g4.pos, b4
"""

_CLUSTER_ROUNDS = ",\n".join(
    f"""a{r} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v.e) AS e, min({{'d': list_sum(list_transform(list_zip(v.e, k.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c}}) AS b FROM v, c{r} k GROUP BY rid),
s{r} AS (SELECT c, list(x ORDER BY i) AS e FROM (SELECT b.c AS c, i, floor(sum(e[i]) / count(*))::BIGINT AS x FROM a{r}, range(1, 65) t(i) GROUP BY ALL) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT k.c, coalesce(s.e, k.e) AS e FROM c{r} k LEFT JOIN s{r} s ON k.c = s.c)""" for r in range(11))  # fmt: skip
#: All rounds written out, every vector against every centroid.
CLUSTER_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), e) - 1 AS c, e FROM v QUALIFY c < 8),
{_CLUSTER_ROUNDS}
SELECT vec_id, b.c::INT AS cluster, b.d AS distance, sum(b.d) OVER (PARTITION BY b.c)::BIGINT AS cluster_inertia, sum(b.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(k.e, ',')) AS centroid_sha256 FROM a10 JOIN c10 k ON k.c = b.c
"""

ORACLES: dict[str, str] = {"op2_mix_sources": MIX_SQL, "op3_license_scan": LICENSE_SQL, "op12_merkle_manifest": MERKLE_SQL, "op13_centroid_threshold": CLUSTER_SQL}
