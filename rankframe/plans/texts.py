"""Queries of the text and language expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankframe.functions import lang
from rankframe.functions import text as T
from rankframe.plans.common import registering, table

QUERIES: dict = {}
ORACLES: dict = {}
register = registering(QUERIES, ORACLES)

CLASSES = (("legal", ("licensed", "license")), ("personal", ("@", "phone")), ("table", (" | ",)), ("loud", ("!!",)))
WEIGHTS = {"the": 2.0, "und": 3.0, "que": 4.0, "licensed": 6.0}


@register(
    r"""SELECT doc_id,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS normalized,
  trim(regexp_replace(regexp_replace(text, '-\s*\n\s*', '', 'g'), '\s+', ' ', 'g')) AS metadata FROM documents"""
)
def text_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1, B2."""
    return table(spark, sf_dir, "documents").select("doc_id", T.normalised(F.col("text")).alias("normalized"), T.for_metadata(F.col("text")).alias("metadata"))


#: The rule's own words, written out again here so that the SQL is independent of the library.
STOP_SQL = "the and for with from that this have will shall under when into upon such which been were your their than about each within while those these there after before during because other where patients patient should could would might effect effects used using use dose doses per day days week weeks month months or of via into onto"


@register(
    rf"""SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z]{{2,}}')) AS n_tokens,
  len(list_filter(regexp_extract_all(lower(text), '[a-z]{{2,}}'), lambda x: NOT list_contains(string_split('{STOP_SQL}', ' '), x))) AS n_content,
  len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n_words FROM documents"""
)
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4, B5, B6."""
    t = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(T.without(t)).cast("long").alias("n_content"), F.size(T.words(F.col("text"))).cast("long").alias("n_words"))


@register(
    r"""WITH f AS (SELECT doc_id, text, regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])\d+\.?\d*\s*((mg|mcg|µg|g|kg|ml|l|percent|mmol|iu|units?)([^\p{L}\p{N}_]|$)|%[\p{L}\p{N}_])') OR regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])\d+\.?\d*\s*((times|fold|x)([^\p{L}\p{N}_]|$)|×[\p{L}\p{N}_])')
    OR regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])p\s*[<>=]\s*0\.\d+([^\p{L}\p{N}_]|$)') OR regexp_matches(text, '(^|[^\p{L}\p{N}_])\d+\.?\d*\s*[:/]\s*\d+(\.\d+)?([^\p{L}\p{N}_]|$)') AS has_numeric_data,
  len(regexp_extract_all(text, '\d+')) + len(regexp_extract_all(text, '[A-Z]')) + len(regexp_extract_all(text, '[,:]')) + len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: length(x) > 8)) AS marks FROM documents)
SELECT doc_id, has_numeric_data, round(least(marks::DOUBLE / greatest(length(text), 1) * 100, 1.0), 6) AS text_density, length(text) AS char_count, regexp_extract(text, '^\s*(\d+(?:\.\d+)*)', 1) AS section_code FROM f"""
)
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B14, B16, B17."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.matches_any(t).alias("has_numeric_data"), F.round(T.density(t), 6).alias("text_density"), F.length(t).cast("long").alias("char_count"), T.section_number(t).alias("section_code"))


@register(
    """SELECT doc_id, CASE WHEN contains(lower(text), 'licensed') OR contains(lower(text), 'license') THEN 'legal' WHEN contains(text, '@') OR contains(lower(text), 'phone') THEN 'personal' WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!!') THEN 'loud' ELSE 'general' END AS chunk_class,
  (CASE WHEN contains(lower(text), 'the') THEN 2.0 ELSE 0.0 END + CASE WHEN contains(lower(text), 'und') THEN 3.0 ELSE 0.0 END + CASE WHEN contains(lower(text), 'que') THEN 4.0 ELSE 0.0 END + CASE WHEN contains(lower(text), 'licensed') THEN 6.0 ELSE 0.0 END)::DOUBLE AS relevance,
  length(trim(text)) < 50 AS very_short FROM documents"""
)
def text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B15, B18, B19, B20 with a fixture lexicon."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.first_class(t, CLASSES, "general").alias("chunk_class"), T.weighted_presence(t, WEIGHTS).alias("relevance"), (F.length(F.trim(t)) < 50).alias("very_short"))


@register(
    r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM documents),
c AS (SELECT doc_id, token, count(*) AS n FROM t WHERE regexp_full_match(token, '[a-z]{4,}') AND NOT list_contains(string_split('with from this that have been their there which should would could will into about after before during without between includes including because where when those these such other also more most', ' '), token) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS rank FROM c)
SELECT doc_id, token, n, rank FROM r WHERE rank <= 8"""
)
def text_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most frequent words of four letters or more."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.without(T.keyword_tokens(F.col("text")), T.KEYWORD_STOP_WORDS)).alias("token"))
    counts = t.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "token"))
    return counts.withColumn("rank", rank.cast("long")).where("rank <= 8")


#: Texts as they are, and with their letters moved to the ranges of other scripts (all, half or a third of them), so that every rule acts.
MOVED = {0: "", 1: "ابتثجحخدذرزسشصضطظعغفقكلمنه", 2: "中国人民大学生活水平高低上下左右东西南北风雨雷电日月", 3: "あいうえおかきくけこさしすせそたちつてとなにぬねのは", 4: "가나다라마바사아자차카타파하거너더러머버서어저처커터", 5: "абвгдежзийклмнопрстуфхцчшщ", 6: "абвгдежз"}
LANG_SQL = (
    "WITH m0 AS (SELECT doc_id, CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN translate(text, '{'abcdefghijklmnopqrstuvwxyz'[: len(v)]}', '{v}')" for k, v in MOVED.items() if v) + " ELSE text END AS text FROM documents), "
    "x AS (SELECT doc_id, text, lower(left(text, 500)) AS s FROM m0), "
    "w AS (SELECT lang, row_number() OVER () AS o, string_split(ws, ' ') AS ws FROM (VALUES ('es', 'el la los las de del que para con por gobierno política'), ('fr', 'le la les de du des et pour dans avec gouvernement politique'), ('de', 'der die das und ist für mit von regierung politik'), "
    "('pt', 'o a os as de do da que para com governo política'), ('it', 'il lo la i gli le di del che per governo politica')) v(lang, ws)), "
    "v AS (SELECT doc_id, lang, o, len(list_filter(ws, lambda k: contains(' ' || s || ' ', ' ' || k || ' '))) AS n FROM x, w), "
    "b AS (SELECT doc_id, first(lang ORDER BY n DESC, o) AS lang, max(n) AS n FROM v GROUP BY 1), "
    "c AS (SELECT doc_id, text, length(s) AS size, " + ", ".join(f"len(regexp_extract_all(s, '[{r}]')) AS {k}" for k, r in (("ar", r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}"), ("zh", r"\x{4E00}-\x{9FFF}"), ("ja", r"\x{3040}-\x{30FF}"), ("ko", r"\x{AC00}-\x{D7AF}"), ("ru", r"\x{0400}-\x{04FF}"))) + " FROM x) "
    "SELECT doc_id, CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 10 THEN 'en' WHEN ar > size * 0.3 THEN 'ar' WHEN zh > size * 0.3 THEN 'zh' WHEN ja > size * 0.2 THEN 'ja' WHEN ko > size * 0.3 THEN 'ko' WHEN ru > size * 0.3 THEN 'ru' WHEN b.n >= 3 THEN b.lang ELSE 'en' END AS language FROM c JOIN b USING (doc_id)"
)


@register(f"WITH d AS ({LANG_SQL}) SELECT doc_id, language, CASE language WHEN 'de' THEN 'German' WHEN 'en' THEN 'English' WHEN 'es' THEN 'Spanish' WHEN 'fr' THEN 'French' WHEN 'pt' THEN 'Portuguese' WHEN 'it' THEN 'Italian' WHEN 'ar' THEN 'Arabic' WHEN 'zh' THEN 'Chinese' WHEN 'ja' THEN 'Japanese' WHEN 'ko' THEN 'Korean' WHEN 'ru' THEN 'Russian' ELSE 'Unknown' END AS language_name FROM d")
def text_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the texts as they are and with their letters moved to other scripts."""
    moved = F.col("text")
    for k, letters in MOVED.items():
        if letters:
            moved = F.when(F.col("doc_id") % 7 == k, F.translate("text", "abcdefghijklmnopqrstuvwxyz"[: len(letters)], letters)).otherwise(moved)
    found = table(spark, sf_dir, "documents").select("doc_id", lang.detect(moved).alias("language"))
    return found.withColumn("language_name", lang.name(F.col("language")))


@register(
    r"""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN left(text, 30) WHEN 2 THEN text ELSE text || chr(10) END AS t FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(t) = '' THEN 'empty_text' WHEN length(t) < 50 THEN 'very_short_text' END, CASE WHEN right(t, 1) NOT IN ('.', '!', '?', chr(10)) THEN 'abrupt_ending' END], lambda x: x IS NOT NULL), ',') AS issues FROM t"""
)
def page_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over whole texts, their starts and none."""
    k, t = F.col("doc_id") % 4, F.col("text")
    shown = F.when(k == 0, "").when(k == 1, F.left(t, F.lit(30))).when(k == 2, t).otherwise(F.concat(t, F.lit("\n")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.page_issues(shown), ",").alias("issues"))


@register(
    r"""WITH w AS (SELECT c.conv_id, c.turn, list_distinct(list_filter(regexp_split_to_array(lower(c.text), '\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(n.text), '\s+'), lambda x: x <> '')) AS b,
  list_distinct(regexp_extract_all(lower(c.text), '(?s).')) AS ca, list_distinct(regexp_extract_all(lower(n.text), '(?s).')) AS cb FROM conversations c JOIN conversations n ON c.conv_id = n.conv_id AND n.turn = c.turn + 1),
s AS (SELECT conv_id, turn, CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0.0 END AS w, CASE WHEN len(ca) + len(cb) > 0 THEN len(list_intersect(ca, cb))::DOUBLE / (len(ca) + len(cb) - len(list_intersect(ca, cb))) ELSE 0.0 END AS c FROM w)
SELECT conv_id, turn, round(w, 6) AS word_similarity, round(0.3 * c + 0.7 * w, 6) AS blended_similarity FROM s"""
)
def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the next."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    both = c.join(n, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.round(T.word_similarity(F.col("text"), F.col("after")), 6).alias("word_similarity"), F.round(T.blended_similarity(F.col("text"), F.col("after")), 6).alias("blended_similarity"))


@register(
    """SELECT page_id, url, list_extract(string_split(url, '/'), -1) AS file_name, coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/]+)', 1), ''), 'unknown') AS host,
  len(list_filter(list_transform(string_split(url, '/'), lambda x: trim(x)), lambda x: x <> '')) AS n_parts FROM pages"""
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of links."""
    u = F.col("url")
    parts = F.split(u, "/")
    host = T.first_filled(F.regexp_extract(u, "^[a-z]+://([^/]+)", 1), default="unknown")
    return table(spark, sf_dir, "pages").select("page_id", "url", F.element_at(parts, -1).alias("file_name"), host.alias("host"), F.size(T.tags(F.replace(u, F.lit("/"), F.lit(",")))).cast("long").alias("n_parts"))


@register(
    """SELECT event_id, user_id, coalesce(json_extract_string(props, '$.page'), json_extract_string(props, '$.k'), '') AS page, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, props IS NOT NULL AS has_props FROM events"""
)
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON text with a fallback."""
    p = F.col("props")
    page = F.coalesce(F.get_json_object(p, "$.page"), F.get_json_object(p, "$.k"), F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", "user_id", page.alias("page"), F.coalesce(F.get_json_object(p, "$.k").try_cast("long"), F.lit(-1)).alias("k"), p.isNotNull().alias("has_props"))


@register(
    r"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, array_to_string(ws[i + 1 : i + 8], ' ') AS phrase FROM (SELECT item_id, ws, unnest(range(greatest(len(ws) - 7, 1))) AS i FROM w)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(phrase) DESC, phrase) AS r FROM p WHERE length(phrase) BETWEEN 10 AND 100)
SELECT item_id, coalesce((SELECT string_agg(phrase, '|' ORDER BY r.r) FROM r WHERE r.item_id = w.item_id AND r.r <= 3), '') AS phrases FROM w"""
)
def text_key_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B35."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.key_phrases(F.col("text")), "|").alias("phrases"))
