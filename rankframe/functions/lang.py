"""Language by script and by frequent words, of the first characters of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankframe.functions import text as T

#: Script ranges and the share of the sample that decides.
SCRIPTS = (
    ("ar", "[\\u0600-\\u06FF\\u0750-\\u077F\\u08A0-\\u08FF]", 0.3),
    ("zh", "[\\u4E00-\\u9FFF]", 0.3),
    ("ja", "[\\u3040-\\u309F\\u30A0-\\u30FF]", 0.2),
    ("ko", "[\\uAC00-\\uD7AF]", 0.3),
    ("ru", "[\\u0400-\\u04FF]", 0.3),
)
#: Words that vote for languages in Latin script, in order of precedence.
KEYWORDS = {
    "es": ("el", "la", "los", "las", "de", "del", "que", "para", "con", "por", "gobierno", "política"),
    "fr": ("le", "la", "les", "de", "du", "des", "et", "pour", "dans", "avec", "gouvernement", "politique"),
    "de": ("der", "die", "das", "und", "ist", "für", "mit", "von", "regierung", "politik"),
    "pt": ("o", "a", "os", "as", "de", "do", "da", "que", "para", "com", "governo", "política"),
    "it": ("il", "lo", "la", "i", "gli", "le", "di", "del", "che", "per", "governo", "politica"),
}
#: Names of languages.
NAMES = {
    "en": "English", "ar": "Arabic", "fr": "French", "es": "Spanish", "de": "German", "pt": "Portuguese", "it": "Italian", "zh": "Chinese", "ja": "Japanese",
    "ko": "Korean", "ru": "Russian", "hi": "Hindi", "tr": "Turkish", "nl": "Dutch", "sv": "Swedish", "pl": "Polish", "uk": "Ukrainian",
}
SAMPLE, LEAST_CHARS, LEAST_VOTES = 500, 10, 3


def detect(text: Column) -> Column:
    """en where the text is short or no other language has enough of its words."""
    codes = F.array(*map(F.lit, KEYWORDS))

    def first_of_most(v: Column) -> Column:
        return F.when(F.array_max(v) >= LEAST_VOTES, F.element_at(codes, F.array_position(v, F.array_max(v)).cast("int"))).otherwise("en")

    def of(sample: Column) -> Column:
        votes = T.let(F.split(sample, " "), lambda words: F.array(*[F.size(F.array_intersect(words, F.array(*map(F.lit, ws)))) for ws in KEYWORDS.values()]))
        out = T.let(votes, first_of_most)
        for lang, pattern, share in reversed(SCRIPTS):
            out = F.when(F.regexp_count(sample, F.lit(pattern)) > F.length(sample) * share, lang).otherwise(out)
        return out

    found = T.let(F.lower(F.left(text, F.lit(SAMPLE))), of)  # each value is computed once, however many words are looked for
    return F.when(F.coalesce(F.length(F.regexp_replace(text, r"^\s+|\s+\z", "")), F.lit(0)) < LEAST_CHARS, "en").otherwise(found)


def name(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), code), F.lit("Unknown"))
