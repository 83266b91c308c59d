"""Expressions about queries and hits: features, categories, and filters by type, region and content."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Document types and what else they are called.
DOCUMENT_TYPES = {
    "pis": ("pis", "pi", "prescribing_information", "prescribing-information", "prescribing information", "product_information", "product-information", "product information"),
    "lrd": ("lrd", "label_repository_data", "label repository data", "label_repository_document", "label repository document", "label-data"),
    "hpl": ("hpl", "health_product_label", "health product label", "product label", "product_label"),
    "past_cases": ("past_cases", "past-cases", "history", "user_history"),
}
#: Regions and their aliases.
REGIONS = {
    "us": ("US", "USA", "UNITED STATES", "UNITED_STATES"),
    "eu": ("EU", "EUROPE", "EMA"),
    "uk": ("UK", "UNITED KINGDOM", "UNITED_KINGDOM", "GB"),
    "np": ("NP", "NEPAL"),
    "ca": ("CA", "CANADA"),
    "global": ("GLOBAL", "WORLDWIDE"),
}
#: The terms of each feature of a query.
FEATURE_TERMS = {
    "has_drug_names": "azithromycin|amoxicillin|ciprofloxacin|metronidazole|fluconazole|acyclovir|valacyclovir|oseltamivir|ibuprofen|acetaminophen|aspirin|warfarin|atorvastatin|simvastatin|metformin|lisinopril|amlodipine|prednisone|albuterol|fluticasone|omeprazole|ondansetron|morphine|oxycodone|hydrocodone",
    "has_dosage_terms": r"dosage|dose|mg|mcg|g|ml|tablet|capsule|frequency|daily|twice|three times|q\d*h|administration|route",
    "has_safety_terms": "side effects|adverse|toxicity|contraindication|warning|interaction|allergic|hypersensitivity|overdose|poisoning|risk|danger|caution",
    "has_age_terms": "pediatric|children|infant|neonate|adolescent|geriatric|elderly|senior|pregnant|lactating|pregnancy|breastfeeding",
    "has_condition_terms": "pneumonia|infection|hypertension|diabetes|asthma|copd|arthritis|depression|anxiety|epilepsy|migraine|osteoporosis|heart failure|stroke|kidney disease|liver disease",
    "has_cardiac_terms": "qt|qtc|torsades|arrhythmia|cardiac|heart|rhythm|tachycardia|bradycardia|fibrillation|palpitation|electrocardiogram|ecg|ekg",
    "has_hepatic_terms": "liver|hepatic|hepatotoxicity|jaundice|bilirubin|alt|ast|transaminitis|cirrhosis|hepatitis",
    "has_renal_terms": "kidney|renal|nephrotoxicity|creatinine|bun|gfr|dialysis|acute kidney injury|chronic kidney disease",
    "has_monitoring_terms": "monitor|monitoring|check|test|lab|blood|urine|ecg|ekg|follow|surveillance",
    "has_regulatory_terms": "fda|ema|regulatory|compliance|approved|indication|labeling|pi|lrd|hpl",
    "has_pharmacokinetic_terms": "absorption|distribution|metabolism|excretion|half.life|clearance|bioavailability|pharmacokinetics|pk",
}
#: Features whose terms are counted, question words, and the terms of a feedback entry's query.
COUNTED = {"drug_count": "has_drug_names", "safety_term_count": "has_safety_terms", "age_term_count": "has_age_terms"}
QUESTION_WORDS = ("what", "how", "why", "when", "where", "which")
FEEDBACK_TERMS = {
    "contains_drug_name": ("azithromycin", "amoxicillin", "ciprofloxacin", "metronidazole", "fluconazole", "acyclovir", "ibuprofen", "acetaminophen"),
    "contains_safety_terms": ("side effects", "adverse", "toxicity", "safe", "danger"),
    "contains_dosing_terms": ("dosage", "dose", "mg", "tablet", "frequency"),
}
#: Categories of queries in order of precedence.
CATEGORIES = {"safety": ("adverse", "toxicity", "contraindication", "warning"), "dosing": ("dosage", "dose", "mg", "administration"), "indication": ("treatment", "indication", "use", "therapy")}
#: A word of the query, and words of a section's title that answer it.
SECTION_RULES = (("safety", ("warning", "adverse", "contraindication")), ("dose", ("dosage",)), ("pediatric", ("pediatric", "children")))


def _bare(text: Column) -> Column:
    return F.lower(F.trim(text))


def _looked_up(key: Column, rows: Mapping[str, Sequence[str]]) -> Column:
    return F.element_at(F.create_map(*[x for k, vs in rows.items() for x in (F.lit(k), F.array(*map(F.lit, vs)))]), key) if rows else F.lit(None)


def document_type(text: Column, types: Mapping[str, Sequence[str]] = DOCUMENT_TYPES) -> Column:
    """struct(canonical, variants): the type that a name stands for and all names of it in lower and upper case, sorted. Empty or null: null and none."""
    to = {name: canonical for canonical, names in types.items() for name in (canonical, *names)}
    canonical = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in to.items() for x in kv]), _bare(text)), _bare(text))
    every = {c: sorted({v for n in (c, *ns) for v in (n.lower(), n.upper())}) for c, ns in types.items()}
    variants = F.coalesce(_looked_up(canonical, every), F.array(canonical, F.upper(canonical)))
    empty = text.isNull() | (text == "")
    return F.struct(F.when(~empty, canonical).alias("canonical"), F.when(empty, F.array().cast("array<string>")).otherwise(variants).alias("variants"))


def region(text: Column, regions: Mapping[str, Sequence[str]] = REGIONS) -> Column:
    """struct(canonical, variants): a known region in capitals and its aliases, sorted; any other in capitals. Empty or null: null and none."""
    known = _looked_up(_bare(text), {k: sorted({*vs, k.upper()}) for k, vs in regions.items()})
    empty = text.isNull() | (text == "")
    canonical = F.when(known.isNotNull(), F.upper(F.trim(text))).otherwise(F.upper(text))
    return F.struct(F.when(~empty, canonical).alias("canonical"), F.when(empty, F.array().cast("array<string>")).otherwise(F.coalesce(known, F.array(F.upper(text)))).alias("variants"))


def of_type(kind: Column, wanted: str | Column | None) -> Column:
    """Whether a hit's type is the wanted one, whatever the case and spaces around; all are where none is wanted."""
    if wanted is None or isinstance(wanted, str) and not wanted:
        return F.lit(True)
    return F.lower(F.trim(F.coalesce(kind, F.lit("")))) == F.lower(F.trim(F.lit(wanted) if isinstance(wanted, str) else wanted))


def has_content(text: Column, rank: Column, first: int = 15) -> Column:
    """Aggregate: whether one of the first hits has text that isn't blank."""
    return F.coalesce(F.bool_or((rank <= first) & F.coalesce(F.regexp_replace(text, r"\s+", "") != "", F.lit(False))), F.lit(False))


def features(query: Column, terms: Mapping[str, str] = FEATURE_TERMS) -> Column:
    """struct of the features of a query: length in words, question mark, question word, a flag for each kind of term, three counts."""
    q = F.lower(query)
    flags = [q.rlike(rf"(?U)\b({pattern})\b").alias(name) for name, pattern in terms.items()]
    counts = [F.regexp_count(q, F.lit(rf"(?U)\b({terms[of]})\b")).alias(name) for name, of in COUNTED.items() if of in terms]
    starts = q.rlike(r"\A(" + "|".join(QUESTION_WORDS) + ")")
    return F.struct(F.size(F.filter(F.split(q, r"\s+"), lambda x: x != "")).alias("length"), q.endswith("?").alias("has_question_mark"), starts.alias("starts_with_wh"), *flags, *counts)


def _any(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(F.lower(text), F.lit(t))
    return out


def feedback_metadata(query: Column, terms: Mapping[str, Sequence[str]] = FEEDBACK_TERMS) -> Column:
    """struct(length, has_question_mark, word_count and a flag for each kind of term) that a feedback entry keeps of its query."""
    n = F.size(F.filter(F.split(query, r"\s+"), lambda x: x != ""))
    return F.struct(n.alias("length"), query.endswith("?").alias("has_question_mark"), n.alias("word_count"), *[_any(query, ts).alias(name) for name, ts in terms.items()])


def category(query: Column, categories: Mapping[str, Sequence[str]] = CATEGORIES) -> Column:
    out = F.lit("general")
    for name, terms in reversed(list(categories.items())):
        out = F.when(_any(query, terms), name).otherwise(out)
    return out


def section_relevance(query: Column, title: Column, rules: Sequence[tuple[str, Sequence[str]]] = SECTION_RULES) -> Column:
    """1 where the section's title answers the first rule whose word stands in the query and whose words stand in the title, else 0."""
    out = F.lit(False)
    for word, terms in rules:
        out = out | (F.contains(F.lower(query), F.lit(word)) & _any(F.coalesce(title, F.lit("")), terms))
    return F.when(out, 1.0).otherwise(0.0)
