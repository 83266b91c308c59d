"""What a query is after: a table of rules by pattern, keyword, feature and context, weighed in one pass over each query."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankframe.functions import queries as Q


class Rule(NamedTuple):
    """intent gains weight where the condition holds: a pattern or a keyword of the lower-case query, or a SQL condition over its features.

    kind: pattern, keyword, feature or context (a condition on several features)."""

    intent: str
    kind: str
    condition: str
    weight: float


#: Intents in order of precedence among equals.
INTENTS = (
    "safety_concerns", "dosing_inquiry", "drug_information", "condition_treatment", "drug_interaction", "adverse_event", "pediatric_concerns", "geriatric_concerns",
    "pregnancy_lactation", "contraindication", "pharmacokinetics", "monitoring_guidance", "general_medical", "regulatory_compliance",
)
#: Patterns, keywords, features and contexts with their weights.
RULES = (
    Rule("safety_concerns", "pattern", r"\b(side effects?|adverse (effects?|reactions?)|toxicity|poisoning)\b", 3.0),
    Rule("safety_concerns", "pattern", r"\b(risks?|dangers?|cautions?|warnings?)\b", 2.0),
    Rule("safety_concerns", "pattern", r"\b(safe|unsafe|dangerous)\b", 1.5),
    Rule("dosing_inquiry", "pattern", r"\b(dosage|dose|mg|mcg|g|ml|tablet|capsule)\b", 2.5),
    Rule("dosing_inquiry", "pattern", r"\b(frequency|daily|twice|three times|q\d*h)\b", 2.0),
    Rule("dosing_inquiry", "pattern", r"\b(administration|route|oral|iv|im|sc)\b", 1.5),
    Rule("drug_interaction", "pattern", r"\b(interaction|interactions|combined with|together with)\b", 3.0),
    Rule("drug_interaction", "pattern", r"\b(with|and|plus)\s+(another|other)\s+drug\b", 2.0),
    Rule("adverse_event", "pattern", r"\b(nausea|vomiting|diarrhea|rash|dizziness|headache|fatigue|insomnia|constipation|abdominal pain|fever|chills|cough|shortness of breath|chest pain|palpitations|swelling|bruising|bleeding|jaundice|confusion|seizures)\b", 2.5),
    Rule("pediatric_concerns", "pattern", r"\b(pediatric|children|infant|neonate|adolescent|kids?|baby|child)\b", 3.0),
    Rule("pediatric_concerns", "pattern", r"\b(under \d+ years?|age \d+|\d+ years? old)\b", 2.0),
    Rule("geriatric_concerns", "pattern", r"\b(geriatric|elderly|senior|old|aging|age \d+|\d+ years? old)\b", 3.0),
    Rule("pregnancy_lactation", "pattern", r"\b(pregnant|pregnancy|lactating|lactation|breastfeeding|breast milk|breastfed)\b", 3.0),
    Rule("contraindication", "pattern", r"\b(contraindicated|contraindication|avoid|not recommended)\b", 3.0),
    Rule("pharmacokinetics", "pattern", rf"\b({Q.FEATURE_TERMS['has_pharmacokinetic_terms']})\b", 2.5),
    Rule("monitoring_guidance", "pattern", rf"\b({Q.FEATURE_TERMS['has_monitoring_terms']})\b", 2.5),
    Rule("regulatory_compliance", "pattern", rf"\b({Q.FEATURE_TERMS['has_regulatory_terms']})\b", 2.5),
    *[Rule("safety_concerns", "keyword", w, x) for w, x in (("safe", 1.0), ("unsafe", 1.5), ("danger", 1.5), ("caution", 1.0), ("warning", 1.0), ("risk", 1.0), ("adverse", 2.0), ("toxicity", 2.0))],
    *[Rule("dosing_inquiry", "keyword", w, x) for w, x in (("how much", 2.0), ("how many", 1.5), ("amount", 1.0), ("quantity", 1.0), ("take", 1.0), ("give", 1.0), ("administer", 1.5))],
    *[Rule("drug_information", "keyword", w, x) for w, x in (("what is", 1.5), ("information about", 1.5), ("tell me about", 1.5), ("uses", 1.0), ("purpose", 1.0), ("indication", 1.5))],
    *[Rule("condition_treatment", "keyword", w, x) for w, x in (("treat", 2.0), ("treatment", 2.0), ("therapy", 1.5), ("cure", 1.5), ("manage", 1.0), ("control", 1.0))],
    Rule("safety_concerns", "feature", "has_safety_terms", 3.0),
    Rule("safety_concerns", "feature", "safety_term_count > 1", 1.0),
    Rule("safety_concerns", "feature", "has_cardiac_terms OR has_hepatic_terms OR has_renal_terms", 1.5),
    Rule("dosing_inquiry", "feature", "has_dosage_terms", 3.0),
    Rule("dosing_inquiry", "feature", "has_age_terms", 1.0),
    Rule("drug_information", "feature", "has_drug_names", 2.0),
    Rule("drug_information", "feature", "starts_with_wh", 1.0),
    Rule("pediatric_concerns", "feature", "age_term_count > 0", 1.0),
    Rule("monitoring_guidance", "feature", "has_monitoring_terms", 2.5),
    Rule("monitoring_guidance", "feature", "has_cardiac_terms OR has_hepatic_terms OR has_renal_terms", 1.0),
    Rule("safety_concerns", "context", "has_safety_terms AND has_age_terms", 1.5),
    Rule("pediatric_concerns", "context", "has_dosage_terms AND has_age_terms", 2.0),
    Rule("safety_concerns", "context", "has_cardiac_terms AND has_safety_terms", 2.0),
    Rule("safety_concerns", "context", "has_hepatic_terms AND has_safety_terms", 2.0),
    Rule("safety_concerns", "context", "has_renal_terms AND has_safety_terms", 2.0),
)
#: What is said of an intent where a condition holds.
REASONS = (
    ("safety_concerns", "has_safety_terms", "contains safety-related keywords"), ("safety_concerns", "safety_term_count > 1", "multiple safety terms detected"), ("safety_concerns", "has_cardiac_terms", "cardiac safety concerns"),
    ("dosing_inquiry", "has_dosage_terms", "contains dosage-related terms"), ("dosing_inquiry", "has_age_terms", "age-specific dosing query"),
    ("pediatric_concerns", "has_age_terms", "pediatric/age-related terms"), ("pediatric_concerns", "age_term_count > 0", "multiple age references"),
    ("monitoring_guidance", "has_monitoring_terms", "monitoring/testing terms"), ("monitoring_guidance", "has_cardiac_terms", "cardiac monitoring context"),
)
NO_REASON = "pattern matching and feature analysis"
#: Hits to fetch for an intent, whether its query is expanded, and the sections that come first.
STRATEGIES = (
    ("safety_concerns", 15, True, "warning,adverse,contraindication,safety"), ("dosing_inquiry", 8, False, "dosage,administration,pediatric"), ("pediatric_concerns", 12, True, "pediatric,8.4,children,infant"),
    ("monitoring_guidance", 10, True, "monitoring,laboratory,tests,ecg"), ("contraindication", 8, True, "contraindication,warning,precaution"),
)


def classified(queries: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, intents: Sequence[str] = INTENTS, reasons: Sequence[tuple[str, str, str]] = REASONS) -> DataFrame:
    """Adds intent, score, confidence, alternatives (array of intent and score: the next two), reasoning and n_rules to queries.

    An intent's score is the sum of its rules' weights that hold; the highest wins, of equal ones the first of `intents`. Confidence is its
    share of the best three scores, .5 where no rule holds. n_rules: how many rules hold. A null query is taken as an empty
    one. The rules are a parameter and become one expression: nothing is joined or shuffled.
    """
    names = [f"_{c}" for c in queries.columns]
    rows = queries.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(queries.columns, names)], F.lower(F.trim(F.coalesce(F.col(f"`{text}`"), F.lit("")))).alias("_query"))
    rows = rows.withColumn("_f", Q.features(F.col("_query"))).select("*", "_f.*")

    def holds(rule: Rule) -> Column:
        if rule.kind == "pattern":
            return F.col("_query").rlike(f"(?U){rule.condition}")
        return F.contains("_query", F.lit(rule.condition)) if rule.kind == "keyword" else F.expr(rule.condition)

    rows = rows.withColumn("_held", F.array(*[F.when(holds(r), F.lit(float(r.weight))).otherwise(0.0) for r in rules]))
    at = {i: [n for n, r in enumerate(rules) if r.intent == i] for i in intents}
    score = lambda i: sum((F.col("_held")[n] for n in at[i]), F.lit(0.0))
    ranked = F.array_sort(F.array(*[F.struct((-score(i)).alias("minus"), F.lit(n).alias("ord"), F.lit(i).alias("intent")) for n, i in enumerate(intents)]))
    rows = rows.withColumn("_ranked", F.slice(ranked, 1, 3)).withColumn("_top", F.col("_ranked")[0]).withColumn("score", 0.0 - F.col("_top.minus"))
    three = -F.aggregate("_ranked", F.lit(0.0), lambda s, x: s + x["minus"])
    said = F.array_compact(F.array(*[F.when((F.col("_top.intent") == i) & F.expr(c), F.lit(words)) for i, c, words in reasons]))
    why = F.when(F.size(said) > 0, F.array_join(said, "; ")).otherwise(F.lit(NO_REASON))
    return rows.select(
        *[F.col(n).alias(c) for c, n in zip(queries.columns, names)], F.col("_top.intent").alias("intent"), "score", F.when(three > 0, F.least(F.lit(1.0), F.col("score") / three)).otherwise(0.5).alias("confidence"),
        F.transform(F.slice("_ranked", 2, 2), lambda x: F.struct(x["intent"].alias("intent"), (0.0 - x["minus"]).alias("score"))).alias("alternatives"),
        F.concat(F.lit("Classified as "), F.replace(F.col("_top.intent"), F.lit("_"), F.lit(" ")), F.lit(" because: "), why).alias("reasoning"), F.size(F.filter("_held", lambda x: x > 0)).alias("n_rules"),
    )
