"""Questions and statements: what is asked, and which figures a text states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Intents and their patterns, in the order in which they are tried.
INTENTS = (
    ("irrigation", r"irrigat|water(?:ing)?\s+(?:my|the|our)\s+(?:crop|maize|beans|kale|tomato|potato|coffee|napier|farm|field|plants?|garden|shamba)|mwagili|umwagiliaji"),
    ("spray", r"spray|pesticide|herbicide|fungicide|nyunyiz|dawa\s+ya\s+(?:wadudu|kuua)"),
    ("rain", r"\brain|\bshowers?\b|mvua"),
    ("reliability", r"reliab|accura|trust|confiden|uncertain|data\s+quality|\bsensors?\b|how\s+sure|kuaminik|uhakika|ubora\s+wa\s+data|sensa|kifaa|makosa"),
    (
        "best_time",
        r"best\s+time|when\s+(?:should|can|is|to)|what\s+time|recommended\s+(?:time|window)|\bwindow\b|timing|wakati\s+(?:gani|mzuri|bora|unaopendekezwa)|saa\s+ngapi|\blini\b|dirisha|muda\s+(?:gani|mzuri)",
    ),
    ("farm", r"plant(?:ing)?\b|\bcrops?\b|maize|beans|harvest|\bfarm|shamba|mazao|kupanda|mahindi|maharagwe|kuvuna"),
    ("heat", r"heat|\bhot\b|exposure|temperat|wbgt|warm|outdoor\s+work|outside|joto|kupatwa|\bjua\b|kazi\s+za\s+nje"),
)
#: Fixed value: what no answer may speak of.
MEDICAL = r"\b(?:diagnos(?:e|es|ed|is|ing)|malaria|cholera|asthma attack|hospitals?|hospitali|kipindupindu)\b"
NUMBER = r"\d+(?:\.\d+)?"


def intent(question: Column) -> Column:
    """The first intent whose pattern is found; ``overview`` where none is, or nothing is asked."""
    chain = F.when(question.isNull(), "overview")
    for name, pattern in INTENTS:
        chain = chain.when(question.rlike("(?i)" + pattern), name)
    return chain.otherwise("overview")


def is_medical(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + MEDICAL), F.lit(False))


def numbers(text: Column) -> Column:
    """The figures of a text as strings, in order; clock times are left out."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\b\d{1,2}:\d{2}\b", " ")
    return F.regexp_extract_all(plain, F.lit(f"({NUMBER})"), 1)


def grounded(number: Column, facts: Column) -> Column:
    """Whether some fact, rounded as the number is written, gives it; signs are left out."""
    decimals = F.length(F.regexp_extract(number, r"\.(\d+)", 1))
    slack = 0.5 * F.pow(F.lit(10.0), -decimals.cast("double")) + 1e-9
    return F.exists(facts, lambda f: F.abs(number.cast("double") - F.abs(f)) <= slack)


def fill(template: Column, **values: Column) -> Column:
    """``{name}`` replaced by its value."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def escape_html(text: Column) -> Column:
    for char, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(reference))
    return text
