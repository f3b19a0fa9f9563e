"""Questions and reasoning labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide whether a question gives or asks for something.
GIVEN_PERCENTAGE = r"(?i)\d+(\.\d+)?\s*(%|percent\b)"
RATIO = r"(?i)\brates?\b|\bratios?\b|\bdensity\b|proportion|percentage|per capita|\bper\b"
DIFFERENCE = r"(?i)difference between|how (?:many|much) (?:more|less|older|younger|taller|higher|longer|heavier)"
DISPLACED = r"(?i)\bat the time of\b|\byears? (?:ago|later|earlier)\b|\bin the year \d{4}\b"
CURRENT = r"(?i)current|\bnow\b|today|present"
NOW_LITERAL = r"""(?i)["']now["']"""

# The parts of a reasoning label and what they stand for.
REASONING = {"+": "addition", "-": "subtraction", "*": "multiplication", "/": "division", "C": "commonsense", "H": "hypothetical"}


def coarse_reasoning(label: Column) -> Column:
    """A, with +C and +H if the label has these letters; null and empty labels are unknown."""
    coarse = F.concat(F.lit("A"), F.when(label.contains("C"), "+C").otherwise(""), F.when(label.contains("H"), "+H").otherwise(""))
    return F.when(label.isNull() | (label == ""), "unknown").otherwise(coarse)


def describe_reasoning(label: Column) -> Column:
    """The known parts of a label in words, in order: "a", "a, and b", "a, b, and c"; unknown parts are left out, nothing gives ''."""
    named = F.create_map(*[F.lit(x) for pair in REASONING.items() for x in pair])
    parts = F.filter(F.transform(F.split(F.coalesce(label, F.lit("")), r"\s+"), lambda x: F.try_element_at(named, x)), lambda x: x.isNotNull())
    n = F.size(parts)
    many = F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.try_element_at(parts, F.lit(-1)))
    return F.when(n < 2, F.array_join(parts, "")).otherwise(many)


def says(question: Column, pattern: str) -> Column:
    """Whether the question holds the pattern; null questions hold nothing."""
    return F.coalesce(F.rlike(question, F.lit(pattern)), F.lit(False))


def python_round(x: Column, digits: int) -> Column:
    """Rounding of the exact binary value with ties to even, as float comparison needs it; never -0.0."""
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * digits)).cast("double") + F.lit(0.0)
