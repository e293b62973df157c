"""Confidence of claims and how claims that agree add up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimforge.functions.normalize import lookup

# Trust in kinds of source, reliability of methods, order of precedence, thresholds.
TRUST = {"ats": 0.90, "github": 0.70, "resume_section": 0.75, "resume_prose": 0.55, "notes": 0.40}
RELIABILITY = {"direct_map": 1.0, "structured_parse": 0.8, "regex_prose": 0.6, "ner": 0.75}
PRIORITY = {"ats": 0, "github": 1, "resume_section": 2, "resume_prose": 3, "notes": 4}
GATE = 0.5
CAP = 0.99
PENALTY = 0.1
HIGH_TRUST = 0.7


def trust_key(source: Column, method: Column) -> Column:
    """Résumé claims are trusted by how they were found, others by their source."""
    return F.when(source.isin("ats", "github", "notes"), source).when(method == "structured_parse", F.lit("resume_section")).otherwise(F.lit("resume_prose"))


def claim_confidence(source: Column, method: Column) -> Column:
    return lookup(TRUST, trust_key(source, method)) * lookup(RELIABILITY, method)


def source_priority(source: Column, method: Column) -> Column:
    return lookup(PRIORITY, trust_key(source, method))


def noisy_or(confidences: Column) -> Column:
    """``min(cap, 1 - prod(1 - c))`` of an array, multiplied in its order."""
    return F.least(F.lit(CAP), 1.0 - F.aggregate(confidences, F.lit(1.0), lambda product, c: product * (1.0 - c)))


def mean(values: Column) -> Column:
    """Mean of an array added in its order; 0 when empty."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)).otherwise(F.lit(0.0))
