"""Confidence of an edge: an ordered scale that combines along a path by its weakest member."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The scale, strongest first.
CONFIRMED, PARSED, INFERRED, UNRESOLVED = "confirmed", "parsed", "inferred", "unresolved"
RANKS = {CONFIRMED: 3, PARSED: 2, INFERRED: 1, UNRESOLVED: 0}
NAMES = {rank: name for name, rank in RANKS.items()}


def rank_of(confidence: Column | str) -> Column:
    name = F.col(confidence) if isinstance(confidence, str) else confidence
    found = F.lit(0)
    for known, rank in RANKS.items():
        found = F.when(name == known, rank).otherwise(found)
    return found


def name_of(rank: Column | str) -> Column:
    value = F.col(rank) if isinstance(rank, str) else rank
    return F.element_at(F.array(*[F.lit(NAMES[r]) for r in range(4)]), (value + 1).cast("int"))


def weaker(a: Column, b: Column) -> Column:
    """The lower of two confidences by name."""
    return name_of(F.least(rank_of(a), rank_of(b)))


def effort_bucket(depth: Column, complex_programs: Column, overrides: Column, unresolved: Column) -> Column:
    """How much it takes to replace an output, from the shape of its lineage."""
    return (
        F.when((unresolved > 0) | (complex_programs > 1), "full_reengineering")
        .when((complex_programs == 1) | (overrides > 0) | (depth > 3), "moderate")
        .otherwise("replicate_as_view")
    )
