"""Confidence in credentials, from their form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievetext.functions.regexes import let

#: Fixed bounds of the confidence.
LEAST, MOST, JWT_INVALID, JWT_PARTS, JWT_MOST = 0.1, 0.95, 0.4, 0.2, 0.99


def token_confidence(token: Column, least: int = 16) -> Column:
    """0.7, more for length and variety of characters, less for shortness and repetition."""
    size = F.length(token)
    kinds = sum((token.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", r"[_\-+/=]")), F.lit(0))
    score = 0.7 + F.when(size >= 20, 0.15).when(size < least, -0.1).otherwise(0.0) + F.when(kinds >= 3, 0.1).otherwise(0.0) - F.when(token.rlike(r"(.{3,})\1"), 0.2).otherwise(0.0)
    return F.greatest(F.lit(LEAST), F.least(F.lit(MOST), score))


def jwt_confidence(token: Column) -> Column:
    """(valid, confidence): three long enough parts of URL-safe characters."""

    def judged(parts: Column) -> Column:
        long_ = (F.length(parts[0]) >= 10) & (F.length(parts[1]) >= 10) & (F.length(parts[2]) >= 8)
        safe = F.forall(parts, lambda p: p.rlike("^[A-Za-z0-9_-]+$"))
        score = 0.8 + F.when(parts[0].startswith("eyJ"), 0.15).otherwise(0.0) + F.when(F.length(token).between(100, 2000), 0.05).otherwise(0.0)
        of = lambda valid, value: F.struct(F.lit(valid).alias("valid"), value.alias("confidence"))
        return F.when(F.size(parts) != 3, of(False, F.lit(JWT_PARTS))).when(~long_ | ~safe, of(False, F.lit(JWT_INVALID))).otherwise(of(True, F.least(F.lit(JWT_MOST), score)))

    return let(F.split(token, r"\."), judged)
