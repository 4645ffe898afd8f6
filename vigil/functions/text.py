"""Column functions for identifiers, names and time texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """Without any kind of white space at either end (``trim`` removes only blanks)."""
    return F.regexp_replace(text, BLANK, "")


def canonical_id(identifier: Column) -> Column:
    """Stripped, lower case, hyphens as underscores; null for a blank id."""
    bare = F.translate(F.lower(strip(identifier)), "-", "_")
    return F.when(bare != "", bare)


def instant(text: Column) -> Column:
    """A UTC timestamp of an ISO-8601 text; a text without zone is UTC, anything unreadable is null."""
    bare = strip(text)
    zoned = bare.rlike(r"(?i)(Z|[+-]\d\d:?\d\d)$")
    return F.try_to_timestamp(F.when(zoned, bare).otherwise(F.concat(bare, F.lit("+00:00"))))


def split_name(text: Column) -> Column:
    """train, val or test (or any other name, in lower case); null for null and blank."""
    bare = F.lower(strip(text))
    return F.when(bare.isin("valid", "validation"), "val").when(bare != "", bare)
