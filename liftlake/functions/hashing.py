"""Row fingerprints for change detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field separator and null marker inside the fingerprint text.
FIELD_SEP = "\u001f"
NULL_TOKEN = "\u001e"


def row_hash(cols: list[str]) -> Column:
    """md5 over the columns in the given order, with a separator between
    fields and a distinct null marker, so ("1","10") and ("11","0") differ and
    a null never equals an empty string."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(NULL_TOKEN)) for c in cols]
    return F.md5(F.concat_ws(FIELD_SEP, *parts))
