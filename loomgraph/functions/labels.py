"""Normal form of node and edge type labels, evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: white space of the normal form, and the characters it removes
WHITE_SPACE = " \t\r\n\f\x0b"
REMOVED = "​﻿"


def nfkc(c: Column) -> Column:
    """Unicode NFKC of a string column; null stays null. Pure ASCII is returned as it is."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    return F.when(c.rlike("[^\\x00-\\x7F]"), composed).otherwise(c)


def normal_form(c: Column) -> Column:
    """NFKC, without zero-width marks, lower case, trimmed, runs of white space, hyphens and underscores as one underscore.

    A null label and one whose normal form is empty are absent: both give null.
    """
    plain = F.lower(F.translate(nfkc(c), REMOVED, ""))
    joined = F.regexp_replace(F.trim(plain, F.lit(WHITE_SPACE)), "[ \\t\\r\\n\\f\\x0B_-]+", "_")
    # most labels are in normal form already; one match spares them the rest
    return F.when(c.rlike("^[a-z0-9]+(?:_[a-z0-9]+)*\\z"), c).otherwise(F.nullif(joined, F.lit("")))


def normal_form_sql(c: str) -> str:
    """The same in DuckDB SQL; compatibility forms are folded for full-width ASCII and for the wide spaces only."""
    wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "　  "
    flat = "".join(chr(x) for x in range(0x21, 0x7F)).replace("'", "''") + "   "
    cleaned = f"lower(replace(replace(translate({c}, '{wide}', '{flat}'), chr(8203), ''), chr(65279), ''))"
    white = "' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11)"
    return f"nullif(regexp_replace(trim({cleaned}, {white}), '[ \\t\\r\\n\\f\\v_-]+', '_', 'g'), '')"
