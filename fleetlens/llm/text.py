"""Text expressions that several operators share; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The word separators of the near-duplicate contract: space, tab, LF, VT, FF, CR.
SEPARATORS = r"[\x20\x09-\x0D]+"


def text_of(column: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast built-in; other text goes by ``translate``."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words_of(text: Column) -> Column:
    """The words of the near-duplicate contract, in order."""
    return F.array_remove(F.split(text, SEPARATORS), "")
