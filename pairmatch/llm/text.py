"""Text helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The six characters that separate words: space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Byte tables for bytes.translate: A-Z to a-z; the second also makes every ASCII byte that is
#: neither a letter nor a digit a space.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER_ALNUM = bytes(
    LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def text_of(text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words, as long."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column of an Arrow batch, null as empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def mix(x: np.ndarray) -> np.ndarray:
    """Mix the bits of unsigned 64-bit numbers (a published finaliser, one to one)."""
    x = x.astype(np.uint64, copy=True)
    # fixed values: shifts and multipliers of the splitmix64 finaliser
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def one_of_each(df: DataFrame, *same: str) -> DataFrame:
    """One row for each combination of ``same``; partial aggregation thins out repeats first.

    Unlike ``dropDuplicates`` it treats the other columns as one row: all come from one row.
    """
    rest = [c for c in df.columns if c not in same]
    picked = df.groupBy(*same).agg(F.min(F.struct(*rest)).alias("_row"))
    return picked.select(*same, *(F.col("_row")[c].alias(c) for c in rest))


def before(partition: list[str], *order: Column | str):
    """A window over the rows before the current one."""
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
