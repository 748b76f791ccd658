"""String helpers as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: characters that are escaped, and what stands for them after the backslash
ESCAPES = {"\\": "\\", "\n": "n", "\r": "r", "\t": "t", ",": "c", ";": "s", ":": "o", "|": "p", "=": "e", " ": "_", "(": "l", ")": "g", "[": "a", "]": "b", '"': "q"}


def trim_white(s: Column) -> Column:
    """Without spaces, line feeds, carriage returns and tabs at either end."""
    return F.btrim(s, F.lit(" \n\r\t"))


def shorten(s: Column, n: int) -> Column:
    """At most ``n`` characters, of which the last three are dots where something was cut."""
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, max(0, n - 3)), F.lit("..."))).otherwise(s)


def join(parts: Column, separator: str = " ") -> Column:
    return F.array_join(parts.cast("array<string>"), separator)


def split(s: Column, separator: str) -> Column:
    """All parts, empty ones included."""
    return F.split(s, re.escape(separator), -1)


def split_first(s: Column, separators: str) -> Column:
    """A struct (before, separator, after) at the first character of ``separators``; without one,
    the whole string and nulls."""
    pattern = f"(?s)^([^{re.escape(separators)}]*)([{re.escape(separators)}])(.*)$"
    cut = F.regexp_extract(s, pattern, 2)
    return F.struct(
        F.when(cut != "", F.regexp_extract(s, pattern, 1)).otherwise(s).alias("before"),
        F.when(cut != "", cut).alias("separator"),
        F.when(cut != "", F.regexp_extract(s, pattern, 3)).alias("after"),
    )


def parse_int(s: Column, default: Column | None = None) -> Column:
    """A 32-bit integer written in decimal, octal (0...) or hexadecimal (0x...), else the default."""
    bare = F.regexp_replace(trim_white(s), "^[+-]", "")
    sign = F.when(trim_white(s).startswith("-"), -1).otherwise(1)
    base = F.when(bare.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(bare, 3, 15), 16, 10)).when(bare.rlike("^0[0-7]{1,20}$"), F.conv(bare, 8, 10)).when(bare.rlike("^(0|[1-9][0-9]{0,17})$"), bare)
    number = (base.try_cast("long") * sign).try_cast("int")
    return number if default is None else F.coalesce(number, default)


def parse_double(s: Column) -> Column:
    return trim_white(s).try_cast("double")


def escape(s: Column) -> Column:
    """Separators as two characters, so that escaped strings can be joined and split again."""
    for c, e in ESCAPES.items():  # the backslash comes first
        s = F.replace(s, F.lit(c), F.lit("\\" + e))
    return s


def unescape(s: Column) -> Column:
    """The inverse of :func:`escape`: pairs are read from the left, by a fold over split parts."""
    parts = F.split(s, r"\\\\", -1)  # an escaped backslash can't be part of another pair

    def plain(x: Column) -> Column:
        for c, e in ESCAPES.items():
            if c != "\\":
                x = F.replace(x, F.lit("\\" + e), F.lit(c))
        return x

    return F.array_join(F.transform(parts, plain), "\\")
