"""Column codecs: how a value is stored, and how it is read back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Codec:
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]


def _absolute(x: Column) -> Column:
    """With forward slashes; a path that is not absolute is an error."""
    path = F.translate(x, "\\", "/")
    fine = path.startswith("/") | path.rlike("^[A-Za-z]:/")
    return F.when(x.isNull() | fine, path).otherwise(F.raise_error(F.concat(F.lit("not an absolute path: "), x)))


def _platform(x: Column) -> Column:
    """Paths of drives and of network shares with backslashes."""
    return F.when(x.rlike("^[A-Za-z]:/") | x.startswith("//"), F.translate(x, "/", "\\")).otherwise(x)


absolute = Codec(_absolute, _platform)
#: The same for columns that may hold an empty text.
directory = Codec(lambda x: F.when(x == "", x).otherwise(_absolute(F.nullif(x, F.lit("")))), _platform)
CODECS = {"absolute": absolute, "directory": directory}


def encoded(rows: DataFrame, codecs: dict[str, str]) -> DataFrame:
    """``rows`` as they are stored; ``codecs`` names the codec of each column."""
    return rows.withColumns({c: CODECS[name].encode(F.col(c)) for c, name in codecs.items()})


def decoded(rows: DataFrame, codecs: dict[str, str]) -> DataFrame:
    return rows.withColumns({c: CODECS[name].decode(F.col(c)) for c, name in codecs.items()})
