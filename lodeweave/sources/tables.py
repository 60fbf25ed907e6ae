"""Relational tables as triples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.matching import term

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _path(table: str, column: str, value) -> "F.Column":
    return F.concat(F.url_encode(F.lit(table)), F.lit("/"), F.url_encode(F.lit(column)), F.lit("/"), F.url_encode(value.cast("string")))


def table_triples(df: DataFrame, name: str, key: Sequence[str], foreign: Mapping[str, tuple[str, str]] = {}, columns: Sequence[str] | None = None) -> DataFrame:
    """(``s``, ``p``, ``o``): the key makes the subject ``table/column/value``, a foreign key an object of that form, other columns typed
    literals; the predicate is the column's name. Rows with a null key, and null values, give nothing. A key of several
    columns is joined by ``;``."""
    types = dict(df.dtypes)
    subject = _path(name, ";".join(key), F.concat_ws(";", *[F.col(c).cast("string") for c in key]))
    cells = []
    for c in columns or [x for x in df.columns if x not in key]:
        v = F.col(c)
        if c in foreign:
            o = term("uri", _path(*foreign[c], v))
        elif types[c] == "boolean":
            o = term("boolean", v.cast("string"))
        elif types[c].split("(")[0] in _NUMERIC:
            o = term("number", v.cast("string"), v.cast("double"))
        else:
            o = term("text", v.cast("string"))
        cells.append(F.when(v.isNotNull(), F.struct(F.url_encode(F.lit(c)).alias("p"), o.alias("o"))))
    have = [F.col(c).isNotNull() for c in key]
    rows = df.where(have[0] if len(have) == 1 else have[0] & F.array_min(F.array(*have)))
    return rows.select(subject.alias("s"), F.explode(F.array(*cells)).alias("x")).where("x is not null").select("s", "x.p", "x.o")
