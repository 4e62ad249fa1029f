"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

WORD = r"[^\x20\x09-\x0D]+"
LOWER_AZ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def word_count(text: str | Column) -> Column:
    """Words of the text, NULL has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def add_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """`df` with further columns; columns of `df` that bear such a name (in any case) are replaced."""
    names = {name.lower() for name in new}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*kept, *[column.alias(name) for name, column in new.items()])


def per_batch(ddl: str, compute: Callable[[list[bytes]], list[tuple]]) -> Callable[[Column], Column]:
    """A struct column computed from whole texts as UTF-8 bytes, one Arrow batch at a time; NULL counts as empty.

    It is declared nondeterministic, though it is not, so that a filter on one of its fields does not compute it twice.
    """
    fields = ddl_fields(ddl)

    @arrow_udf(ddl)
    def run(texts: pa.Array) -> pa.Array:
        found = compute([t or b"" for t in texts.to_pylist()])
        columns = list(zip(*found)) or [()] * len(fields)
        return pa.StructArray.from_arrays([pa.array(c, type=kind) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])

    once = run.asNondeterministic()
    return lambda text: once(text.cast("binary"))


def per_text(ddl: str, compute: Callable[[bytes], tuple]) -> Callable[[Column], Column]:
    """`per_batch` for work that looks at one text at a time."""
    return per_batch(ddl, lambda texts: [compute(t) for t in texts])


def ddl_fields(ddl: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    pairs = [part.strip().split(":") for part in ddl.removeprefix("struct<").removesuffix(">").split(",")]
    return [(name.strip(), kinds[kind.strip()]) for name, kind in pairs]


def replaced(df: DataFrame, struct: Column, fields: list[str]) -> DataFrame:
    """`df` with the fields of one struct column as columns, computed once."""
    names = {name.lower() for name in fields}
    kept = [c for c in df.columns if c.lower() not in names]
    return df.select(*[F.col(f"`{c}`") for c in kept], struct.alias("__found")).select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"__found.{f}").alias(f) for f in fields])
