"""What a column is: its place in a dataset and how its type is treated."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

Datasets = Mapping[str, DataFrame]

NUMERIC = ("integer", "real")


@dataclass(frozen=True)
class Field:
    """One column of one dataset. ``id`` is unique over all datasets at hand."""

    id: int
    dataset: str
    position: int
    name: str
    dtype: str
    kind: str
    width: int | None  # bytes per value for fixed-width types

    @property
    def col(self) -> Column:
        return column(self.name)

    @property
    def sql(self) -> str:
        return quoted(self.name)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def column(name: str) -> Column:
    """Column by its plain name, even when the name holds dots or backticks."""
    return F.col(quoted(name))


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "real"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "instant"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    return "other"


# Bytes one value takes, for types whose values all take the same room.
FIXED_WIDTHS = {
    T.BooleanType: 1,
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.DateType: 4,
    T.FloatType: 4,
    T.LongType: 8,
    T.DoubleType: 8,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
    T.DecimalType: 16,
}


def fields_of(datasets: Datasets) -> list[Field]:
    found: list[Field] = []
    for dataset, df in datasets.items():
        for position, field in enumerate(df.schema.fields):
            found.append(
                Field(
                    id=len(found),
                    dataset=dataset,
                    position=position,
                    name=field.name,
                    dtype=field.dataType.simpleString(),
                    kind=kind_of(field.dataType),
                    width=FIXED_WIDTHS.get(type(field.dataType)),
                )
            )
    return found


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere, so it is made NULL on entry."""
    shown = []
    for field in df.schema.fields:
        name = quoted(field.name)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            shown.append(f"CASE WHEN NOT isnan({name}) THEN {name} END AS {name}")
        else:
            shown.append(name)
    return df.selectExpr(*shown)


def clean(datasets: Datasets) -> dict[str, DataFrame]:
    return {name: nan_to_null(df) for name, df in datasets.items()}


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    """Union of tables with equal columns, joined in pairs to keep plans shallow."""
    parts = list(parts)
    while len(parts) > 1:
        pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
        parts = [p[0].union(p[1]) if len(p) == 2 else p[0] for p in pairs]
    return parts[0]


def small_table(df: DataFrame) -> DataFrame:
    """Compute a table that has a row per column, requirement or model, once.

    Only for tables whose size is set by the schema or the catalogue, never by
    the number of data rows.
    """
    return df.sparkSession.createDataFrame(df.toArrow())


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table from the driver, known to the optimizer as it is."""
    fields = T.StructType.fromDDL(schema).fields
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    arrow = pa.table(
        [pa.array(c, type=ARROW_TYPES[f.dataType.simpleString()]) for c, f in zip(columns, fields)],
        names=[f.name for f in fields],
    )
    return spark.createDataFrame(arrow)


ARROW_TYPES = {
    "int": pa.int32(),
    "bigint": pa.int64(),
    "double": pa.float64(),
    "string": pa.string(),
    "array<string>": pa.list_(pa.string()),
}
