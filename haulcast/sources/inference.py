"""Types of CSV columns, found in the data.

Every column is read as text and one aggregate counts, for each type, the cells that
refuse it. A column takes the narrowest type that no cell refuses, along two
chains that both end in text: boolean; bigint, double; date, timestamp. A column
without a cell stays text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcast.functions.numbers import PLAIN_NUMBER, quoted
from haulcast.sources.files import CSV, READ_EMPTY

DAY = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
TIME = "[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?"


@dataclass(frozen=True)
class Kind:
    """A type, the form of its cells, and how a cell is read."""

    name: str
    pattern: str

    def read(self, cell: Column) -> Column:
        """The value, null where the cell is none of this type."""
        return F.when(cell.rlike(self.pattern), cell.try_cast(self.name))


#: Narrow before wide. A whole number of more than 18 digits is a double.
KINDS = (
    Kind("boolean", "^(?i:true|false)$"),
    Kind("bigint", "^[+-]?[0-9]{1,18}$"),
    Kind("double", PLAIN_NUMBER),
    Kind("date", f"^{DAY}$"),
    Kind("timestamp_ntz", f"^{DAY}([ T]{TIME})?$"),
)
REPORT = "column_name string, n_cells bigint, n_empty bigint, " + "".join(f"not_{k.name} bigint, " for k in KINDS) + "chosen string"


def read_text_columns(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """All columns as text under the names of the header. Without ``line_breaks`` in cells, files are split over tasks."""
    options = {**CSV, **READ_EMPTY, "multiLine": str(line_breaks).lower(), "inferSchema": "false"}
    return spark.read.options(**options).csv(path)


def column_types(text: DataFrame) -> DataFrame:
    """One row per column: cells, empty ones, cells that refuse each type, and the type it takes."""
    spark = text.sparkSession
    counts = []
    for i, name in enumerate(text.columns):
        cell = F.col(quoted(name))
        counts.append(F.count(cell).alias(f"{i}_cells"))
        counts.append(F.count_if(cell.isNull()).alias(f"{i}_empty"))
        counts += [F.count_if(cell.isNotNull() & k.read(cell).isNull()).alias(f"{i}_not_{k.name}") for k in KINDS]
    # One row, a few numbers per column: the schema is decided on the driver in any case.
    found = text.agg(*counts).first() if counts else None
    rows = []
    for i, name in enumerate(text.columns):
        refused = [found[f"{i}_not_{k.name}"] for k in KINDS]
        fits = [k.name for k, n in zip(KINDS, refused) if n == 0]
        chosen = fits[0] if fits and found[f"{i}_cells"] else "string"
        rows.append((name, found[f"{i}_cells"], found[f"{i}_empty"], *refused, chosen))
    return spark.createDataFrame(rows, REPORT)


def read_csv_inferred(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """The table with every column in the type that its cells ask for."""
    text = read_text_columns(spark, path, line_breaks)
    chosen = {r.column_name: r.chosen for r in column_types(text).collect()}  # one row per column
    kinds = {k.name: k for k in KINDS}
    cells = [(c, F.col(quoted(c)), kinds.get(chosen[c])) for c in text.columns]
    return text.select(*[(kind.read(cell) if kind else cell).alias(c) for c, cell, kind in cells])
