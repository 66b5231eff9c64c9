"""Row filters, fallback scan, canonical names and default rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcast.functions import dates
from haulcast.functions.numbers import quoted


#: The column by which a stored history is laid out in folders.
DAY = "ship_date"


@dataclass(frozen=True)
class SourceFilter:
    """Which shipments a run counts: equal values, or texts that a domain contains. Unset fields filter nothing."""

    principal: str | None = None
    perspective: str | None = None
    domain: str | None = None
    domain_contains: str | None = None
    location_domain_contains: str | None = None

    def shipments(self, df: DataFrame) -> DataFrame:
        equal = {"principal": self.principal, "perspective": self.perspective, "domain_name": self.domain}
        for column, value in equal.items():
            if value is not None:
                df = df.where(F.col(column) == F.lit(value))
        return df if self.domain_contains is None else contains(df, "domain_name", self.domain_contains)

    def locations(self, df: DataFrame) -> DataFrame:
        text = self.location_domain_contains
        return df if text is None else contains(df, "domain_name", text)


def in_segments(df: DataFrame, segments: Iterable[str], column: str = "segment") -> DataFrame:
    """Union of segments as one predicate, so the scan is read once."""
    return df.where(F.col(quoted(column)).isin(list(segments)))


def contains(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.where(F.col(quoted(column)).contains(text))


def trailing_months(
    df: DataFrame, column: str, months: int, as_of: datetime | date | None = None, closed: bool = True
) -> DataFrame:
    """Rows of the last ``months`` months; ``closed`` also bounds them by ``as_of``.

    Both bounds fold to literals, so they reach the reader as pushed filters.
    A history laid out by ``ship_date`` gets the same bounds on the day, which
    leave all other day folders unread.
    """
    moment = dates.as_of_timestamp(as_of)
    first = dates.months_before(moment, months)
    kept = F.col(quoted(column)) >= first
    if closed:
        kept = kept & (F.col(quoted(column)) <= moment)
    if DAY in df.columns and column != DAY:
        kept = kept & (F.col(DAY) >= F.to_date(first))
        if closed:
            kept = kept & (F.col(DAY) <= F.to_date(moment))
    return df.where(kept)


def current_or_all(df: DataFrame, column: str, as_of: date | None = None) -> DataFrame:
    """Rows dated ``as_of`` or later; the whole table when there are none.

    One plan without a driver-side branch. The probe stops at the first hit
    in each partition instead of counting.
    """
    current = F.col(quoted(column)) >= dates.as_of_date(as_of)
    probe = df.where(current).select(F.lit(1).alias("hit")).limit(1)
    return df.where(current | probe.scalar().isNull())


def allowed_entities(df: DataFrame, entities: DataFrame, column: str = "entity") -> DataFrame:
    """Keep the entities of a one-column table; repeated names do not multiply rows."""
    names = entities.select(F.col(quoted(entities.columns[0])).alias(column)).distinct()
    return df.join(names, column, "left_semi")


def uncovered(df: DataFrame, listed: Iterable[str], column: str = "entity") -> DataFrame:
    """Row count per value that an explicit list leaves out, so nothing goes missing unseen."""
    key = F.col(quoted(column))
    return df.where(key.isNotNull() & ~key.isin(list(listed))).groupBy(key).agg(F.count("*").alias("n_rows"))


def names(df: DataFrame, column: str) -> list[str]:
    """Distinct names on the driver, for the columns of a wide table. Long results need none."""
    key = F.col(quoted(column))
    return sorted(row[0] for row in df.where(key.isNotNull()).select(key).distinct().collect())


def canonical(value: Column, synonyms: Mapping[str, str]) -> Column:
    """Replace listed spelling variants; other names, and NULL, pass through."""
    out = value
    for variant, name in synonyms.items():
        out = F.when(value == F.lit(variant), F.lit(name)).otherwise(out)
    return out


def canonicalise(df: DataFrame, synonyms: DataFrame, column: str) -> DataFrame:
    """Same, from a (variant, name) table; a variant may be repeated, but not with two names."""
    several = F.raise_error(F.concat(F.lit("two names for "), F.col("variant"))).cast("string")
    name = F.when(F.min("name").eqNullSafe(F.max("name")), F.min("name")).otherwise(several)
    pairs = synonyms.groupBy("variant").agg(name.alias("__name")).withColumnRenamed("variant", column)
    return (
        df.join(pairs, column, "left")
        .withColumn(column, F.coalesce("__name", F.col(quoted(column))))
        .select([F.col(quoted(c)) for c in df.columns])
    )


def or_default(df: DataFrame, default: Mapping[str, Column], probe: DataFrame | None = None) -> DataFrame:
    """``df``, or one literal row when ``df`` is empty.

    ``probe`` names cheaper rows that are empty exactly when ``df`` is, such as
    the input of an aggregate: the test then stops at its first row.
    """
    spark: SparkSession = df.sparkSession
    found = (df if probe is None else probe).select(F.lit(1).alias("hit")).limit(1)
    row = spark.range(1, numPartitions=1).select(
        [default[f.name].cast(f.dataType).alias(f.name) for f in df.schema.fields]
    )
    return df.unionByName(row.where(found.scalar().isNull()))
