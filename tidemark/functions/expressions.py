"""Flags, defaults, guarded arithmetic, tolerant JSON, ordered rules and lookups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = [
    "as_column", "bucket_flag", "clean_nan", "contains_rules", "count_where", "distinct_list",
    "fill_defaults", "flag", "guarded_ratio", "half_even", "half_up", "json_text", "lookup",
    "mean_seconds", "period_sin_cos", "present_flag", "repair_json", "seconds_between",
    "sum_where", "to_number",
]


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def flag(condition: Column) -> Column:
    """1 where the condition is true, 0 where it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def present_flag(column: str | Column) -> Column:
    return as_column(column).isNotNull().cast("int")


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def sum_where(condition: Column, value: str | Column) -> Column:
    """Sum of ``value`` over matching rows; other rows add nothing, so no match gives 0."""
    value = as_column(value)
    return F.sum(F.when(condition, value).otherwise(F.lit(0)))


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace NULL by a literal per column, keeping each column's type."""
    types = {field.name: field.dataType for field in df.schema.fields}
    return df.withColumns({
        name: F.coalesce(F.col(name), F.lit(value).cast(types[name])) for name, value in defaults.items()
    })


def guarded_ratio(top: str | Column, bottom: str | Column, default: float = 0.0) -> Column:
    """``top / bottom`` as double, ``default`` where the denominator is 0 or missing."""
    top, bottom = as_column(top).cast("double"), as_column(bottom).cast("double")
    return F.when(F.coalesce(bottom, F.lit(0.0)) == 0.0, F.lit(default)).otherwise(top / bottom)


def clean_nan(column: str | Column) -> Column:
    """NaN sorts above every number in Spark, so imported float data is normalised to NULL."""
    column = as_column(column)
    return F.when(~F.isnan(column), column)


def to_number(column: str | Column) -> Column:
    """Number or NULL; text that is no number does not fail the job."""
    return clean_nan(as_column(column).try_cast("double"))


def half_up(column: str | Column, places: int) -> Column:
    """Half-up rounding as on exact numbers: float noise below 1e-10 cannot tip a tie.

    Values beyond the decimal range have no digits behind the point to round and stay as they are.
    """
    column = as_column(column)
    return F.coalesce(F.round(column.try_cast(T.DecimalType(38, 10)), places).cast("double"), column.cast("double"))


def half_even(column: str | Column, places: int) -> Column:
    return F.bround(as_column(column), places)


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", as_column(start), as_column(end)) / F.lit(1e6)


def mean_seconds(start: str | Column, end: str | Column, places: int = 2) -> Column:
    return half_up(F.avg(F.timestamp_diff("MICROSECOND", as_column(start), as_column(end))) / F.lit(1e6), places)


def distinct_list(column: str | Column, separator: str = ", ") -> Column:
    """Sorted distinct values as one text, NULL when there is none.

    ``collect_set`` aggregates partially before the shuffle, and several lists in one ``agg`` do
    not multiply the rows the way several DISTINCT aggregates would.
    """
    column = as_column(column).cast("string")
    joined = F.array_join(F.array_sort(F.collect_set(column)), separator)
    return F.when(F.count(column) > 0, joined)


# The two repairs that turn loose `{key: value}` text into strict JSON.
BARE_KEY = r"([a-zA-Z0-9_]+)\s*:"
BARE_VALUE = {
    "word": (r":\s*([a-zA-Z0-9_]+)", r': "$1"'),
    "phrase": (r':\s*([^"}]+)\s*([,}])', r': "$1"$2'),
}


def repair_json(column: str | Column, value_style: str = "word") -> Column:
    pattern, replacement = BARE_VALUE[value_style]
    quoted_keys = F.regexp_replace(as_column(column), BARE_KEY, r'"$1":')
    return F.regexp_replace(quoted_keys, pattern, replacement)


def json_text(column: str | Column, key: str, value_style: str = "word") -> Column:
    """A field of a JSON text; a text is repaired only where it is no valid JSON as it stands."""
    column, path = as_column(column), f"$.{key}"
    valid = F.get_json_object(column, "$").isNotNull()
    return F.when(valid, F.get_json_object(column, path)).otherwise(F.get_json_object(repair_json(column, value_style), path))


def contains_rules(column: str | Column, rules: Iterable[tuple[str, object]], default: object) -> Column:
    """First rule whose text occurs in the column wins."""
    column = as_column(column)
    chain = None
    for needle, outcome in rules:
        outcome = outcome if isinstance(outcome, Column) else F.lit(outcome)
        hit = column.contains(needle)
        chain = F.when(hit, outcome) if chain is None else chain.when(hit, outcome)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if chain is None else chain.otherwise(default)


def lookup(key: str | Column, table: Mapping[str, object], default: object) -> Column:
    """A small fixed map as a literal; unknown and NULL keys give the default."""
    entries = [F.lit(part) for pair in table.items() for part in pair]
    key = as_column(key)
    return F.coalesce(F.when(key.isNotNull(), F.try_element_at(F.create_map(*entries), key)), F.lit(default))


def bucket_flag(column: str | Column, at_least: float) -> Column:
    return flag(as_column(column) >= F.lit(at_least))


def period_sin_cos(column: str | Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * as_column(column) / F.lit(period)
    return F.sin(angle), F.cos(angle)
