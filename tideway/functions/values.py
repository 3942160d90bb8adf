"""Numbers and series from text, with the defaults that missing values get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.functions.labels import let


def finite(value: Column) -> Column:
    """The value as a double, or null if it is missing, not a number or infinite."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def numeric(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(finite(value), F.lit(float(default)))


def named(df: DataFrame, names: list[str]) -> list[Column]:
    """Columns of ``df`` by case-insensitive name, in the order of ``names``; resolved once, when the plan is made."""
    known = {c.strip().lower(): c for c in df.columns}
    return [F.col(f"`{known[n.lower()]}`") for n in names if n.lower() in known]


def number_of(df: DataFrame, names: list[str], default: Column | float) -> Column:
    """The first of the named columns with a finite number (thousands commas allowed), else the default."""
    default = default if isinstance(default, Column) else F.lit(float(default))
    return F.coalesce(*[finite(F.replace(c.cast("string"), F.lit(","), F.lit(""))) for c in named(df, names)], default)


def text_of(df: DataFrame, names: list[str]) -> Column:
    """The first of the named columns that is not blank, else null."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c.cast("string")) for c in named(df, names)], F.lit(None).cast("string"))


def parse_ppi(text: Column) -> Column:
    """``struct(iats, dirs, lengths)`` of equal length from a list of lists; null if malformed, short of three lists, or empty."""

    def cut_even(lists: Column) -> Column:
        n = F.least(*[F.size(F.get(lists, F.lit(i))) for i in range(3)])
        iats, dirs, lengths = (F.slice(F.get(lists, F.lit(i)), F.lit(1), F.greatest(n, F.lit(0))) for i in range(3))
        whole = (F.size(lists) >= 3) & (n > 0) & ~F.exists(F.concat(iats, dirs, lengths), lambda x: x.isNull())
        found = F.struct(iats.alias("iats"), F.transform(dirs, lambda x: x.cast("int")).alias("dirs"), lengths.alias("lengths"))
        return F.when(whole, found)

    return let(F.from_json(F.translate(text, "()", "[]"), "array<array<double>>"), cut_even)


def series_text(values: Column, precision: int) -> Column:
    """Numbers joined by ``;`` with fixed decimals (0: as whole numbers)."""
    if precision == 0:
        return F.array_join(F.transform(values, lambda x: x.cast("long").cast("string")), ";")
    return F.array_join(F.transform(values, lambda x: F.format_string(f"%.{precision}f", x)), ";")


def parse_series(text: Column, whole: bool = False) -> Column:
    """Numbers from text divided by ``;``, ``,``, ``|`` or spaces; null if any part is not a number."""
    parts = F.filter(F.split(F.translate(text, ";| ", ",,,"), ","), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    good = F.when((F.size(numbers) > 0) & ~F.exists(numbers, lambda x: x.isNull()), numbers)
    return F.transform(good, lambda x: x.cast("int")) if whole else good


def epoch_seconds(text: Column, numeric_file: Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss")) -> Column:
    """Seconds from numbers where the file holds numbers, else from date text without its non-ASCII characters."""
    clean = F.regexp_replace(text, r"[^\x00-\x7F]+", "")
    parsed = F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f in formats], F.try_to_timestamp(clean))
    return F.when(numeric_file, text.try_cast("double")).otherwise(F.unix_micros(parsed) / 1e6)
