"""Column expressions: guards, text ids, dose categories, binning, geometry, dates and arrays."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str

#: Fixed edges of the dose categories on a normalised intensity, both right-closed.
DOSE_EDGES = (-0.524, 0.524)
DOSE_LABELS = ("Neg", "Pos", "High")
#: Fixed layout of an experiment id: 1-based start and length of its parts, and where the channel codes end.
WELL_LETTER, WELL, CELL_LINE, CHANNELS_FROM, CHANNELS_END = (16, 1), (16, 3), (19, 4), 23, "NOCO"


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: ColumnLike) -> Column:
    """Null for NaN and infinities."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def number(c: ColumnLike) -> Column:
    """A double, null where the text is none or not finite."""
    return finite(col(c).try_cast("double"))


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b, null where b is zero."""
    b = col(b)
    return col(a) / F.when(b != 0, b)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Features of a table: all numeric columns but the excluded."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def doubles(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, without negative zeros."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in doubles(df)})


def significant(df: DataFrame, digits: int = 11) -> DataFrame:
    """All doubles rounded to so many significant digits, whatever their size."""

    def cut(c: Column) -> Column:
        scale = F.pow(F.lit(10.0), F.floor(F.log10(F.nullif(F.abs(c), F.lit(0.0)))))
        return F.when(c == 0, 0.0).otherwise(F.round(c / scale, digits - 1) * scale)

    return df.withColumns({c: cut(F.col(c).cast("double")) for c in doubles(df)})


# ---- ids ---------------------------------------------------------------------------------------------------------------------


def part_of_id(c: ColumnLike, part: tuple[int, int]) -> Column:
    return F.substring(col(c), *part)


def padded_well(c: ColumnLike) -> Column:
    """B2 to B02; what is no short well stays."""
    c = col(c)
    short = F.regexp_extract(c, r"^([A-Za-z])(\d)$", 0) != ""
    return F.when(short, F.concat(F.upper(F.substring(c, 1, 1)), F.lpad(F.substring(c, 2, 1), 2, "0"))).otherwise(c)


def well_of(c: ColumnLike) -> Column:
    """The well after CHR and a number; null where there is none."""
    return F.nullif(F.regexp_extract(col(c), r"CHR\d+([A-Z]\d{2})", 1), F.lit(""))


def treatment_of(c: ColumnLike, known: Column | None = None) -> Column:
    """The treatment code: what stands between the cell line and the end of the channels. known (from a map) goes first."""
    c = col(c)
    rest = F.substring(c, F.lit(CHANNELS_FROM), F.length(c))
    code = F.nullif(F.substring_index(rest, CHANNELS_END, 1), F.lit(""))
    return code if known is None else F.coalesce(known, code)


def channel_codes(c: ColumnLike) -> Column:
    """The channel codes (of four characters) of an id, as an array."""
    code = F.coalesce(treatment_of(c), F.lit(""))
    return F.filter(F.transform(F.sequence(F.lit(0), F.floor(F.length(code) / 4).cast("int")), lambda i: F.substring(code, i * 4 + 1, F.lit(4))), lambda x: x != "")


def base_of(c: ColumnLike) -> Column:
    """A well name's leading letters without the number after them."""
    return F.regexp_replace(col(c), r"(?i)^([a-z]+)\d+", "$1")


def time_stamp(time_index: ColumnLike, dt_minutes: ColumnLike) -> Column:
    """The synthetic time axis, in steps of dt minutes from the start of 2000."""
    return F.timestamp_seconds(F.lit(946_684_800) + F.round(col(time_index) * col(dt_minutes) * 60))


def shifted_date(date: ColumnLike, n: int, unit: str) -> Column:
    """A date n hours, days, weeks or months (their ends) later."""
    date = col(date)
    if unit == "M":
        return F.last_day(F.add_months(date, n))
    return date + F.make_interval(hours=F.lit(n if unit == "H" else 0), days=F.lit(n if unit == "D" else 0), weeks=F.lit(n if unit == "W" else 0))


# ---- categories --------------------------------------------------------------------------------------------------------------


def binned(c: ColumnLike, edges: Sequence[float | Column], labels: Sequence[str]) -> Column:
    """The label of a value's bin; bins are right-closed, the first and last are open."""
    c = col(c)
    out = F.when(c.isNull(), None)
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(c <= edge, label)
    return out.otherwise(labels[-1])


def dose_category(c: ColumnLike) -> Column:
    return binned(c, DOSE_EDGES, DOSE_LABELS)


def dose_combo(channels: dict[str, str], separator: str = "|") -> Column:
    """name:category of each channel that has a category, joined; null where none has. channels: name to column."""
    named = F.array(*[F.when(F.col(c).isNotNull() & (F.col(c) != "NA"), F.concat(F.lit(f"{name}:"), F.col(c))) for name, c in channels.items()])
    return F.nullif(F.concat_ws(separator, named), F.lit(""))


def joined_doses(columns: Sequence[str], separator: str = "_") -> Column:
    """Categories joined with NA for nulls."""
    return F.concat_ws(separator, *[F.coalesce(F.col(c), F.lit("NA")) for c in columns])


def channel_pattern(pattern: str, categories: Sequence[str]) -> Column:
    """Whether cells are positive (Pos or High) or not in each channel as the pattern of P and N says.

    As in the original, PN of two channels means that the first is negative and the second positive.
    """
    wanted = {"PN": "NP"}.get(pattern, pattern)
    out = F.lit(True)
    for sign, c in zip(wanted, categories, strict=False):
        positive = F.coalesce(F.col(c).isin("Pos", "High"), F.lit(False))
        out &= positive if sign == "P" else F.coalesce(F.col(c) == "Neg", F.lit(False))
    return out


# ---- values ------------------------------------------------------------------------------------------------------------------


def signed_log(c: ColumnLike) -> Column:
    c = col(c)
    return F.signum(c) * F.log1p(F.abs(c))


def distance(pairs: Sequence[tuple[ColumnLike, ColumnLike]]) -> Column:
    """Euclidean distance over pairs of coordinates."""
    return F.sqrt(sum((F.pow(col(a) - col(b), 2) for a, b in pairs), F.lit(0.0)))


def eccentricity(a: ColumnLike, b: ColumnLike) -> Column:
    """Of an ellipse by its two axes; null where the longer is not positive."""
    long, short = F.greatest(col(a), col(b)), F.least(col(a), col(b))
    return F.when(long > 0, F.sqrt(1 - F.pow(short / F.when(long > 0, long), 2)))


def sphericity(volume: ColumnLike, area: ColumnLike) -> Column:
    """Wadell's: the surface of a ball of that volume to the surface."""
    return ratio(math.pi ** (1 / 3) * F.pow(6 * col(volume), 2 / 3), area)


def equivalent_diameter(area: ColumnLike) -> Column:
    return F.sqrt(4 * col(area) / math.pi)


def flattened(values: ColumnLike, features: Sequence[str]) -> Column:
    """The arrays of a map, in the order of features, as one array; null if a feature or a finite value is missing."""
    values = col(values)
    parts = F.flatten(F.array(*[F.try_element_at(values, F.lit(f)) for f in features]))
    whole = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(F.coalesce(whole, F.lit(False)), parts)


def padded(values: ColumnLike, n: int, filler: float | None = None) -> Column:
    """An array of exactly n entries."""
    values = col(values)
    return F.slice(F.concat(values, F.array_repeat(F.lit(filler).cast("double"), n)), 1, n)
