"""Text, number, date and hash expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain forms.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyAAAAAAEEEEIIIIOOOOOUUUUCNY"

# Words read as true.
TRUE_WORDS = ("true", "1", "sim", "yes")


def missing(c: Column) -> Column:
    """NULL, or blank after trimming."""
    return c.isNull() | (F.trim(c) == "")


def holds(condition: Column) -> Column:
    """The condition, with unknown counted as false."""
    return F.coalesce(condition, F.lit(False))


def close(a: Column, b: Column, atol: float = 0.01, rtol: float = 0.0) -> Column:
    """|a - b| within the tolerance; NULL where either is."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def normal_text(c: Column) -> Column:
    """Comparison key: trimmed, lower case, single blanks, no accents."""
    return F.translate(F.lower(F.regexp_replace(F.trim(c), r"\s+", " ")), ACCENTED, PLAIN)


def clean(c: Column) -> Column:
    """Trimmed; blank becomes NULL. Case stays."""
    return F.nullif(F.trim(c), F.lit(""))


def label(c: Column, empty: str = "[NULO]") -> Column:
    """The trimmed text, or a label where it is missing."""
    return F.coalesce(clean(c), F.lit(empty))


def slug(c: Column) -> Column:
    """Lower-case ASCII with underscores."""
    return F.regexp_replace(F.regexp_replace(normal_text(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def truthy(c: Column, words: Sequence[str] = TRUE_WORDS) -> Column:
    return F.lower(F.trim(c)).isin(*words)


def number(c: Column) -> Column:
    """A localised number: currency and percent signs and blanks go; the last of ',' and '.' is the decimal mark."""
    bare = F.regexp_replace(F.regexp_replace(c, "R\\$|%", ""), r"\s+", "")
    comma, dot = F.length(bare) - F.instr(F.reverse(bare), ","), F.length(bare) - F.instr(F.reverse(bare), ".")
    has_comma, has_dot = F.instr(bare, ",") > 0, F.instr(bare, ".") > 0
    decimal_comma = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return (
        F.when(has_comma & has_dot & (comma > dot), decimal_comma)
        .when(has_comma & has_dot, F.replace(bare, F.lit(","), F.lit("")))
        .when(has_comma, F.replace(bare, F.lit(","), F.lit(".")))
        .otherwise(bare)
        .try_cast("double")
    )


def plain_number(c: Column) -> Column:
    """A number after ',' is read as '.'."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def date(c: Column) -> Column:
    """ISO first, then day first; NULL where no pattern fits or the day does not exist."""
    t = F.trim(c)
    # a text without the pattern's mark isn't tried: failed attempts are what costs
    day_first = [F.when(F.contains(t, F.lit(p[1])), F.try_to_timestamp(t, F.lit(p))).cast("date") for p in ("d/M/yyyy", "d-M-yyyy", "d/M/yyyy HH:mm:ss", "d/M/yyyy HH:mm")]
    iso = F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), iso).otherwise(F.coalesce(*day_first))


def month(c: Column) -> Column:
    """First day of a reference month: yyyyMM (also with .0), else as a date."""
    t = F.regexp_replace(F.trim(c), r"\.0$", "")
    return F.trunc(F.when(t.rlike(r"^\d{6}$"), F.try_to_timestamp(t, F.lit("yyyyMM")).cast("date")).otherwise(date(t)), "MM")


def time_of_day(c: Column) -> Column:
    """Minute of the day of the text's last token H:mm[:ss[.f]]; NULL where it isn't a time."""
    last = F.regexp_extract(F.trim(c), r"(\S+)$", 1)
    part = lambda i: F.regexp_extract(last, r"^(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?$", i).try_cast("int")
    h, m, s = part(1), part(2), F.coalesce(part(3), F.lit(0))
    return F.when((h <= 23) & (m <= 59) & (s <= 59), h * 60 + m)


def row_hash(*cols: Column) -> Column:
    """Upper-case SHA-256 of the values joined by '|', NULLs marked."""
    return F.upper(F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("<NULL>")) for c in cols]), 256))


def percent(a: Column, b: Column, digits: int = 4) -> Column:
    """100 a / b, rounded; 0 where b is 0."""
    return F.coalesce(F.round(F.try_divide(a.cast("double") * 100, b.cast("double")), digits), F.lit(0.0))


def ratio(a: Column, b: Column, zero: bool = False) -> Column:
    """a / b; NULL (or 0 if `zero`) where b is 0."""
    r = F.try_divide(a.cast("double"), b.cast("double"))
    return F.coalesce(r, F.lit(0.0)) if zero else r


def clip_low(c: Column) -> Column:
    """At least 0; NULL stays NULL."""
    return F.when(c < 0, F.lit(0)).otherwise(c)


def banded(c: Column, bands: Sequence[tuple[str, float | None]], empty: str | None = None) -> Column:
    """The label of the first band whose inclusive upper bound holds c; a bound of None is open."""
    out = F.when(c.isNull(), F.lit(empty))
    for name, upper in bands:
        out = out.when(F.lit(True) if upper is None else c <= upper, F.lit(name))
    return out


def calendar(d: Column) -> dict[str, Column]:
    """Calendar parts of a date."""
    return {
        "date_sk": F.date_format(d, "yyyyMMdd").cast("int"), "year": F.year(d), "half": F.when(F.month(d) <= 6, 1).otherwise(2),
        "quarter": F.quarter(d), "month": F.month(d), "iso_week": F.weekofyear(d), "day_of_year": F.dayofyear(d),
        "day": F.dayofmonth(d), "weekday": F.weekday(d) + 1, "year_month": (F.year(d) * 100 + F.month(d)).cast("int"),
        "is_weekend": F.weekday(d) >= 5,
    }


def typed(c: Column, kind: str) -> Column:
    """Cast by contract type; decimals to six places half even, booleans by words, times to a minute."""
    if kind == "float64":
        return F.bround(number(c).cast("decimal(38,10)"), 6).cast("decimal(19,6)")
    if kind == "bool":
        return F.when(c.isNull(), None).when(truthy(c), True).when(F.lower(F.trim(c)).isin("false", "0", "não", "nao", "no"), False)
    simple = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "string": "string"}
    if kind in simple:
        return c.try_cast(simple[kind])
    return {"date": date, "datetime": lambda x: F.try_to_timestamp(x), "time": time_of_day}[kind](c)
