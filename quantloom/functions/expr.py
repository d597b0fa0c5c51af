"""Scalar column expressions.  NULL means missing; it is never read as zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den where den is over 0, else NULL."""
    return F.when(col(den) > 0, col(num) / col(den))


def clip(c: str | Column, low: float, high: float) -> Column:
    """NULL stays NULL (least and greatest alone would skip it)."""
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(low)), F.lit(high)))


def true(c: str | Column) -> Column:
    """A predicate with NULL read as false."""
    return F.coalesce(col(c), F.lit(False))


def sign(c: str | Column) -> Column:
    return F.signum(col(c))


def mean_of(cols: list[str | Column], least: int = 1) -> Column:
    """Mean of the values that are there, if at least `least` are."""
    cs = [col(c) for c in cols]
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cs])
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cs])
    return F.when(n >= least, total / n)


def first_match(cases: list[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first condition that holds; NULL conditions don't."""
    out = None
    for test, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(true(test), value) if out is None else out.when(true(test), value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def date_key(c: str | Column) -> Column:
    """YYYYMMDD as an integer."""
    return F.year(col(c)) * 10000 + F.month(col(c)) * 100 + F.day(col(c))


def week_ending_friday(c: str | Column) -> Column:
    """The Friday that ends the Saturday-to-Friday week of a date."""
    return F.date_add(F.date_trunc("week", F.date_add(col(c), 2)).cast("date"), 4)


def exchange_of(code: str | Column) -> Column:
    """Exchange by the leading digits of a six-digit code: 60, 68 SH; 00, 30, 20 SZ; 4, 8 BJ."""
    c = col(code)
    return F.when(F.left(c, F.lit(2)).isin("60", "68"), "SH").when(F.left(c, F.lit(2)).isin("00", "30", "20"), "SZ").when(F.left(c, F.lit(1)).isin("4", "8"), "BJ")


def parse_symbol(raw: str | Column) -> Column:
    """struct(code, exchange) of `SH:688183`, `688183.SH`, `688183` and the like (blanks and a full-width colon allowed); NULLs if it is none."""
    text = F.upper(F.regexp_replace(F.regexp_replace(col(raw), "：", ":"), r"\s+", ""))
    code = F.regexp_extract(text, r"^(?:(?:SH|SZ|BJ)[:.]?)?(\d{6})(?:\.(?:SH|SZ|BJ))?$", 1)
    named = F.regexp_extract(text, r"(SH|SZ|BJ)", 1)
    code = F.when(code != "", code)
    return F.struct(code.alias("code"), F.when(code.isNotNull(), F.when(named != "", named).otherwise(exchange_of(code))).alias("exchange"))


def parse_date(raw: str | Column) -> Column:
    """Dates as YYYYMMDD, YYYY-MM-DD or YYYY/MM/DD; anything else NULL."""
    c = F.trim(col(raw))
    return F.coalesce(F.when(c.rlike(r"^\d{8}$"), F.try_to_timestamp(c, F.lit("yyyyMMdd")).cast("date")), F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")), F.when(c.rlike(r"^\d{4}/\d{2}/\d{2}$"), F.try_to_timestamp(c, F.lit("yyyy/MM/dd")).cast("date")))


def parse_clock(raw: str | Column) -> Column:
    """Seconds of the day from an integer (below 86400: seconds, else HHMMSS) or HH:MM[:SS]; NULL if any part is out of range."""
    c = F.trim(col(raw))
    number = F.when(c.rlike(r"^\d{1,6}$"), c.cast("int"))
    proper = (F.floor(number % 10000 / 100) < 60) & (number % 100 < 60)
    hms = F.when(number < 86400, number).when(proper, F.floor(number / 10000) * 3600 + F.floor(number % 10000 / 100) * 60 + number % 100)
    parts = F.split(c, ":")
    clock = F.when(c.rlike(r"^\d{1,2}:[0-5]\d(:[0-5]\d)?$"), parts[0].cast("int") * 3600 + parts[1].cast("int") * 60 + F.coalesce(F.get(parts, F.lit(2)).cast("int"), F.lit(0)))
    out = F.coalesce(hms, clock)
    return F.when((out >= 0) & (out < 86400), out).cast("int")


def session_class(seconds: str | Column) -> Column:
    """auction [09:15,09:30), continuous [09:30,11:30) and [13:00,15:00), after_hours from 15:00, else out."""
    s = col(seconds)
    return first_match([((s >= 33300) & (s < 34200), "auction"), ((s >= 34200) & (s < 41400) | (s >= 46800) & (s < 54000), "continuous"), (s >= 54000, "after_hours")], "out")


def session_part(minute: str | Column) -> Column:
    """am 09:30 to 11:30 inclusive, pm 13:00 to 14:59, else out."""
    m = col(minute)
    return first_match([(m.between(570, 690), "am"), (m.between(780, 899), "pm")], "out")


def in_session(minute: str | Column, ends: bool) -> Column:
    """Whether a bar labelled by its start (or, with `ends`, by its end) lies in a session."""
    m = col(minute)
    if ends:
        return (m > 570) & (m <= 690) | (m > 780) & (m <= 900)
    return (m >= 570) & (m < 690) | (m >= 780) & (m < 900)


def limit_ratio(code: str | Column) -> Column:
    """Daily price limit: 0.20 for codes from 300, 301, 688, 689, else 0.10."""
    return F.when(F.left(col(code), F.lit(3)).isin("300", "301", "688", "689"), 0.20).otherwise(0.10)


#: Words that are true and false, and whether numbers that equal 1 or 0 are, too: of a setting, of a prediction's columns, of a feature's columns.
BOOLEANS = {"setting": (("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off"), False), "flag": (("true", "t"), ("false", "f"), True), "feature": (("true", "t", "yes", "y"), ("false", "f", "no", "n"), True)}


def parse_boolean(raw: str | Column, kind: str = "setting", default: bool | None = False, strict: bool = True) -> Column:
    """A boolean written as text, in any case and with blanks around; missing (and, but for a setting, blank) text is the default. Anything else is an error, or NULL if not strict."""
    yes, no, numbers = BOOLEANS[kind]
    c = F.lower(F.trim(col(raw)))
    number = c.try_cast("double")
    is_yes, is_no = (c.isin(*words) | ((number == value) if numbers else F.lit(False)) for words, value in ((yes, 1.0), (no, 0.0)))
    missing = c.isNull() if kind == "setting" else c.isNull() | (c == "")
    bad = F.raise_error(F.concat(F.lit("not a boolean: "), col(raw))).cast("boolean") if strict else F.lit(None).cast("boolean")
    return F.when(missing, F.lit(default).cast("boolean")).when(true(is_yes), True).when(true(is_no), False).otherwise(bad)


def canonical_key(fields: dict[str, str | Column]) -> Column:
    """SHA-256 of the JSON object of some columns, keys in order, NULLs kept."""
    return F.sha2(F.to_json(F.struct(*[col(c).alias(k) for k, c in sorted(fields.items())]), {"ignoreNullFields": "false"}), 256)
