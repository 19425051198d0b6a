"""Text -> typed value as column expressions, stricter than Spark's own casts.

A parser yields NULL for text that does not fit the type; callers count such cells as bad.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from strata.functions.names import require

# The five clean types.
TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "bool": T.BooleanType(),
    "int": T.LongType(),
    "float": T.DoubleType(),
    "timestamp": T.TimestampType(),
}

# Every character Python counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_DIGITS = r"\d+(?:_\d+)*"
_FLOAT = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
_DATE = r"(\d{4}-\d{2}-\d{2}|\d{8})"
_CLOCK = r"(\d{2}(?::\d{2}(?::\d{2})?)?|\d{4}|\d{6})"
_ZONE = r"(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)"
_TIMESTAMP = rf"^{_DATE}(?:.{_CLOCK}(?:[.,](\d+))?{_ZONE}?)?$"
_PLAIN_DATE = r"^\d{4}-\d{2}-\d{2}$"
_COMMON_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"


def check_types(type_names) -> None:
    unknown = sorted(set(type_names) - set(TYPES))
    require(not unknown, f"unknown column types: {unknown}; known are {sorted(TYPES)}")


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    """Strip, then turn empty text into a missing value."""
    return F.nullif(strip(text), F.lit(""))


def _parse_bool(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)


def _parse_int(text: Column) -> Column:
    # Underscores between digits are legal; the cast itself refuses decimals, suffixes and overflow.
    grouped = F.when(text.rlike(rf"^[+-]?{_DIGITS}$"), F.replace(text, F.lit("_"), F.lit("")))
    return F.when(text.contains("_"), grouped).otherwise(text).try_cast("bigint")


def _parse_float(text: Column) -> Column:
    # Spark's cast also takes suffixes such as 1.5d, so the shape is checked first.
    plain = F.when(text.rlike(_FLOAT), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    low = F.lower(text)
    return (
        # Digits, signs and points only: the cast decides exactly as it should.
        F.when(~text.rlike(r"[^0-9.+-]"), text.try_cast("double"))
        .when(low.rlike(r"^[+-]?nan$"), F.lit(float("nan")))
        .when(low.rlike(r"^[+]?inf(?:inity)?$"), F.lit(float("inf")))
        .when(low.rlike(r"^-inf(?:inity)?$"), F.lit(float("-inf")))
        .otherwise(plain)
    )


def _padded_clock(digits: Column) -> Column:
    """Up to six digits -> HH:MM:SS, missing parts are zero."""
    full = F.rpad(digits, 6, "0")
    return F.concat_ws(":", F.substring(full, 1, 2), F.substring(full, 3, 2), F.substring(full, 5, 2))


def _parse_timestamp(text: Column) -> Column:
    """ISO 8601 date, optional time, optional zone; no zone means UTC."""
    def group(i: int) -> Column:
        return F.regexp_extract(text, _TIMESTAMP, i)

    date = F.replace(group(1), F.lit("-"), F.lit(""))
    clock = F.replace(group(2), F.lit(":"), F.lit(""))
    fraction = F.when(group(3) == "", F.lit("")).otherwise(F.concat(F.lit("."), group(3)))
    zone = group(4)
    offset = (
        F.when(zone.isin("", "Z"), F.lit("+00:00"))
        .otherwise(F.concat(F.substring(zone, 1, 1), _padded_clock(F.replace(F.substring(zone, 2, 20), F.lit(":"), F.lit("")))))
    )
    rebuilt = F.concat(
        F.substring(date, 1, 4), F.lit("-"), F.substring(date, 5, 2), F.lit("-"), F.substring(date, 7, 2),
        F.lit("T"), _padded_clock(clock), fraction, offset,
    )
    # The two usual shapes need no taking apart.
    value = (
        F.when(text.rlike(_COMMON_TIMESTAMP), text)
        .when(text.rlike(_PLAIN_DATE), F.concat(text, F.lit("T00:00:00Z")))
        .when(text.rlike(_TIMESTAMP), rebuilt)
    )
    return F.when(~text.startswith("0000"), value).try_cast("timestamp")


_PARSERS = {
    "string": lambda text: text,
    "bool": _parse_bool,
    "int": _parse_int,
    "float": _parse_float,
    "timestamp": _parse_timestamp,
}


def _usual_int(text: Column) -> Column:
    value = text.try_cast("bigint")
    return F.when(value.cast("string") == text, value)


def _usual_float(text: Column) -> Column:
    # Casting text that is no number costs much, so what does not begin like one is left out.
    value = text.try_cast("double")
    return F.when((text >= "+") & (text < ":") & (value.cast("string") == text), value)


def _usual_date(text: Column) -> Column:
    seconds = F.unix_date(text.try_cast("date")).cast("bigint") * 86400
    return F.when((F.octet_length(text) == 10) & text.rlike(_PLAIN_DATE) & ~text.startswith("0000"), F.timestamp_seconds(seconds))


_USUAL = {"int": _usual_int, "float": _usual_float, "timestamp": _usual_date}


def usual(text: Column, type_name: str) -> Column | None:
    """The value of text in its most common spelling, as `parse` has it after stripping, else NULL; None for a type without such a spelling.

    A number that reads back exactly as it was written, or a plain date, needs neither stripping nor further checks.
    """
    check_types([type_name])
    return _USUAL[type_name](text) if type_name in _USUAL else None


def parse(text: Column, type_name: str) -> Column:
    """Parse stripped, non-blank text as one of the five clean types; NULL if it does not fit."""
    check_types([type_name])
    return _PARSERS[type_name](text)
