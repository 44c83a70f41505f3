"""Rules in which the engine's expressions differ from Spark's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(value: Column, kind: str) -> Column:
    """WHERE's truth of a value of a Spark type: non-zero numbers, any text or bytes."""
    if kind == "boolean":
        return value
    if kind in ("string", "binary"):
        return F.when(value.isNotNull(), F.lit(True))
    return value != 0


def int_div(a: Column, b: Column) -> Column:
    """Integer division towards zero; a zero divisor is an error."""
    return F.call_function("div", a, b)


def sum0(value: Column) -> Column:
    """SUM of a group or table: 0 where there is no value."""
    return F.coalesce(F.sum(value), F.lit(0))


def avg_decimal(value: Column, digits: int = 6) -> Column:
    """AVG of decimals, rounded half to even at a fixed number of digits."""
    total = F.sum(value).cast("decimal(38,10)")
    return F.bround(total / F.count(value), digits)


def between3(value: Column, low: Column, high: Column) -> Column:
    """BETWEEN that is NULL if any operand is, even where one bound decides."""
    some_null = value.isNull() | low.isNull() | high.isNull()
    return F.when(~some_null, (value >= low) & (value <= high))


def like_pattern(pattern: str, escape: str | None = None) -> str:
    """A regular expression for a LIKE pattern; None of it is special but % and _.

    The escape character may precede any character; one that ends the pattern
    makes it match nothing.
    """
    import re

    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape:
            i += 1
            if i == len(pattern):
                return r"(?!)"
            out.append(re.escape(pattern[i]))
        else:
            out.append({"%": ".*", "_": "."}.get(c) or re.escape(c))
        i += 1
    return "(?is)^" + "".join(out) + r"\z"


def like(value: Column, pattern: str, escape: str | None = None) -> Column:
    """Case-insensitive LIKE."""
    if "_" not in pattern and not escape and pattern.count("%") <= 2 and "%" not in pattern.strip("%"):
        part, text = pattern.strip("%").upper(), F.upper(value)
        if pattern.startswith("%") and pattern.endswith("%") and len(pattern) > 1:
            return text.contains(part)
        if pattern.endswith("%"):
            return text.startswith(part)
        return text.endswith(part) if pattern.startswith("%") else text == part
    return value.rlike(like_pattern(pattern, escape))


def collation_key(value: Column, collation: str) -> Column:
    """What a collation compares: BINARY as it is, NOCASE upper-cased, NOCASE_AI without marks too."""
    name = collation.upper()
    if name == "BINARY":
        return value
    if name == "NOCASE":
        return F.upper(value)
    if name == "NOCASE_AI":
        return F.upper(F.collate(value, "UNICODE_CI_AI"))
    if name.startswith("ICU:"):
        return F.collate(value, f"{collation[4:].replace('-', '_')}_CI")
    raise ValueError(f"unknown collation {collation}")


def strict_int(value: Column, kind: str) -> Column:
    """CAST to an integer type: an error unless the value is exactly integral."""
    whole = value.cast("decimal(38,9)")
    fault = F.raise_error(F.concat(F.lit("not an integer: "), value.cast("string")))
    return F.when(whole.isNull() | (whole == F.floor(whole)), value).otherwise(fault.cast("double")).cast(kind)


def tinyint(value: Column) -> Column:
    """The unsigned one-byte integer, in a SMALLINT."""
    fault = F.raise_error(F.lit("TINYINT holds 0 to 255")).cast("smallint")
    return F.when(value.isNull() | value.between(0, 255), value.cast("smallint")).otherwise(fault)
