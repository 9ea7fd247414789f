"""Product codes: normal form, check digit, prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digit counts that are a product code at all.
CODE_LENGTHS = (8, 12, 13, 14)


def digits(code: Column) -> Column:
    return F.regexp_replace(F.coalesce(code.cast("string"), F.lit("")), r"\D", "")


def weighted_sum(number: Column) -> Column:
    """Sum of digits weighted 1, 3, 1, 3, ... from the right."""
    place = F.sequence(F.lit(1), F.length(number))
    digit = lambda i: F.substr(number, F.length(number) - i + 1, F.lit(1)).try_cast("int")
    return F.aggregate(place, F.lit(0), lambda s, i: s + digit(i) * F.when(i % 2 == 0, 3).otherwise(1))


def is_valid(code: Column) -> Column:
    """A plausible length and a right check digit; false for null."""
    number = digits(code)
    return F.length(number).isin(*CODE_LENGTHS) & (F.when(F.length(number) > 0, weighted_sum(number)).otherwise(1) % 10 == 0)


def with_check_digit(body: Column) -> Column:
    """``body`` followed by the digit that makes it valid."""
    return F.concat(body, ((10 - weighted_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))


def normal_form(code: Column) -> Column:
    """Fourteen digits lose their packaging digit, twelve get a leading zero; others stay as they are."""
    number = digits(code)
    return F.when(F.length(number) == 14, F.substr(number, F.lit(2))).when(F.length(number) == 12, F.concat(F.lit("0"), number)).otherwise(number)


def is_restricted_short(code: Column) -> Column:
    """Eight-digit codes that begin with 0 or 2 are in-company numbers."""
    number = digits(code)
    return (F.length(number) == 8) & F.substr(number, F.lit(1), F.lit(1)).isin("0", "2")


def prefix(code: Column) -> Column:
    """The first three digits of the normal form; null unless the length is plausible."""
    return F.when(F.length(digits(code)).isin(*CODE_LENGTHS), F.substr(normal_form(code), F.lit(1), F.lit(3)))


def thirteen(code: Column) -> Column:
    """Padded to thirteen digits; longer codes lose leading digits."""
    return F.right(F.lpad(digits(code), 14, "0"), F.lit(13))


def image_code(url: Column) -> Column:
    """The longest run of 8 to 14 digits in a file name that passes the check digit; first on a tie."""
    runs = F.regexp_extract_all(F.element_at(F.split(url, "/"), -1), F.lit(r"(\d{8,14})"), F.lit(1))
    good = F.filter(runs, is_valid)
    return F.get(F.transform(F.sort_array(F.transform(good, lambda r: F.struct((-F.length(r)).alias("n"), r.alias("r")))), lambda s: s["r"]), F.lit(0))
