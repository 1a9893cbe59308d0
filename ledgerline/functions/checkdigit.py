"""Container numbers: four letters of which the last is U, J or Z, six digits and a check digit (ISO 6346)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letter_values() -> dict[str, int]:
    """A is 10, and each next letter the next number that eleven does not divide."""
    numbers = [n for n in range(10, 40) if n % 11]
    return {chr(65 + i): numbers[i] for i in range(26)}


def cleaned(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"[\s-]+", ""))


def check_digit(body: Column) -> Column:
    """The digit for the first ten characters: values times powers of two, modulo 11, of which 10 counts as 0."""
    table = F.create_map(*[F.lit(x) for k, v in {**{str(d): d for d in range(10)}, **letter_values()}.items() for x in (k, v)])
    total = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0), lambda so_far, i: so_far + F.try_element_at(table, F.substr(body, i + 1, F.lit(1))) * F.pow(F.lit(2), i).cast("int"))
    return F.pmod(F.pmod(total, F.lit(11)), F.lit(10))


def check(c: Column) -> Column:
    """struct(well_formed, provably_wrong, expected, reason)."""
    s = cleaned(c)
    good = F.coalesce(s.rlike("^[A-Z]{3}[UJZ][0-9]{7}$"), F.lit(False))
    expected = F.when(good, check_digit(F.substr(s, F.lit(1), F.lit(10))))
    wrong = F.when(good, expected != F.substr(s, F.lit(11), F.lit(1)).try_cast("int"))
    reason = (
        F.when(s.isNull(), "missing").when(F.length(s) != 11, "length").when(~s.rlike("^[A-Z]{4}"), "letters")
        .when(~s.rlike("^...[UJZ]"), "category").when(~good, "digits").when(wrong, "check_digit").otherwise("consistent")
    )
    return F.struct(good.alias("well_formed"), F.coalesce(wrong, F.lit(False)).alias("provably_wrong"), expected.alias("expected"), reason.alias("reason"))


def error_lower_bound(value: Column) -> Column:
    """Aggregate struct(wrong, checkable, rate): a lower bound of the share of misread numbers, 0 where there is none.

    A value without the shape of a number was misread and counts as wrong; null is no reading and does not count.
    """
    c = check(value)
    wrong, checkable = F.count_if(value.isNotNull() & (c["provably_wrong"] | ~c["well_formed"])), F.count(value)
    return F.struct(wrong.alias("wrong"), checkable.alias("checkable"), F.coalesce(F.try_divide(wrong, checkable), F.lit(0.0)).alias("rate"))
