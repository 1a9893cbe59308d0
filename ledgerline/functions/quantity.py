"""Numbers, money and units as printed. A refusal is a reason, never an exception and never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit, dimension, exact factor to the dimension's base unit, printed forms.
UNITS = (
    ("kg", "mass", "1", ("kg", "kgs")),
    ("lb", "mass", "0.45359237", ("lb", "lbs")),
    ("t", "mass", "1000", ("t", "mt")),
    ("m", "length", "1", ("m",)),
    ("cm", "length", "0.01", ("cm",)),
    ("in", "length", "0.0254", ("in",)),
    ("ft", "length", "0.3048", ("ft",)),
    ("m3", "volume", "1", ("m3", "cbm")),
    ("ft3", "volume", "0.028316846592", ("ft3", "cft")),
    ("pcs", "count", "1", ("pcs", "pc")),
    ("ctn", "count", "1", ("ctn", "ctns")),
    ("plt", "count", "1", ("plt", "plts")),
)
NUMBER = "decimal(38,12)"


def number(c: Column) -> Column:
    """struct(value decimal(38,12), refused string) of a printed number.

    The last separator is the decimal mark if there are two kinds; one kind repeated groups digits; a single separator
    before exactly three digits could be either, and is refused.
    """
    return _once(F.regexp_replace(c, "[\\s\u00a0]", ""), _parsed)


def _once(c: Column, use) -> Column:
    """use(c), with c evaluated once however often it is used."""
    return F.get(F.transform(F.array(c), use), 0)


def _parsed(s: Column) -> Column:
    """The number in a text without blanks, from its digits between marks: head, then the last mark and what follows it."""
    whole = s.rlike("^[+-]?[0-9]+([.,][0-9]+)*$")
    last = F.regexp_extract(s, "[.,](?=[0-9]*$)", 0)
    tail = F.substring_index(F.translate(s, ",", "."), ".", -1)
    marks = F.length(s) - F.length(F.translate(s, ".,", ""))
    same = F.length(s) - F.length(F.replace(s, last, F.lit("")))

    def known(p: Column) -> Column:
        refused = (
            F.when(s.isNull() | (s == ""), "missing").when(~p["whole"], "not_a_number").when((p["marks"] == 1) & (F.length(p["tail"]) == 3), "ambiguous")
            .when((p["marks"] > p["same"]) & (p["same"] > 1), "not_a_number")
        )
        plain = F.translate(s, ".,", "")
        cut = F.concat(F.left(plain, F.length(plain) - F.length(p["tail"])), F.lit("."), p["tail"])
        text = F.when((p["marks"] == 0) | ((p["marks"] > 1) & (p["marks"] == p["same"])), plain).otherwise(cut)
        return F.struct(F.when(refused.isNull(), text.try_cast(NUMBER)).alias("value"), refused.alias("refused"))

    return _once(F.struct(whole.alias("whole"), tail.alias("tail"), marks.alias("marks"), same.alias("same")), known)


def money(c: Column) -> Column:
    """struct(value, refused) of an amount with a currency before or behind; other characters among the digits are refused."""
    core = F.regexp_extract(c, "[0-9].*[0-9]|[0-9]", 0)
    clean = core.rlike("^[0-9.,  ]+$")
    inner = number(F.when(clean, core))
    refused = F.when(c.isNull() | (core == ""), "missing").when(~clean, "not_a_number").otherwise(inner["refused"])
    return F.struct(F.when(refused.isNull(), inner["value"]).alias("value"), refused.alias("refused"))


def _unit_map(at: int) -> Column:
    return F.create_map(*[F.lit(x) for row in UNITS for form in row[3] for x in (form, row[at])])


def factor(unit: Column) -> Column:
    """The exact factor of a unit or printed form to its base unit; null if unknown."""
    return F.try_element_at(_unit_map(2), F.lower(unit)).cast("decimal(18,12)")


def dimension(unit: Column) -> Column:
    return F.try_element_at(_unit_map(1), F.lower(unit))


def measured(c: Column, declared: Column) -> Column:
    """struct(value, unit, refused) of a printed quantity: a trailing unit counts if its dimension is the declared unit's."""
    printed = F.nullif(F.lower(F.regexp_extract(c, "([A-Za-z]+[0-9]?)\\s*$", 1)), F.lit(""))
    unit = F.when(dimension(printed) == dimension(declared), printed).otherwise(F.lower(declared))
    inner = number(F.regexp_replace(c, "[A-Za-z]+[0-9]?\\s*$", ""))
    return F.struct(inner["value"].alias("value"), unit.alias("unit"), inner["refused"].alias("refused"))


def agrees(a: Column, b: Column, kind: Column, amount: Column) -> Column:
    """Whether two base-unit values agree, inclusively; relative tolerance is of the larger magnitude."""
    gap = F.abs(a - b)
    return F.when(kind == "relative", gap <= amount * F.greatest(F.abs(a), F.abs(b))).when(kind == "absolute", gap <= amount).otherwise(gap == 0)


def tolerance_fault(kind: Column, amount: Column, unit: Column) -> Column:
    """Why a tolerance is no rule, or null: negative, absolute without a unit, relative with one, or relative of a half and more."""
    return (
        F.when(amount.isNull() | ~F.coalesce(kind.isin("relative", "absolute"), F.lit(False)), "incomplete").when(amount < 0, "negative").when((kind == "absolute") & unit.isNull(), "absolute_without_unit")
        .when((kind == "relative") & unit.isNotNull(), "relative_with_unit").when((kind == "relative") & (amount >= 0.5), "implausible")
    )
