"""Cleaning of complaint records: entities, dates, years, conclusions, document numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamiz.functions.text import cell, trim_unicode

# Letters that entity names fold, case kept.
ACCENTED = "áéíóúÁÉÍÓÚàèìòùÀÈÌÒÙñÑüÜ"
PLAIN = "aeiouAEIOUaeiouAEIOUnNuU"

# The years that are plausible.
FIRST_YEAR, LAST_YEAR = 2010, 2030


def squeeze(c: Column) -> Column:
    """Trimmed; runs of two or more ASCII spaces become one blank (a single tab stays)."""
    return F.regexp_replace(cell(c), r"[\t\n\f\r ]{2,}", " ")


def entity(c: Column) -> Column:
    """One spelling per entity: no accents, upper case, ``N° 1`` as ``N1``, no dot after a capital."""
    upper = F.upper(F.translate(cell(c), ACCENTED, PLAIN))
    ordinal = F.regexp_replace(upper, r"N[°º]?[\t\n\f\r ]*\.?[\t\n\f\r ]*([0-9])", "N$1")
    dots = F.regexp_replace(ordinal, r"([A-Z])\.", "$1")
    return trim_unicode(F.regexp_replace(dots, r"[\t\n\f\r ]{2,}", " "))


def parse_day(c: Column) -> Column:
    """A date in one of three layouts, the first that fits; null if none does."""
    v = cell(c)
    layouts = ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"), (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"))
    return F.coalesce(*[F.when(v.rlike(shape), F.try_to_timestamp(v, F.lit(layout))) for shape, layout in layouts]).cast("date")


def day(c: Column) -> Column:
    """A date as yyyy-MM-dd; empty if it has no known layout or does not exist."""
    return F.coalesce(F.date_format(parse_day(c), "yyyy-MM-dd"), F.lit(""))


def year(c: Column) -> Column:
    """A plausible year without a trailing ``.0``; else empty."""
    v = F.regexp_replace(cell(c), r"\.0$", "")
    n = F.when(v.rlike(r"^[+-]?[0-9]{1,9}$"), v.try_cast("int"))
    return F.when(n.between(FIRST_YEAR, LAST_YEAR), v).otherwise("")


def conclusion(c: Column) -> Column:
    """The first line, without leading ``>`` signs."""
    first = F.element_at(F.split(cell(c), r"[\r\n]+"), 1)
    return trim_unicode(F.regexp_replace(trim_unicode(first), r"^>+[\t\n\f\r ]*", ""))


def document_number(c: Column) -> Column:
    """What follows the first colon; the whole value if there is none."""
    v = cell(c)
    return F.when(F.contains(v, F.lit(":")), trim_unicode(F.element_at(F.split(v, ":", 2), 2))).otherwise(v)


def label(c: Column) -> Column:
    """1 or 0 from the spellings of a spam flag; blank is 0, numbers from 0.5 on are 1, anything else is an error."""
    v = F.lower(cell(c))
    number = v.try_cast("double")
    return (
        F.when(v.isin("1", "true", "t", "spam", "si", "sí", "yes"), 1)
        .when(v.isin("0", "false", "f", "no", ""), 0)
        .when(number >= 0.5, 1)
        .when(number.isNotNull(), 0)
        .otherwise(F.raise_error(F.concat(F.lit("not a binary label: "), v)).cast("int"))
    )
