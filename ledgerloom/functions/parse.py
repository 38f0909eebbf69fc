"""Columns parsed from text: amounts, dates, flags, fiscal years, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import amendment_text, fold, strip

# Spanish month abbreviations and their numbers.
MONTHS = {"ene": 1, "feb": 2, "mar": 3, "abr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dic": 12}
# Texts that stand for no date and for no amount.
NO_DATE, NO_AMOUNT = ("", "-", "N/A", "NA", "0", "0.0", "0.00"), ("", "-", "N/A", "NA")
# The formats of dates, each with the shape of its texts; of two with one shape the first that fits holds.
FORMATS = (
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", ("yyyy-MM-dd'T'HH:mm:ss",)),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", ("yyyy-M-d",)),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ("M-d-yyyy", "d-M-yyyy")),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ("M/d/yyyy", "d/M/yyyy")),
)
# Words that say yes.
YES = ("SI", "S", "YES", "Y", "1", "TRUE")
# Fixed value: a Spanish date, with its day, month and year.
SPANISH = r"^(\d{1,2})\s+([a-záéíóú.]+)\s+(\d{4})"


def amount(c: Column) -> Column:
    """A number from text such as ``$1,234.50``; null if it is none."""
    bare = strip(F.regexp_replace(c, "[$,\u00a0 ]", ""))
    number = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare)
    return F.when(~bare.isin(*NO_AMOUNT), number.try_cast("double"))


def spanish_date(c: Column) -> Column:
    """A date from text such as ``23 mar. 2022 12:00 a. m.``."""
    low = F.lower(F.trim(F.replace(c, F.lit(" "), F.lit(" "))))
    part = lambda k: F.regexp_extract(low, SPANISH, k)
    month = F.try_element_at(F.create_map(*(F.lit(v) for kv in MONTHS.items() for v in kv)), F.btrim(part(2), F.lit(".")))
    return F.when(part(1) != "", F.try_to_date(F.concat_ws("-", part(3), month.cast("string"), part(1)), "yyyy-M-d"))


def date(c: Column) -> Column:
    """A date in any of the known formats, month first before day first; null if impossible. The shape of a text says
    which formats are tried."""
    text = F.trim(F.replace(c, F.lit("\u00a0"), F.lit(" ")))
    first = F.substr(text, F.lit(1), F.lit(19))
    out = None
    for shape, formats in FORMATS:
        tries = F.coalesce(*(F.try_to_timestamp(first, F.lit(f)).cast("date") for f in formats))
        out = F.when(first.rlike(shape), tries) if out is None else out.when(first.rlike(shape), tries)
    return F.when(~text.isin(*NO_DATE), out.otherwise(spanish_date(text)))


def epoch_date(c: Column) -> Column:
    """The local date of ``/Date(milliseconds)/``; other text as a date."""
    ms = F.regexp_extract(c, r"(-?\d+)", 1)
    return F.when(c.rlike(r"^/Date\("), F.to_date(F.from_utc_timestamp(F.timestamp_millis(ms.try_cast("long")), "America/Puerto_Rico"))).otherwise(date(c))


def cancelled(c: Column) -> Column:
    return F.when(fold(c).isin(*YES), 1).otherwise(0)


def fiscal_year(d: Column) -> Column:
    """The fiscal year of a date; it starts in July."""
    y = F.year(F.add_months(d, -6))
    return F.concat(y.cast("string"), F.lit("-"), (y + 1).cast("string"))


def fiscal_year_of(start: Column) -> Column:
    """The name of the fiscal year that starts in a year."""
    return F.concat(F.lpad(start.cast("string"), 4, "0"), F.lit("-"), F.lpad((start + 1).cast("string"), 4, "0"))


def fiscal_year_start(c: Column) -> Column:
    """The year in which a fiscal year such as ``2021-2022`` starts; null for other text."""
    return F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), r"^(\d{4})-(\d{4})$", 1).try_cast("int")


def fiscal_year_key(c: Column) -> Column:
    """Orders fiscal years; text that is none comes before all of them."""
    part = lambda k: F.coalesce(F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), r"^(\d{4})-(\d{4})$", k).try_cast("int"), F.lit(-1))
    return F.struct(part(1).alias("start"), part(2).alias("end"))


def number_text(c: Column) -> Column:
    """A float as text with one decimal at least, and no exponent; 0 and null are empty."""
    text = F.regexp_replace(c.cast("string").cast("decimal(38,10)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(F.coalesce(c, F.lit(0.0)) == 0, "").otherwise(text)


def row_hash(number: Column, entity: Column, contractor: Column, amendment: Column, award_date: Column, money: Column) -> Column:
    """The content key of a record: 16 hexadecimal digits."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.substring(F.sha2(F.concat_ws("|", blank(number), blank(entity), blank(contractor), amendment_text(amendment), blank(award_date), number_text(money)), 256), 1, 16)


def money(c: Column) -> Column:
    """An exact sum of money, as a double."""
    return F.sum(c.cast("decimal(18,2)")).cast("double")
