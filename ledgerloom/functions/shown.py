"""Columns as people see them: money, dates, labels, links, notes."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Months in English.
MONTH_NAMES = "January February March April May June July August September October November December".split()
# Labels of source types and recovery states, by language.
SOURCE_LABELS = {
    "en": {"csv": "Preserved CSV", "live_monitor": "Live monitor", "live_recovery": "Live recovery"},
    "es": {"csv": "CSV preservado", "live_monitor": "Monitor en vivo", "live_recovery": "Recuperación en vivo"},
}
STATUS_LABELS = {
    "en": {"pending": "Pending", "recovered": "Recovered", "unrecoverable": "Unrecoverable", "ambiguous": "Ambiguous"},
    "es": {"pending": "Pendiente", "recovered": "Recuperado", "unrecoverable": "Irrecuperable", "ambiguous": "Ambiguo"},
}
# Named HTML entities, the one for & last.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0", "&aacute;": "á", "&eacute;": "é", "&iacute;": "í", "&oacute;": "ó", "&uacute;": "ú",
    "&Aacute;": "Á", "&Eacute;": "É", "&Iacute;": "Í", "&Oacute;": "Ó", "&Uacute;": "Ú", "&ntilde;": "ñ", "&Ntilde;": "Ñ", "&uuml;": "ü", "&Uuml;": "Ü", "&amp;": "&",
}


def money_text(c: Column) -> Column:
    """``$1,234.50``; a dash for null."""
    return F.when(c.isNull(), "-").otherwise(F.concat(F.lit("$"), F.format_number(c, 2)))


def compact_money(c: Column) -> Column:
    """``$1.2M``; a dash for null."""
    size = F.abs(c)
    out = F.when(c.isNull(), "-")
    for limit, unit, letter in ((999.95, 1.0, ""), (999_950.0, 1e3, "K"), (999_950_000.0, 1e6, "M"), (999_950_000_000.0, 1e9, "B"), (None, 1e12, "T")):
        text = F.concat(F.lit("$"), F.regexp_replace(F.format_number(F.round(c / unit, 1), 1), r"\.0$", ""), F.lit(letter))
        out = out.when(size < limit, text) if limit else out.otherwise(text)
    return out


def long_date(c: Column) -> Column:
    """``March 5, 2022`` of ``2022-03-05``, ``03-05-2022`` or ``03/05/2022``, day first only where the first part is over
    12; a dash for blank, the text itself for anything else. The month is named as it is written."""
    raw = strip(c)
    part = lambda p, k: F.regexp_extract(raw, p, k).try_cast("int")
    iso, other = r"^(\d{4})-(\d{2})-(\d{2})$", r"^(\d{2})[-/](\d{2})[-/](\d{4})$"
    one, two = part(other, 1), part(other, 2)
    swap = (one > 12) & (two <= 12)
    is_iso = raw.rlike(iso)
    year = F.when(is_iso, part(iso, 1)).otherwise(part(other, 3))
    month = F.when(is_iso, part(iso, 2)).when(swap, two).otherwise(one)
    day = F.when(is_iso, part(iso, 3)).when(swap, one).otherwise(two)
    name = F.get(F.array(*map(F.lit, MONTH_NAMES)), month - 1)
    text = F.concat(name, F.lit(" "), day.cast("string"), F.lit(", "), year.cast("string"))
    ok = (year > 0) & month.between(1, 12) & day.between(1, 31)
    return F.when(F.coalesce(raw, F.lit("")).isin("", "0.00"), "-").when(ok, text).otherwise(raw)


def truncated(c: Column, most: int = 40) -> Column:
    """The first ``most`` characters and dots; a dash for blank."""
    return F.when(F.coalesce(c, F.lit("")) == "", "-").when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def thousands(c: Column) -> Column:
    return F.format_number(F.coalesce(c, F.lit(0)), 0)


def label(c: Column, labels: dict[str, str]) -> Column:
    """The label of a code; unknown codes stay, blank ones are a dash."""
    known = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(F.coalesce(F.try_element_at(known, c), c))


def detail_url(base: str, contract_id: Column) -> Column:
    return F.concat(F.lit(f"{base}/contract/details?contractid="), contract_id.cast("string"))


def document_url(base: str, code: Column) -> Column:
    """Null without a code."""
    return F.concat(F.lit(f"{base}/contract/downloaddocument?code="), F.url_encode(F.nullif(code, F.lit(""))))


def contract_id_of(url: Column) -> Column:
    """The contract's id in a detail URL."""
    return F.nullif(F.try_parse_url(url, F.lit("QUERY"), F.lit("contractid")), F.lit(""))


def unescaped(c: Column) -> Column:
    """Text without HTML entities: numeric ones, and the named ones in ``ENTITIES``. Only those that a text holds are
    looked up, what gives an ampersand last, so that nothing is decoded twice. The text is bound to a name, so that its
    own expression is not repeated."""
    return F.get(F.transform(F.array(c), lambda x: F.when(F.contains(x, F.lit("&")), _decoded(x)).otherwise(x)), F.lit(0))


def _decoded(c: Column) -> Column:
    known = F.from_json(F.lit(json.dumps({k[1:-1]: v for k, v in ENTITIES.items()})), "map<string,string>")  # one literal
    char = lambda code: F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    number = lambda x: F.when(F.lower(F.substring(x, 2, 1)) == "x", F.conv(F.substring(x, 3, 6), 16, 10)).otherwise(F.substring(x, 2, 7)).try_cast("int")
    names = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"), F.lit(1)))
    pairs = F.transform(names, lambda x: F.struct(x.alias("name"), F.when(F.startswith(x, F.lit("#")), char(number(x))).otherwise(F.try_element_at(known, x)).alias("text")))
    ordered = F.concat(F.filter(pairs, lambda p: p["text"] != "&"), F.filter(pairs, lambda p: p["text"] == "&"))
    return F.aggregate(ordered, c, lambda text, p: F.replace(text, F.concat(F.lit("&"), p["name"], F.lit(";")), p["text"]))


def note(*parts: Column) -> Column:
    """The parts that are not blank, joined by semicolons."""
    return F.concat_ws("; ", *(F.nullif(p, F.lit("")) for p in parts))


def equal_if_present(a: Column, b: Column) -> Column:
    """Equal, or one of both absent."""
    blank = lambda c: c.isNull() | (c.cast("string") == "")
    return blank(a) | blank(b) | F.coalesce(a == b, F.lit(False))


def equal_or_zero(a: Column, b: Column) -> Column:
    """Equal, where absent is 0."""
    return F.coalesce(a, F.lit(0.0)) == F.coalesce(b, F.lit(0.0))
