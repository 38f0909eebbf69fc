"""Filters, searches and result pages over contracts and families."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.parse import money
from ledgerloom.functions.text import no_accents

TEXT_COLUMNS = ("contract_number", "entity", "contractor", "service_category", "service_type")
PAGE = 50
# Columns that pages of families, and of rows, may be sorted by.
FAMILY_SORTS = ("contract_number", "contractor", "entity", "amount", "award_date", "service_category")
ROW_SORTS = ("contract_number", "amendment", "contractor", "entity", "amount", "award_date", "valid_from", "valid_to", "service_category", "service_type", "fiscal_year")


# The signs of a keyword, and of words.
KEYWORD_SIGNS, WORD_SIGNS = "0-9A-Za-z\u00c0-\u024f", "0-9A-Z\u00c0-\u024f"


def tokens(query: str) -> list[str]:
    """The words of a keyword query, folded as the words of texts are: without accents, in capitals."""
    import re
    import unicodedata

    plain = lambda w: "".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn").upper()
    found = re.findall(f"[{KEYWORD_SIGNS}]+", unicodedata.normalize("NFC", query))
    return [t for w in found for t in re.findall(f"[{WORD_SIGNS}]+", plain(w))]


def folded(c) -> Column:
    """A text as keywords are compared with it. One of as many bytes as characters has no accents to look for."""
    text = F.coalesce(c, F.lit(""))
    return F.upper(F.when(F.octet_length(text) == F.char_length(text), text).otherwise(no_accents(text)))


def whole_text() -> Column:
    """A row's text columns as keywords are compared with them. Blanks between them are part of no word."""
    return folded(F.concat_ws(" ", *TEXT_COLUMNS))


def words() -> Column:
    """The folded words of a row's text columns, found one after another: a split would compile its pattern for each row."""
    return F.regexp_extract_all(whole_text(), F.lit(f"[{WORD_SIGNS}]+"), F.lit(0))


def keyword_prefix(query: str) -> Column:
    """Each word of the query begins some word of a text column: it stands there and no sign of a word before it. One
    pattern for all of them, so that a text is folded once."""
    ahead = "".join(f"(?=.*?{t}(?<![{WORD_SIGNS}]{t}))" for t in tokens(query))
    return F.rlike(whole_text(), F.lit(f"(?s)^{ahead}")) if ahead else F.lit(True)


def keyword_part(query: str) -> Column:
    """Each word of the query is part of a text column; accents count on neither side."""
    return reduce(lambda a, t: a & F.contains(whole_text(), F.lit(t)), tokens(query), F.lit(True))


def keyword(rows: DataFrame, query: str) -> DataFrame:
    """By word beginnings; by parts of words if no row of the table has those."""
    return filtered(rows, {"keyword": query})


def contractor_matches(term: str) -> Column:
    """With ``*`` a pattern for the whole name, else the beginning of a word."""
    c = F.col("contractor")
    return c.ilike(term.replace("*", "%")) if "*" in term else c.ilike(f"{term}%") | c.ilike(f"% {term}%")


def look_up(value: str) -> str:
    """A filter's value as look-ups compare it."""
    import unicodedata

    return unicodedata.normalize("NFC", value).strip().upper()


def exact_or_prefix(rows: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose value equals the term, or begins with it if no value of the table equals it."""
    return filtered(rows, {column: value})


def number_matches(rows: DataFrame, number: str) -> DataFrame:
    """Exact contract number if any remaining row has it, else those that begin with it."""
    key, n = F.upper("contract_number"), number.strip().upper()
    found = F.broadcast(rows.agg(F.coalesce(F.max(key == n), F.lit(False)).alias("any_exact")))  # one row
    return rows.join(found).where(F.when(F.col("any_exact"), key == n).otherwise(F.startswith(key, F.lit(n)))).drop("any_exact")


def filtered(rows: DataFrame, f: dict, table: DataFrame | None = None, index: str | None = None) -> DataFrame:
    """All given filters together; blank ones are off. Plain comparisons reach the scan. With the path of the table's
    ``index`` (``keyword_index``) a keyword is looked up there.

    Whether a keyword has any hit by word beginnings, and which value an entity or service type equals, is asked of
    the whole ``table`` (``rows`` unless given), whatever the other filters leave: one aggregation to one row, for all
    of them. Only the contract number looks at the rows that pass the others."""
    tests = {
        "amount_min": lambda v: F.col("amount") >= v, "amount_max": lambda v: F.col("amount") <= v,
        "award_from": lambda v: F.col("award_date") >= F.lit(v).cast("date"), "award_to": lambda v: F.col("award_date") <= F.lit(v).cast("date"),
        "valid_from": lambda v: F.col("valid_from") >= F.lit(v).cast("date"), "valid_to": lambda v: F.col("valid_to") <= F.lit(v).cast("date"),
        "category": lambda v: F.col("service_category") == v, "fiscal_year": lambda v: F.col("fiscal_year") == v, "contractor": contractor_matches,
    }
    given = lambda k: f.get(k) not in (None, "")
    answers, keep = [], []
    if given("keyword") and index:
        from ledgerloom.operators import keyword_index

        rows = keyword_index.keyword(rows, index, f["keyword"])
    elif given("keyword") and tokens(f["keyword"]):
        begins, part = keyword_prefix(f["keyword"]), keyword_part(f["keyword"])
        answers.append(F.coalesce(F.max(begins), F.lit(False)).alias("__hit"))
        keep.append(F.when(F.col("__hit"), begins).otherwise(part))
    for column in ("entity", "service_type"):
        if given(column) and look_up(f[column]):
            key, value = F.upper(F.trim(F.col(column))), F.lit(look_up(f[column]))
            answers.append(F.min(F.when(key == value, F.col(column))).alias(f"__{column}"))
            keep.append(F.when(F.col(f"__{column}").isNotNull(), F.col(column) == F.col(f"__{column}")).otherwise(F.startswith(key, value)))
        elif given(column):
            keep.append(F.lit(False))
    found = rows.where(reduce(lambda a, k: a & tests[k](f[k]), (k for k in tests if given(k)), F.lit(True)))
    if keep:
        facts = (rows if table is None else table).agg(*answers) if answers else None  # one row
        found = (found.join(F.broadcast(facts)) if answers else found).where(reduce(lambda a, b: a & b, keep)).select(*(F.col(f"`{c}`") for c in rows.columns))
    return number_matches(found, f["contract_number"]) if given("contract_number") else found


def page(rows: DataFrame, sort: str, direction: str = "DESC", number: int = 1, ties: tuple[str, ...] = ("id",), allowed=FAMILY_SORTS) -> DataFrame:
    """One page of 50 families, nulls last in both directions; an unknown column sorts by award date. Ties go up by
    ``ties`` in both directions."""
    sort = sort if sort in allowed else "award_date"
    by = F.asc_nulls_last(sort) if direction == "ASC" else F.desc_nulls_last(sort)
    return rows.orderBy(by, *ties).offset(PAGE * (number - 1)).limit(PAGE)


def rows_page(rows: DataFrame, sort: str, direction: str = "DESC", number: int = 1) -> DataFrame:
    """One page of 50 rows; ties go by id in the direction of the page."""
    sort = sort if sort in ROW_SORTS else "award_date"
    way, tie = (F.asc_nulls_last, F.asc) if direction == "ASC" else (F.desc_nulls_last, F.desc)
    return rows.orderBy(way(sort), tie("id")).offset(PAGE * (number - 1)).limit(PAGE)


def merged_page(families: DataFrame, sort: str, direction: str = "DESC", number: int = 1) -> DataFrame:
    """One page of the merged families of a contract-number search: text without regard to accents and case, empty
    values last in both directions, ties up by id."""
    sort = sort if sort in FAMILY_SORTS else "award_date"
    value = F.col(sort)
    if sort not in ("amount", "award_date"):
        value = F.collate(F.nullif(value, F.lit("")), "es_CI_AI")
    by = F.asc_nulls_last(value) if direction == "ASC" else F.desc_nulls_last(value)
    return families.orderBy(by, "id").offset(PAGE * (number - 1)).limit(PAGE)


class Order(NamedTuple):
    """The order of pages: a column, nulls last in both directions, then ``tie``, a column without repeats."""

    sort: str
    down: bool = True
    tie: str = "id"
    tie_down: bool = False

    def columns(self) -> list[Column]:
        return [F.desc_nulls_last(self.sort) if self.down else F.asc_nulls_last(self.sort), F.desc(self.tie) if self.tie_down else F.asc(self.tie)]

    def beyond(self, value, tie, itself: bool = False) -> Column:
        """Whether a row comes after the one with these values (or is it), as comparisons that reach the scan."""
        key, by = F.col(self.sort), F.col(self.tie)
        later = (by < tie if self.tie_down else by > tie) | (by == tie if itself else F.lit(False))
        if value is None:
            return key.isNull() & later
        return (key < F.lit(value) if self.down else key > F.lit(value)) | ((key == F.lit(value)) & later) | key.isNull()


def page_after(rows: DataFrame, order: Order, last: tuple | None = None, size: int = PAGE) -> DataFrame:
    """The page after the row with the values ``last`` (sort, tie), the first one without. It takes the least ``size``
    rows of what is left, whatever comes before: nothing is sorted as a whole or skipped."""
    return (rows.where(order.beyond(*last)) if last else rows).orderBy(*order.columns()).limit(size)


def page_starts(rows: DataFrame, order: Order, size: int = PAGE) -> DataFrame:
    """(page, value, tie) of the first row of every page, from one sort by ranges that numbers the rows; to be kept with
    the table, so that any page is found by its number."""
    from ledgerloom.operators.loading import load_ids

    placed = load_ids(rows.select(F.col(order.sort).alias("value"), F.col(order.tie).alias("tie")), Order("value", order.down, "tie", order.tie_down).columns())
    return placed.where((F.col("id") - 1) % size == 0).select(((F.col("id") - 1) / size + 1).cast("long").alias("page"), "value", "tie")


def page_at(rows: DataFrame, starts: DataFrame, number: int, order: Order, size: int = PAGE) -> DataFrame:
    """A page by its number, from where it starts."""
    first = starts.where(F.col("page") == number).first()
    if first is None:
        return rows.limit(0)
    return rows.where(order.beyond(first["value"], first["tie"], True)).orderBy(*order.columns()).limit(size)


def rows_header(rows: DataFrame) -> DataFrame:
    """Number and money of the rows found."""
    return rows.agg(F.count("*").alias("n_rows"), F.coalesce(money(F.col("amount")), F.lit(0.0)).alias("money"))


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.col(column).alias("value")).where(F.trim("value") != "").distinct()
