"""Records from a live register: search results as JSON, detail pages as HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import parse, shown, text
from ledgerloom.sources.contracts import canonical

# The search result's fields, as the register names them.
SEARCH_ROW = (
    "EntityId int, EntityName string, ContractId bigint, ContractNumber string, Amendment string, DateOfGrant string, EffectiveDateFrom string, "
    "EffectiveDateTo string, Service string, ServiceGroup string, CancellationDate string, AmountToPay double, AmountToReceive double, "
    "HasAmendments boolean, DocumentWithoutSocialSecurityId string, Contractors array<struct<Name: string>>"
)
SEARCH_PAGE = f"draw int, recordsTotal int, recordsFiltered int, data array<struct<{', '.join(': '.join(f.strip().split(' ', 1)) for f in SEARCH_ROW.split(', '))}>>"
# The ids of a detail page's fields and the canonical columns they give.
DETAIL_FIELDS = {
    "ContractNumber": "contract_number", "Amendment": "amendment", "ServiceGroup": "service_category", "Service": "service_type", "Amount": "amount",
    "AmountToReceive": "amount_receivable", "DateOfGrant": "award_date", "EffectiveDateFrom": "valid_from", "EffectiveDateTo": "valid_to",
    "ContractingForm": "procurement_method", "Fund": "fund_type", "PcONumber": "pco_number",
}
ENTITY_FIELD, CONTRACTORS_HEADING = "EntityName", "Contratista"


def search_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all search-result files under ``path``."""
    return spark.read.schema(SEARCH_PAGE).option("multiLine", True).json(path).select(F.explode("data").alias("row")).select("row.*")


def contractor_names(names: Column) -> Column:
    """The names of a search row's contractors that are not blank, without HTML entities."""
    return F.transform(F.filter(F.transform(F.coalesce(names, F.array().cast("array<struct<Name: string>>")), lambda x: x["Name"]), lambda x: F.coalesce(x, F.lit("")) != ""), shown.unescaped)


def search_records(rows: DataFrame, base_url: str, source_type: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical records of search rows: the first contractor, local dates, links; cancelled where a cancellation date
    is given. ``keep``: further columns to carry along."""
    day = lambda c: F.date_format(parse.epoch_date(F.col(c)), "yyyy-MM-dd")
    raw = rows.select(
        *keep,
        F.col("ContractNumber").alias("contract_number"), F.col("EntityName").alias("entity"), F.col("EntityId").cast("string").alias("entity_number"),
        F.get(contractor_names(F.col("Contractors")), F.lit(0)).alias("contractor"), F.col("Amendment").alias("amendment"),
        F.col("ServiceGroup").alias("service_category"), F.col("Service").alias("service_type"),
        F.col("AmountToPay").cast("string").alias("amount"), F.col("AmountToReceive").cast("string").alias("amount_receivable"),
        day("DateOfGrant").alias("award_date"), day("EffectiveDateFrom").alias("valid_from"), day("EffectiveDateTo").alias("valid_to"),
        *(F.lit(None).cast("string").alias(c) for c in ("procurement_method", "fund_type", "pco_number")),
        F.when(F.coalesce("CancellationDate", F.lit("")) != "", "1").otherwise("0").alias("cancelled"),
        shown.document_url(base_url, F.col("DocumentWithoutSocialSecurityId")).alias("document_url"),
        shown.detail_url(base_url, F.col("ContractId")).alias("source_url"), F.col("ContractId").cast("string").alias("source_contract_id"),
    )
    return canonical(held(raw), source_type, keep)


def held(df: DataFrame) -> DataFrame:
    """The same rows behind a generator: what follows reads the columns and does not repeat how they are made, which
    would make plans of nested patterns very large."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def bare(html: Column) -> Column:
    """The text of a piece of HTML."""
    return F.trim(F.regexp_replace(shown.unescaped(F.regexp_replace(html, r"(?s)<[^>]*>", " ")), r"(?U)\s+", " "))


#: A tag with its attributes, the id among them (in any quotes or none), and the value.
TAG = r"""(?s)^((?:[^>"']|"[^"]*"|'[^']*')*>)"""
ID = r"""(?is)^[^>]*?\sid\s*=\s*["']?([^"'\s>]+)"""
VALUE = r"""(?is)^(?:[^>"']|"[^"]*"|'[^']*')*?\svalue\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def elements(html: Column, names: tuple[str, ...]) -> Column:
    """A map of the elements with the ids ``names``, the first of each: (text, open). The text is the value attribute,
    else what the element holds, null if that is blank; ``open`` ones hold an element with an id of its own. The page is
    cut once, before each tag with an id, and each step over the pieces binds what the next one reads."""
    found = F.transform(F.split(html, r"(?is)<(?=\w+\b[^>]*\sid\s*=)"), lambda p: F.struct(F.regexp_extract(p, ID, 1).alias("id"), p.alias("piece")))
    found = F.transform(F.filter(found, lambda e: e["id"].isin(*names)), lambda e: F.struct(e["id"].alias("id"), e["piece"].alias("piece"), F.regexp_extract(e["piece"], TAG, 1).alias("tag")))
    close = lambda e: F.instr(F.lower(e["piece"]), F.concat(F.lit("</"), F.lower(F.regexp_extract(e["tag"], r"^(\w+)", 1))))
    found = F.transform(found, lambda e: F.struct(e["id"].alias("id"), e["piece"].alias("piece"), F.length(e["tag"]).alias("size"), F.regexp_extract(e["tag"], VALUE, 1).alias("value"), close(e).alias("close")))
    quoted = lambda v: F.when(F.substring(v, 1, 1).isin('"', "'"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    inside = lambda e: F.nullif(bare(F.substring(e["piece"], e["size"] + 1, e["close"] - e["size"] - 1)), F.lit(""))
    given = lambda e: F.when(e["value"] != "", shown.unescaped(quoted(e["value"]))).when(e["close"] > 0, inside(e))
    found = F.transform(found, lambda e: F.struct(e["id"].alias("id"), F.struct(given(e).alias("text"), ((e["value"] == "") & (e["close"] == 0)).alias("open")).alias("e")))
    first = F.aggregate(found, F.filter(found, lambda e: F.lit(False)), lambda have, e: F.when(F.exists(have, lambda x: x["id"] == e["id"]), have).otherwise(F.array_append(have, e)))
    return F.map_from_entries(first)


def field(html: Column, found: Column, name: str) -> Column:
    """The text of the element with an id; null if there is none. An open element is looked up in the whole page."""
    one = F.try_element_at(found, F.lit(name))
    whole = rf"(?is)<(\w+)\b(?=[^>]*\sid\s*=\s*[\"']?{name}[\"'\s>])[^>]*>(.*?)</\1\s*>"
    return F.when(one["open"], F.nullif(bare(F.regexp_extract(html, whole, 2)), F.lit(""))).otherwise(one["text"])


def table_names(html: Column, heading: str = CONTRACTORS_HEADING) -> Column:
    """The first cell of each row of the first table after the first heading of this text; accents, case and tags inside
    the heading do not count. None if that table has no body."""
    cut = F.split(html, r"(?i)(?=<h[4-6]\b)")
    titles = F.transform(cut, lambda p: text.fold(bare(F.regexp_extract(p, r"(?is)^<h([4-6])\b[^>]*>(.*?)</h\1\s*>", 2))))
    place = F.array_position(titles, text.fold(F.lit(heading)))
    rest = F.when(place > 0, F.array_join(F.slice(cut, F.greatest(place, F.lit(1)).cast("int"), F.size(cut)), ""))
    body = F.regexp_extract(F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?is)<table\b[^>]*>(.*?)</table\s*>", 1), r"(?is)<tbody\b[^>]*>(.*?)</tbody\s*>", 1)
    return F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<tr\b[^>]*>\s*<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1)), lambda c: shown.unescaped(bare(c)))


def detail_records(pages: DataFrame, source_type: str = "live_recovery", keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical records of detail pages (url, html) with all contractor names and the entity as it is shown. A page is
    cut at its elements with ids once; the fields are then read from short pieces."""
    html = F.col("html")
    cut = held(pages.select(*keep, F.col("url").alias("source_url"), "html", elements(html, (ENTITY_FIELD, *DETAIL_FIELDS)).alias("__found"), table_names(html).alias("contractor_names")))
    found = F.col("__found")
    parts = cut.select(*keep, "source_url", field(html, found, ENTITY_FIELD).alias("entity_display"), "contractor_names", *(field(html, found, k).alias(v) for k, v in DETAIL_FIELDS.items()))
    entity, parts = text.split_entity(F.col("entity_display")), held(parts)
    raw = parts.withColumns({
        "entity": entity["name"], "entity_number": entity["code"], "contractor": F.get("contractor_names", F.lit(0)), "cancelled": F.lit("0"),
        "document_url": F.lit(None).cast("string"), "source_contract_id": shown.contract_id_of(F.col("source_url")),
    })
    return canonical(held(raw), source_type, (*keep, "contractor_names", "entity_display"))


def page_fields(pages: DataFrame) -> DataFrame:
    """Title, first heading and number of links of any table of web pages."""
    html = F.col("html")
    return pages.select("page_id", F.nullif(bare(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")).alias("title"), F.nullif(bare(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)), F.lit("")).alias("heading"), F.regexp_count(html, F.lit("(?i)<a ")).alias("links"))
