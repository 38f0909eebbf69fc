"""Contract records: from the given tables, and from yearly CSV exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import parse, text
from ledgerloom.session import many_parts, table

# The headers under which exports give each column, in order of preference.
ALIASES = {
    "contract_number": ["Núm. Contrato", "Num. Contrato", "Número de Contrato", "Numero de Contrato", "Numero Contrato", "NumContrato"],
    "entity": ["Entidad", "Entidad Gubernamental"],
    "entity_number": ["Número de Entidad", "Numero de Entidad"],
    "contractor": ["Contratista"],
    "amendment": ["Enmienda"],
    "service_category": ["Categoría de Servicio", "Categoria de Servicio", "Categoria"],
    "service_type": ["Tipo de Servicio"],
    "amount": ["Cuantía", "Cuantia", "Monto"],
    "amount_receivable": ["Cuantía a Recibir", "Cuantia a Recibir"],
    "award_date": ["Otorgado en", "Fecha de Otorgamiento", "Fecha Otorgamiento"],
    "valid_from": ["Vigencia Desde", "Fecha Vigencia Desde", "Inicio Vigencia"],
    "valid_to": ["Vigencia Hasta", "Fecha Vigencia Hasta", "Fin Vigencia"],
    "procurement_method": ["Forma de Contratación", "Forma de Contratacion"],
    "fund_type": ["Fondo"],
    "pco_number": ["Número PCo", "Numero PCo", "PCo"],
    "cancelled": ["Cancelado"],
    "document_url": ["Documento", "URL Documento", "Enlace Documento"],
}


#: Endings given to the customers' names, by line number.
SUFFIXES = (", INC.", " LLC", " L.L.C.", " Corp.", "")


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contracts of the given tables, with the contractor family stored once. Customers meet their orders, and parts
    their lines, before both meet. No table that grows is broadcast where a task's share would be large: rows are dealt
    into as many partitions as the files need."""
    l, o, c, n, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "part"))  # noqa: E741
    parts = many_parts(l, o, c, p)
    deal = lambda df, key: df.repartition(parts, key).hint("merge") if parts else df
    # names are normalised once for each customer and suffix, not once for each row, and in many
    # tasks, where their file alone would give few
    c = c.repartition(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    c = c.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", F.transform(F.transform(F.array(*map(F.lit, SUFFIXES)), lambda s: text.plain_family(F.concat("c_name", s))), text.known_family).alias("families"))
    o = deal(o, "o_custkey").join(c.hint("merge") if parts else c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    l = deal(l, "l_partkey").join(deal(p, "p_partkey"), F.col("p_partkey") == F.col("l_partkey"))  # noqa: E741
    rows = deal(l, "l_orderkey").join(deal(o, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    of_line = lambda values: F.coalesce(F.get(values, F.col("l_linenumber") % 5), F.get(values, F.lit(4)))
    rows = rows.withColumns({"contractor": F.concat("c_name", of_line(F.array(*map(F.lit, SUFFIXES)))), "family": of_line(F.col("families"))})
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    line, ship = F.col("l_linenumber"), F.col("l_shipdate").cast("date")
    return rows.select(
        (F.col("l_orderkey") * 100 + F.row_number().over(at)).alias("id"),
        F.concat(F.year("o_orderdate").cast("string"), F.lit("-"), F.lpad(F.col("l_orderkey").cast("string"), 6, "0")).alias("contract_number"),
        F.col("n_name").alias("entity"),
        F.col("c_nationkey").cast("string").alias("entity_number"),
        "contractor",
        F.when(line == 1, "").when((line == 7) & (F.col("l_orderkey") % 10 == 0), "ORIGINAL").otherwise(F.substr(F.lit("ABCDEF"), line - 1, F.lit(1))).alias("amendment"),
        F.col("p_type").alias("service_category"),
        F.col("p_name").alias("service_type"),
        F.col("l_extendedprice").alias("amount"),
        F.lit(0.0).alias("amount_receivable"),
        ship.alias("award_date"),
        ship.alias("valid_from"),
        F.date_add(ship, 90).alias("valid_to"),
        F.col("o_orderpriority").alias("procurement_method"),
        F.col("c_mktsegment").alias("fund_type"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("cancelled"),
        parse.fiscal_year(ship).alias("fiscal_year"),
        F.lit("csv").alias("source_type"),
        "family",
    )


def resolve_headers(df: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """The canonical columns of an export, by the first alias among its headers; missing ones are blank. ``rows``: the
    export with its file and position (__file, __pos), which then come along."""
    have = {h.strip().lstrip("\ufeff").lower(): h for h in reversed(df.columns)}
    pick = {c: next((have[a.lower()] for a in aliases if a.lower() in have), None) for c, aliases in ALIASES.items()}
    columns = [F.col(f"`{h}`").alias(c) if h else F.lit("").alias(c) for c, h in pick.items()]
    return df.select(*columns) if rows is None else rows.select(*columns, F.col("__file").alias("file"), F.col("__pos").alias("pos"))


# Fixed value: the name of a yearly export.
EXPORT_NAME = r"^contratos_(\d{4}-\d{4})\.csv$"
# The columns of a canonical record, and of a file of recovery targets.
RECORD = ("contract_number", "entity", "entity_number", "contractor", "amendment", "service_category", "service_type", "amount", "amount_receivable", "award_date", "valid_from", "valid_to", "procurement_method", "fund_type", "pco_number", "cancelled", "document_url", "fiscal_year", "source_type", "source_url", "source_contract_id")
TARGET = ("contract_number", "entity", "contractor", "recovery_batch", "lookup_mode", "source_url", "status", "notes", "last_checked_at")
DATES = ("award_date", "valid_from", "valid_to")


def year_of_name(name: Column) -> Column:
    """The fiscal year in a file's name: its first part of nine characters with a dash, else the name without ending."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.coalesce(F.get(F.filter(F.split(stem, "_"), lambda x: (F.length(x) == 9) & x.contains("-")), F.lit(0)), stem)


def read_exports(spark: SparkSession, paths: list[str], encoding: str = "UTF-8", multiline: bool = True) -> DataFrame:
    """Yearly exports of one encoding and one header, as text columns in load order (file, pos), in one plan; the fiscal
    year comes from the file name. Without fields of several lines, large files are read in pieces."""
    df = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"').option("encoding", encoding).csv(paths)
    at = df.select("*", F.col("_metadata.file_name").alias("__file"), F.monotonically_increasing_id().alias("__pos"))
    return resolve_headers(df, at).withColumn("fiscal_year", year_of_name(F.col("file")))


def export_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, utf8, header, multiline) of each file that has a line: whether it is read as UTF-8 or as Latin-1, its
    first line, and whether fields go over several lines. Files are read once, by lines and in pieces; their bytes are
    judged as they are, and a line break is no part of a longer character."""
    at = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_name", "file_block_start")]
    lines = spark.read.option("pathGlobFilter", "*.csv").text(folder).select("value", *at, F.monotonically_increasing_id().alias("place"))
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    got = lines.groupBy(F.col("file_path").alias("path"), F.col("file_name").alias("name")).agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.min_by(F.col("value").cast("binary"), F.struct("file_block_start", "place")).alias("line"), F.bool_or(quotes % 2 == 1).alias("multiline"),
    )
    return got.select("path", "name", "utf8", F.when(F.col("utf8"), F.col("line").cast("string")).otherwise(F.decode("line", "ISO-8859-1")).alias("header"), "multiline")


def utf8_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, utf8) of each file: whether it must be read as UTF-8 or as Latin-1."""
    return export_files(spark, folder).select("path", "name", "utf8")


def export_years(files: DataFrame) -> DataFrame:
    """The fiscal years of the exports among files (name), newest first."""
    year = F.regexp_extract("name", EXPORT_NAME, 1)
    return files.select(year.alias("fiscal_year")).where("fiscal_year <> ''").distinct().orderBy(F.desc("fiscal_year"))


def load_folder(spark: SparkSession, folder: str, recovered: str | None = None) -> DataFrame:
    """All exports of a folder in the encoding and with the header that each has, as canonical records, then the
    recovered rows. Files that agree in both are one plan, however many they are; an empty folder has no records."""
    layouts: dict[tuple, list[str]] = {}
    for r in export_files(spark, folder).orderBy("name").collect():  # a row for each file
        layouts.setdefault((r["utf8"], r["header"], r["multiline"]), []).append(r["path"])
    raw = [read_exports(spark, paths, "UTF-8" if utf8 else "ISO-8859-1", multiline) for (utf8, _, multiline), paths in layouts.items()]
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in ALIASES) + ", file string, pos long, fiscal_year string")
    rows = canonical(reduce(DataFrame.unionByName, raw, none), "csv", ("file", "pos")).withColumn("source_rank", F.lit(0))
    if recovered:
        more = canonical(read_recovered(spark, recovered), "live_recovery", ("file", "pos")).withColumn("source_rank", F.lit(1))
        rows = rows.unionByName(more)
    return rows


def by_header(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """Columns of a CSV file as text, found by their headers; those it lacks are null, and a missing file has no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in names))
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = {c.strip().lstrip("\ufeff"): c for c in reversed(df.columns)}
    return df.select(*(F.col(f"`{have[c]}`").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in names))


def read_recovered(spark: SparkSession, path: str) -> DataFrame:
    """Recovered records as text, by header; a missing file has none."""
    return by_header(spark, path, RECORD).withColumns({"file": F.lit(path.rstrip("/").rsplit("/", 1)[-1]), "pos": F.monotonically_increasing_id()})


def write_recovered(rows: DataFrame, path: str) -> None:
    """Recovered records as CSV, sorted; blanks for nulls."""
    order = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("contract_number", "entity", "award_date", "source_contract_id", "contractor")]
    rows.select(*RECORD).orderBy(*order).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_targets(spark: SparkSession, path: str, blank_status: str | None = "pending") -> DataFrame:
    """Recovery targets in file order (position), by header: blanks are null, a blank status is ``blank_status``; a
    missing file has none. Those who publish read with None, so that targets without a status are not taken for pending."""
    df = by_header(spark, path, TARGET)
    value = lambda c: text.strip(F.coalesce(F.col(c), F.lit("")))
    plain = ("contract_number", "entity", "contractor", "lookup_mode")
    null = lambda c: F.nullif(value(c), F.lit(""))
    return df.select(*((value(c) if c in plain else F.coalesce(null(c), F.lit(blank_status)) if c == "status" else null(c)).alias(c) for c in TARGET), F.monotonically_increasing_id().alias("position"))


def write_targets(ordered: DataFrame, path: str) -> None:
    """Recovery targets as CSV in the order given."""
    ordered.select(*TARGET).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark can list the path."""
    from pyspark.errors import AnalysisException

    try:
        return not spark.read.format("binaryFile").load(path).limit(0).isStreaming
    except AnalysisException:
        return False


def canonical(raw: DataFrame, source_type: str = "csv", keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical records of text columns: cleaned, typed, with the content hash. A record's own source type stays;
    ``keep``: further columns to carry along. The dates are read by one function over an array: with them, the step is
    generated in pieces that the JVM compiles, and not as one method too long for that."""
    given = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    r = raw.select(
        *keep,
        *(text.clean(given(c)).alias(c) for c in ("contract_number", "entity_number", "contractor", "service_category", "service_type", "procurement_method", "fund_type", "pco_number", "document_url", "source_url", "source_contract_id")),
        text.without_code(F.col("entity")).alias("entity"),
        text.amendment_text(F.col("amendment")).alias("amendment"),
        *(parse.amount(F.col(c)).alias(c) for c in ("amount", "amount_receivable")),
        F.transform(F.array(*DATES), parse.date).alias("dates"),
        parse.cancelled(F.col("cancelled")).alias("cancelled"),
        text.clean(given("fiscal_year")).alias("given_year"), text.clean(given("source_type")).alias("given_type"),
    )
    r = r.withColumns({c: F.get("dates", F.lit(k)) for k, c in enumerate(DATES)})
    return r.withColumns({
        "fiscal_year": F.coalesce("given_year", parse.fiscal_year(F.col("award_date"))),
        "source_type": F.coalesce("given_type", F.lit(source_type)),
        "row_hash": parse.row_hash(*(F.col(c) for c in ("contract_number", "entity", "contractor", "amendment", "award_date", "amount"))),
    }).drop("given_year", "given_type", "dates")


def raw_text(rows: DataFrame) -> DataFrame:
    """Contracts written as an export writes them: four styles of dates, dollar amounts, entity codes."""
    month = F.get(F.array(*(F.lit(m) for m in ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic"))), F.month("award_date") - 1)
    style = F.col("id") % 4
    shown = F.when(style == 0, F.date_format("award_date", "yyyy-MM-dd")).when(style == 1, F.date_format("award_date", "MM-dd-yyyy")).when(style == 2, F.date_format("award_date", "MM/dd/yyyy")).otherwise(F.concat_ws(" ", F.dayofmonth("award_date").cast("string"), F.concat(month, F.lit(".")), F.year("award_date").cast("string"), F.lit("12:00 a. m.")))
    return rows.select(
        *(F.col(c) for c in ("id", "contract_number", "entity_number", "amendment", "service_category", "service_type", "procurement_method", "fund_type")),
        F.concat_ws(" | ", "entity_number", "entity").alias("entity"),
        F.concat(F.lit('  "'), "contractor", F.lit('" ')).alias("contractor"),
        F.concat(F.lit("$"), F.format_number("amount", 2)).alias("amount"),
        F.lit("N/A").alias("amount_receivable"),
        *(shown.alias(c) for c in ("award_date", "valid_from", "valid_to")),
        F.when(F.col("cancelled") == 1, "Sí").otherwise("No").alias("cancelled"),
        F.lit(None).cast("string").alias("pco_number"),
        F.lit(" ").alias("document_url"),
    )
