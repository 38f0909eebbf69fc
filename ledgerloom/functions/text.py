"""Text columns: cleaning, folding and the contractor family."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that do not tell contractors apart.
STOP_WORDS = "INC INCORPORATED LLC LLLP LLP LP LTD LIMITED CORP CORPORATION CO COMPANY PSC CSP PC SE SC US USA THE OF FOR DE DEL LA LAS LOS EL PARA Y AND ING INGENIERO".split()
# Suffixes that are split from the word before them, in this order.
GLUED_SUFFIXES = "INCORPORATED CORPORATION COMPANY LIMITED LLLP LLC LLP CORP LTD PSC CSP INC".split()
# Suffixes that may be written with spaces between their letters, in this order.
SPACED_SUFFIXES = "LLLP LLC LLP PSC CSP PC SC SE".split()
# Phrases after which a name is cut.
CUT_AFTER = (r"\bA\s+DIVISION\s+OF\b.*$", r"\bDIVISION\s+OF\b.*$", r"\bD\s*B\s*A\b.*$", r"\bA\s*K\s*A\b.*$", r"\bH\s*N\s*C\b.*$")
# Fixed value: a title before a name.
LEADING_TITLE = r"^(?:ING|INGENIERO)\b\s*"
# The white space of Unicode, as patterns have it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# The characters of the coarse key that become spaces.
COARSE_BLANKS = "\x00.,;:()/-"
# Families that are known under another name.
OVERRIDES = {
    "AUTORIDADF FINANCIAMIENTO INFRAESTRU": "AUTORIDAD FINANCIAMIENTO INFRAESTRUCTURA PUERTO RICO",
    "MAGLEZ ENGINEERINGS CONTRACTORS": "MAGLEZ ENGINEERING CONTRACTORS",
    "CONSTRUCCIONES VIVI AGREDADO": "CONSTRUCCIONES VIVI AGREGADOS",
    "CONSTRUCCIONES VIVI AGREGADO": "CONSTRUCCIONES VIVI AGREGADOS",
    "CONSTRUCCIONES VIVI AGRAGADOS": "CONSTRUCCIONES VIVI AGREGADOS",
    "BERMUDEZLONGODIAZ MASSO": "BERMUDEZ LONGO DIAZ MASSO",
    "DESING BUILD": "DESIGN BUILD",
    "JOSEPH HARRISON FLORESDBAHARISON CONSULTING": "JOSEPH HARRISON FLORES",
    "MUNICIPIO VIEQUES CCD": "MUNICIPIO VIEQUES",
    "MUNICIPIO SAN LOENZO": "MUNICIPIO SAN LORENZO",
    "AUTORIDAD FINANCIAMIENTO INFRAESTRUC": "AUTORIDAD FINANCIAMIENTO INFRAESTRUCTURA PUERTO RICO",
    "J F BUILDING LEASE MAINTENANCE": "JF BUILDING LEASE MAINTENANCE",
    "ISIDRO M MARTINEZ GILORMINI": "MARTINEZ GILORMINI ISIDRO M",
    "ADMINISTRACION COMPENSACIONES POR ACCIDENTES": "ADMINISTRACION COMPENSACIONES POR ACCIDENTES AUTOMOVILES",
    "CANCIO NADAL RIVERA": "CANCIONADAL RIVERA",
    "AQUINO CORDOVA ALFARO": "AQUINO CORDOVAALFARO",
    "RICHARD SANTOS GARCIA MA": "RICHARD SANTOS GARCIAMA",
    "UNIVERSITY PUERTO RICO PARKING SYSTEM": "UNIVERSIDA PUERTO RICO PARKING SYSTEM",
    "NAIOSCALY CRUZ PONCE": "CRUZ PONCE NAIOSCALY",
    "GIOVANY RIVERA CARRERO": "RIVERA CARRERO GIOVANY",
    "A1 GENERATOR SERVICES": "AI GENERATOR SERVICES",
    "T P CONSULTING": "QUANTUM HEALTH CONSULTING",
    "INTEGRA": "INTEGRA DESIGN GROUP",
}


def _accents() -> tuple[str, str]:
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def no_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *_accents()), r"\p{Mn}", "")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE))


def clean(c: Column) -> Column:
    """Without NULs, outer white space and quotes; null if nothing is left."""
    return F.nullif(strip(F.btrim(strip(F.replace(c, F.lit("\x00"), F.lit(""))), F.lit('"'))), F.lit(""))


def without_code(c: Column) -> Column:
    """The name of a ``code | name`` entity."""
    cleaned = clean(c)
    name = clean(F.regexp_extract(cleaned, r"(?s)^[^|]*\|(.*)$", 1))
    return F.coalesce(name, cleaned)


def split_entity(c: Column) -> Column:
    """(code, name) of a ``code | name`` entity; without a bar all of it is the name."""
    part = lambda p, k: F.nullif(strip(F.regexp_extract(c, p, k)), F.lit(""))
    bar = F.contains(c, F.lit("|"))
    code, name = F.when(bar, part(r"(?s)^([^|]*)\|(.*)$", 1)), F.when(bar, part(r"(?s)^([^|]*)\|(.*)$", 2)).otherwise(F.nullif(strip(c), F.lit("")))
    return F.struct(code.alias("code"), name.alias("name"))


def fold_entity(c: Column) -> Column:
    """An entity for look-ups, without its code."""
    return fold(without_code(c))


def fold(c: Column) -> Column:
    """For look-ups: no accents, spaces collapsed, upper case; null is empty."""
    spaced = F.regexp_replace(F.replace(no_accents(F.coalesce(c, F.lit(""))), F.lit("\x00"), F.lit(" ")), r"(?U)\s+", " ")
    return F.upper(F.trim(spaced))


def amendment_text(c: Column) -> Column:
    return strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\x00"), F.lit("")))


def is_original(c: Column, name_counts: bool = True) -> Column:
    """Whether an amendment marks the original row: blank, or (``name_counts``) the word itself."""
    return fold(amendment_text(c)).isin("", "ORIGINAL") if name_counts else F.trim(F.coalesce(c, F.lit(""))) == ""


def contractor_family(c: Column) -> Column:
    """The name under which variants of a contractor's name are one."""
    return known_family(plain_family(c))


def plain_family(c: Column) -> Column:
    """A contractor's name without what does not tell contractors apart."""
    x = F.upper(F.regexp_replace(no_accents(F.coalesce(c, F.lit(""))), r"[\x00.,;:()/\-&]", " "))
    for s in SPACED_SUFFIXES:
        x = F.regexp_replace(x, r"\b" + r"\s+".join(s) + r"\b", s)
    for s in GLUED_SUFFIXES:
        x = F.regexp_replace(x, rf"(?<=[A-Z0-9]){s}\b", f" {s}")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"\bP\s*R\b", "PUERTO RICO"), r"\s+", " "))
    for p in CUT_AFTER:
        x = F.trim(F.regexp_replace(x, p, ""))
    x = F.trim(F.regexp_replace(x, LEADING_TITLE, ""))
    return F.array_join(F.filter(F.split(x, " "), lambda w: (w != "") & ~w.isin(STOP_WORDS)), " ")


def known_family(family: Column) -> Column:
    """The name under which a family is known."""
    known = F.create_map(*(F.lit(v) for kv in OVERRIDES.items() for v in kv))
    return F.coalesce(F.try_element_at(known, family), family)


def coarse_family(c: Column) -> Column:
    """A plain key of a contractor's name for engines without the full one: punctuation to spaces, upper case, and
    double spaces made single three times over."""
    x = F.upper(F.translate(F.coalesce(c, F.lit("")), COARSE_BLANKS, " " * len(COARSE_BLANKS)))
    for _ in range(3):
        x = F.replace(x, F.lit("  "), F.lit(" "))
    return F.trim(x)


def family_spark_sql(c: str) -> str:
    """``contractor_family`` of an SQL expression, as Spark SQL."""
    a, b = _accents()
    lit = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    cut = lambda x, p, r="": f"regexp_replace({x}, {lit(p)}, {lit(r)})"
    x = f"upper({cut(cut(f'translate(coalesce({c}, {lit(chr(32) * 0)}), {lit(a)}, {lit(b)})', chr(92) + 'p{Mn}'), '[' + chr(92) + 'x00.,;:()/' + chr(92) + '-&]', ' ')})"
    for s in SPACED_SUFFIXES:
        x = cut(x, r"\b" + r"\s+".join(s) + r"\b", s)
    for s in GLUED_SUFFIXES:
        x = cut(x, rf"(?<=[A-Z0-9]){s}\b", f" {s}")
    x = f"trim({cut(cut(x, r'\bP\s*R\b', 'PUERTO RICO'), r'\s+', ' ')})"
    for p in CUT_AFTER:
        x = f"trim({cut(x, p)})"
    x = f"trim({cut(x, LEADING_TITLE)})"
    x = f"array_join(filter(split({x}, ' '), w -> w <> '' AND NOT array_contains(array({', '.join(map(lit, STOP_WORDS))}), w)), ' ')"
    known = "map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in OVERRIDES.items()) + ")"
    return f"coalesce(try_element_at({known}, {x}), {x})"


def register_functions(spark) -> None:
    """The contractor family as an SQL function of the session: ``normalize_contractor_family(name)``."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalize_contractor_family(name STRING) RETURNS STRING RETURN {family_spark_sql('name')}")


def family_sql(c: str) -> str:
    """The same in DuckDB SQL."""
    x = f"upper(regexp_replace(strip_accents(coalesce({c}, '')), '[\\x00.,;:()/\\-&]', ' ', 'g'))"
    for s in SPACED_SUFFIXES:
        x = f"regexp_replace({x}, '\\b{'\\s+'.join(s)}\\b', '{s}', 'g')"
    for s in GLUED_SUFFIXES:
        x = f"regexp_replace({x}, '([A-Z0-9]){s}\\b', '\\1 {s}', 'g')"
    x = f"trim(regexp_replace(regexp_replace({x}, '\\bP\\s*R\\b', 'PUERTO RICO', 'g'), '\\s+', ' ', 'g'))"
    for p in CUT_AFTER:
        x = f"trim(regexp_replace({x}, '{p}', ''))"
    x = f"trim(regexp_replace({x}, '{LEADING_TITLE}', ''))"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    x = f"array_to_string(list_filter(string_split({x}, ' '), lambda w: w <> '' AND NOT list_contains([{stop}], w)), ' ')"
    return f"(CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in OVERRIDES.items()) + f" ELSE {x} END)"
