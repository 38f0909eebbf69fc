"""Values that the register must give, on small literal tables."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import parse, shown, text
from ledgerloom.operators import families, loading, recovery, resolution, search
from ledgerloom.sources import contracts as sources
from ledgerloom.sources import live
from ledgerloom.streaming.intake import monitor, run_digest

# Pairs of names of one contractor.
PAIRS = [
    ("IEMES PSC", "IEMES, PSC"),
    ("Nova Bus a Division of Prevost Car US Inc.", "NOVA BUS US INC."),
    ("CSA ARCHITECTS & ENGINEERSLLP", "CSA ARCHITECTS & ENGINEERS LLP"),
    ("AECOM Caribe L.L.P.", "AECOM CARIBE LLP"),
    ("RICOH PUERTO RICOINC", "RICOH PUERTO RICO INC."),
    ("ING. JOSÉ HERNÁNDEZ COLÓN", "JOSÉ HERNÁNDEZ COLÓN"),
    ("C & D INGENIEROS CSP", "C&D INGENIEROS"),
    ("JOY RAMIREZ GONZALEZ H/N/C RAMZ CONTRACTOR SERVICE", "JOY RAMIREZ GONZALEZ"),
    ("FOUNDATION FOR PUERTO RICO INC.", "FOUNDATION OF PUERTO RICO INC."),
    ("Autoridadf para el financiamiento de la infraestru", "AUTORIDAD PARA EL FINANCIAMIENTO DE LA INFRAESTRUCTURA DE PUERTO RICO"),
    ("Maglez Engineering & Contractors Corp.", "MAGLEZ ENGINEERINGS & CONTRACTORS CORPORATION"),
    ("CONSTRUCCIONES DEL VIVI Y AGREDADO CORP.", "CONSTRUCCIONES DEL VIVI Y AGREGADOS CORP."),
    ("BERMUDEZLONGODIAZ-MASSOLLC", "BERMUDEZ LONGO DIAZ-MASSO LLC"),
    ("Desing Build LLC", "DESIGN BUILD LLC"),
    ("JOSEPH HARRISON FLORESDBAHARISON CONSULTING", "JOSEPH HARRISON FLORES"),
    ("MUNICIPIO DE VIEQUES CCD", "MUNICIPIO DE VIEQUES"),
    ("MUNICIPIO DE SAN LOENZO", "MUNICIPIO DE SAN LORENZO"),
    ("AUTORIDAD PARA EL FINANCIAMIENTO DE LA INFRAESTRUC", "AUTORIDAD PARA EL FINANCIAMIENTO DE LA INFRAESTRUCTURA DE PUERTO RICO"),
    ("JF BUILDING LEASE & MAINTENANCE CORP", "J.F. BUILDING LEASE AND MAINTENANCE CORP"),
    ("ISIDRO M. MARTINEZ GILORMINI", "MARTINEZ GILORMINI ISIDRO M"),
    ("LA ADMINISTRACION DE COMPENSACIONES POR ACCIDENTES", "ADMINISTRACIÓN DE COMPENSACIONES POR ACCIDENTES DE AUTOMÓVILES"),
    ("CANCIO NADAL & RIVERA LLC", "CANCIONADAL & RIVERA LLC"),
    ("AQUINO DE CORDOVA ALFARO & CO. LLP.", "Aquino de CordovaAlfaro & Co. LLP"),
    ("RICHARD SANTOS GARCIA MA", "Richard Santos GarciaMA"),
    ("UNIVERSITY OF PUERTO RICO PARKING SYSTEM INC.", "UNIVERSIDA OF PUERTO RICO PARKING SYSTEM INC"),
    ("NAIOSCALY CRUZ PONCE", "CRUZ PONCE NAIOSCALY"),
    ("GIOVANY RIVERA CARRERO", "RIVERA CARRERO GIOVANY"),
    ("A1 GENERATOR SERVICES INC.", "AI GENERATOR SERVICES INC."),
    ("T & P CONSULTING INC.", "QUANTUM HEALTH CONSULTING"),
    ("T & P CONSULTING INC. D/B/A QUANTUM HEALTH CONSUL", "QUANTUM HEALTH CONSULTING"),
    ("INTEGRA", "INTEGRA DESIGN GROUP. PSC"),
]
BASE = "https://register.example"


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_contractor_families(spark):
    text.register_functions(spark)
    pairs = spark.createDataFrame([*PAIRS, ("DEPARTAMENTO DE EDUCACIÓN DE PUERTO RICO", "AUTORIDAD DE EDIFICIOS PUBLICOS")], "a string, b string")
    pairs.createOrReplaceTempView("name_pairs")
    native = pairs.select(*(text.contractor_family(F.col(c)).alias(c) for c in "ab")).collect()
    assert [r["a"] == r["b"] for r in native] == [True] * 31 + [False] and all(r["a"] for r in native)
    assert native == spark.sql("SELECT normalize_contractor_family(a) a, normalize_contractor_family(b) b FROM name_pairs").collect()


def test_dates_amounts_and_keys(spark):
    cases = {
        "23 mar. 2022": "2022-03-23", "31 mar. 2022 04:38 p. m.": "2022-03-31", "03-05-2022": "2022-03-05", "25-12-2022": "2022-12-25", "3/5/2022": "2022-03-05",
        "25/12/2022": "2022-12-25", "2022-03-05T10:00:00.123": "2022-03-05", "2022-03-05": "2022-03-05", "0.00": None, "N/A": None, "": None, "2022-02-31": None, "soon": None, " 5 sept 2021": "2021-09-05",
    }
    got = dict(one(spark, [(k,) for k in cases], "t string", "t", parse.date(F.col("t")).cast("string")))
    assert got == cases
    money = {"$1,234.50": 1234.5, "\t12 ": 12.0, "-": None, "N/A": None, "1_000": None, "(5)": None, "1e3": 1000.0, " 7": 7.0}
    assert dict(one(spark, [(k,) for k in money], "t string", "t", parse.amount(F.col("t")))) == money
    assert one(spark, [("/Date(1647993600000)/",), ("23 mar. 2022",), (None,)], "t string", parse.epoch_date(F.col("t")).cast("string")) == [("2022-03-22",), ("2022-03-23",), (None,)]
    years = one(spark, [("2022-03-23",), ("2022-07-01",)], "d string", parse.fiscal_year(F.col("d").cast("date")))
    assert years == [("2021-2022",), ("2022-2023",)]
    assert one(spark, [("2021-2022",), ("old",), (None,)], "y string", parse.fiscal_year_key(F.col("y"))) == [((2021, 2022),), ((-1, -1),), ((-1, -1),)]
    assert one(spark, [("",), ("   ",), ("Original",), ("A",), (None,), ("\x00",)], "a string", text.is_original(F.col("a"))) == [(True,), (True,), (True,), (False,), (True,), (True,)]


def test_shown_values(spark):
    got = one(spark, [(1234.5,), (None,), (999_999.0,), (0.0,), (2_550_000_000.0,)], "x double", shown.money_text(F.col("x")), shown.compact_money(F.col("x")))
    assert got == [("$1,234.50", "$1.2K"), ("-", "-"), ("$999,999.00", "$1M"), ("$0.00", "$0"), ("$2,550,000,000.00", "$2.6B")]
    days = {"2022-03-05": "March 5, 2022", "03-05-2022": "March 5, 2022", "25/12/2022": "December 25, 2022", "": "-", "0.00": "-", "2022-13-01": "2022-13-01", "later": "later"}
    assert dict(one(spark, [(k,) for k in days], "t string", "t", shown.long_date(F.col("t")))) == days
    named = {"A &amp; B": "A & B", "Jos&#233; &#xD1;u&ntilde;ez": "José Ñuñez", "&amp;lt;": "&lt;", "plain": "plain"}
    assert dict(one(spark, [(k,) for k in named], "t string", "t", shown.unescaped(F.col("t")))) == named
    urls = one(spark, [(7, "a b"), (8, None)], "i int, c string", shown.detail_url(BASE, F.col("i")), shown.document_url(BASE, F.col("c")), shown.contract_id_of(shown.detail_url(BASE, F.col("i"))))
    assert urls == [(f"{BASE}/contract/details?contractid=7", f"{BASE}/contract/downloaddocument?code=a+b", "7"), (f"{BASE}/contract/details?contractid=8", None, "8")]
    labels = one(spark, [("csv",), ("new",), (None,)], "s string", shown.label(F.col("s"), shown.SOURCE_LABELS["en"]))
    assert labels == [("Preserved CSV",), ("new",), ("-",)]
    assert one(spark, [("3136 | Autoridad",), ("Sola",), (" | x",), (None,)], "e string", text.split_entity(F.col("e"))) == [(("3136", "Autoridad"),), ((None, "Sola"),), ((None, "x"),), ((None, None),)]
    assert one(spark, [(None, 1.0), (0.0, None), (2.0, 2.0), (1.0, 2.0)], "a double, b double", shown.equal_if_present(F.col("a"), F.col("b")), shown.equal_or_zero(F.col("a"), F.col("b"))) == [(True, False), (True, True), (True, True), (False, False)]


CONTRACT = "id long, contract_number string, entity string, contractor string, amendment string, service_category string, service_type string, amount double, award_date date, valid_from date, valid_to date, fiscal_year string"


def rows_of(spark, rows):
    df = spark.createDataFrame([(*r[:6], "t", r[6], None, None, None, "2020-2021") for r in rows], CONTRACT.replace("award_date date", "award_text string"))
    df = df.withColumn("award_date", F.lit("2020-09-01").cast("date"))
    none = {c: F.lit(None).cast("string") for c in ("procurement_method", "fund_type")}
    return df.withColumns(none | {"cancelled": F.lit(0), "family": text.contractor_family(F.col("contractor"))})


def test_filters_look_at_the_whole_table(spark):
    rows = rows_of(spark, [(1, "N1", "ALPHA", "Firm", "", "cat", 10.0), (2, "N2", "ALPHA BETA", "Firm", "", "cat", 99.0), (3, "N3", "OMEGA", "Contract", "", "cat", 5.0)])
    ids = lambda f: sorted(r["id"] for r in search.filtered(rows, f).collect())
    assert ids({"amount_min": 50, "entity": "alpha"}) == [] and ids({"entity": "alpha"}) == [1] and ids({"entity": "alp"}) == [1, 2] and ids({"entity": "zeta"}) == []
    assert ids({"keyword": "con", "entity": "alpha"}) == [] and ids({"keyword": "irm"}) == [1, 2] and ids({"keyword": "  "}) == [1, 2, 3]
    assert ids({"contract_number": "n1"}) == [1] and ids({"contract_number": "n"}) == [1, 2, 3] and ids({"contract_number": "n1", "amount_min": 50}) == []
    assert [r["id"] for r in search.rows_page(rows, "award_date").collect()] == [3, 2, 1] and [r["id"] for r in search.rows_page(rows, "award_date", "ASC").collect()] == [1, 2, 3]


def test_merged_families(spark):
    rows = rows_of(spark, [(1, "N1", "E", "Ácme", "B", "c", 1.0), (2, "N1", "E", "Acme", "A", "c", 2.0), (3, None, "E", "Zeta", "", "c", None), (4, "", "E", "ZETA", "A", "c", 4.0)])
    got = {r["id"]: r for r in families.merged(rows).collect()}
    assert set(got) == {2, 3} and got[2]["amount"] == 3.0 and got[3]["amount"] == 0.0 and got[3]["family_size"] == 2 and got[3]["family_total_amount"] == 4.0
    assert [r["id"] for r in search.merged_page(families.merged(rows), "contract_number", "ASC").collect()] == [2, 3]


# A page and a search row as the register gives them.
DETAIL = """<html><body><input id="EntityName" value="3136 | Autoridad de Transporte" /><input id="ContractNumber" value="2022-000019" />
<input id="Amendment" value="" /><input value='23 mar. 2022' id='DateOfGrant'><input id="EffectiveDateTo" value="30 jun. 2022" /><input id="Amount" value="$16,200.00" />
<div id="Service"> <b>INGENIER&Iacute;A</b> </div><h5>Otro</h5><table><tbody><tr><td>No</td></tr></tbody></table>
<h5>CONTRATISTA</h5><table><tbody><tr><td>IEMES, PSC</td><td>x</td></tr><tr><td>Segunda &amp; Co</td></tr></tbody></table></body></html>"""


def search_json(number="2022-000019", contract_id=5248440, amendment=None, names=("IEMES, PSC",), entity="Autoridad de Transporte"):
    return {
        "EntityId": 3136, "EntityName": entity, "ContractId": contract_id, "ContractNumber": number, "Amendment": amendment, "DateOfGrant": "/Date(1648036800000)/", "EffectiveDateFrom": "/Date(1648036800000)/",
        "EffectiveDateTo": "/Date(1656590400000)/", "Service": "INGENIERÍA", "ServiceGroup": "PROFESIONALES", "CancellationDate": None, "AmountToPay": 16200.0, "AmountToReceive": 0.0, "HasAmendments": True,
        "DocumentWithoutSocialSecurityId": "doc 1", "Contractors": [{"Name": n} for n in names],
    }


def test_search_results_and_detail_pages(spark, tmp_path):
    rows = [search_json(), search_json(amendment="A", contract_id=2), search_json(names=("Other",), contract_id=3), search_json(names=(), contract_id=4), search_json(entity="1 | AUTORIDAD DE TRANSPORTE", contract_id=5), search_json(number="2022-000020", contract_id=6)]
    (tmp_path / "page.json").write_text(json.dumps({"draw": 1, "recordsTotal": 1, "recordsFiltered": 1, "data": rows}, indent=1))
    found = live.search_rows(spark, str(tmp_path))
    record = live.search_records(found.where("ContractId = 5248440"), BASE, "live_monitor").first()
    assert (record["contractor"], str(record["award_date"]), record["amount"], record["cancelled"], record["fiscal_year"]) == ("IEMES, PSC", "2022-03-23", 16200.0, 0, "2021-2022")
    assert record["document_url"].endswith("code=doc+1") and record["source_url"].endswith("contractid=5248440") and record["procurement_method"] is None
    target = spark.createDataFrame([(1, "2022-000019", "Autoridad de Transporte", "IEMES PSC")], "position long, contract_number string, entity string, contractor string")
    assert sorted(r["search"]["ContractId"] for r in resolution.candidates(target, found).collect()) == [4, 5, 5248440]
    page = live.detail_records(spark.createDataFrame([(f"{BASE}/contract/details?contractid=9", DETAIL)], "url string, html string")).first()
    assert (page["entity"], page["entity_number"], page["contractor"], page["service_type"], page["amount"], str(page["award_date"]), page["source_contract_id"]) == ("Autoridad de Transporte", "3136", "IEMES, PSC", "INGENIERÍA", 16200.0, "2022-03-23", "9")
    assert page["contractor_names"] == ["IEMES, PSC", "Segunda & Co"]
    details = live.detail_records(spark.createDataFrame([("u", DETAIL), ("v", DETAIL.replace("23 mar. 2022", "")), ("w", DETAIL.replace('id="Amendment" value=""', 'id="Amendment" value="A"'))], "url string, html string"))
    why = lambda number="2022-000019", entity="Autoridad de Transporte", firm="IEMES": {r[0]: r[1] for r in details.select("source_url", resolution.detail_reason(F.lit(number), F.lit(entity), F.lit(firm))).collect()}
    assert why() == {"u": None, "v": resolution.NO_DATE, "w": resolution.NOT_ORIGINAL}
    assert why("x")["u"] == resolution.WRONG_NUMBER and why(entity="Otra")["u"] == resolution.WRONG_ENTITY and why(firm="Segunda & Co")["u"] == resolution.WRONG_CONTRACTOR and why(firm="")["u"] is None


def test_enrichment_fills_zeros(spark):
    record = live.search_records(spark.createDataFrame([json.loads(json.dumps(search_json()))], live.SEARCH_ROW), BASE, "live_monitor")
    bare = record.withColumns({"amount_receivable": F.lit(0.0), "service_type": F.lit(""), "procurement_method": F.lit("Own"), "contractor": F.lit("Kept")})
    other = record.select(F.struct(*(F.lit(7.5).alias(c) if c == "amount_receivable" else F.lit(1).alias(c) if c == "cancelled" else F.col(c) for c in sources.RECORD)).alias("found"))
    got = resolution.enriched(bare.crossJoin(other), "found", "live_recovery").first()
    assert (got["amount_receivable"], got["cancelled"], got["service_type"], got["procurement_method"], got["contractor"], got["source_type"]) == (7.5, 1, "INGENIERÍA", "Own", "Kept", "live_recovery")
    assert got["row_hash"] != record.first()["row_hash"]


TARGETS = ", ".join(f"{c} string" for c in sources.TARGET) + ", position long"


def target(number, position, status="pending", mode="auto_discover", url=None, notes=None, checked=None, batch="2022-2023", entity="Entidad Demo", contractor="IEMES PSC"):
    return (number, entity, contractor, batch, mode, url, status, notes, checked, position)


def fold_in_order(rows):
    """The same fold in plain Python."""
    out = None
    for r in rows:
        if out is None:
            out = dict(r)
            continue
        a, b = (out, r) if recovery.rank_of(out) >= recovery.rank_of(r) else (r, out)
        times = [x["last_checked_at"] for x in (a, b) if x["last_checked_at"]]
        out = {c: a[c] or b[c] for c in sources.TARGET if c != "last_checked_at"} | {"last_checked_at": max(times, default=None)}
    return out


def test_targets_are_folded_in_file_order_and_merged(spark):
    import random

    rng = random.Random(5)
    rows = [target(f"N{k % 6}", k, rng.choice(recovery.STATUSES), rng.choice(recovery.MODES), rng.choice([None, "u"]), rng.choice([None, "n"]), rng.choice([None, "2024-01-01", "2024-02-01"]), contractor=rng.choice(["IEMES PSC", "IEMES, PSC"])) for k in range(40)]
    t = spark.createDataFrame(rows, TARGETS)
    got = {r["contract_number"]: r for r in recovery.folded_duplicates(t).collect()}
    for n in range(6):
        want = fold_in_order([dict(zip([*sources.TARGET, "position"], r, strict=True)) for r in rows if r[0] == f"N{n}"])
        assert all(got[f"N{n}"][c] == want[c] for c in sources.TARGET) and got[f"N{n}"]["folded"] == sum(r[0] == f"N{n}" for r in rows) - 1
    scan = recovery.family_scan(rows_of(spark, [(1, "N1", "Entidad Demo", "IEMES PSC", "", "c", 1.0), (2, "N1", "Entidad Demo", "IEMES PSC", "A", "c", 1.0), (3, "N9", "Entidad Demo", "IEMES PSC", "A", "c", 1.0), (4, "N9", "Entidad Demo", "IEMES, PSC", "B", "c", 1.0), (5, "N8", "", "x", "A", "c", 1.0)]).withColumn("recovery", F.lit(1)))
    few = spark.createDataFrame([target("N1", 1), target("N1", 2, contractor="Other"), target("N9", 3, batch=None, status="ambiguous")], TARGETS)
    merged = {(r["contract_number"], r["contractor"]): r for r in recovery.seeded(few, scan).collect()}
    assert set(merged) == {("N1", "Other"), ("N9", "IEMES PSC")} and merged["N9", "IEMES PSC"]["recovery_batch"] == "2020-2021"
    assert recovery.seed_counts(few, scan).first().asDict() == {"added": 0, "candidates": 1, "removed": 1, "collapsed": 0}
    assert recovery.seed_counts(few.limit(0), scan).first().asDict() == {"added": 1, "candidates": 1, "removed": 0, "collapsed": 0}


def test_target_selection_and_order(spark):
    t = spark.createDataFrame([target(f"N{k:03}", k, batch=("2021-2022" if k % 2 else "2022-2023")) for k in range(101)] + [target("M", 200, mode="manual_url"), target("U", 201, mode="manual_url", url="u"), target("R", 202, status="recovered"), target("Z", 203, batch="later")], TARGETS)
    with pytest.raises(ValueError, match="more than 100"):
        recovery.selected(t)
    assert recovery.selected(t, batches=("2022-2023",)).count() == 52 and recovery.selected(t, contract_number="R", statuses=("recovered",)).count() == 1
    assert recovery.selected(t, all_pending=True).count() == 103 and recovery.selected(t, contract_number="M").count() == 0
    with pytest.raises(ValueError, match="unknown status"):
        recovery.selected(t, statuses=("odd",))
    ordered = [r["contract_number"] for r in t.orderBy(*recovery.target_order()).collect()]
    assert ordered[0] == "M" and ordered[-1] == "Z" and ordered.index("N000") < ordered.index("N001")
    with pytest.raises(ValueError, match="no batch"):
        recovery.checked_file(t.limit(1).withColumn("recovery_batch", F.lit(" ")))


def test_outcomes_of_targets(spark):
    rows = [("N", "Autoridad de Transporte", "F", "2022-2023", "auto_discover", k, None, "pending") for k in range(5)] + [("N", "x", "F", None, "manual_url", 5, "u", "pending"), ("N", "Doble", "F", None, "auto_discover", 6, None, "pending"), ("N", "x", "F", None, "manual_url", 7, " ", "ambiguous"), ("N", "x", "F", None, "manual_url", 8, "v", "pending")]
    t = spark.createDataFrame(rows, "contract_number string, entity string, contractor string, recovery_batch string, lookup_mode string, position long, source_url string, status string")
    entities = spark.createDataFrame([("Autoridad de Transporte", "1"), ("Doble", "2"), ("DOBLE", "3")], "name string, code string")
    found = spark.createDataFrame([(0,), (1,), (1,), (2,), (4,)], "position long")
    told = {r["position"]: (r["discovery"], r["found"], r["askable"]) for r in resolution.discovered(t, entities, found).collect()}
    assert told[0] == ("search returned 1 exact candidate(s)", True, True) and told[3] == ("search returned 0 exact candidate(s)", False, True) and told[5] == (resolution.MANUAL, True, True) and told[6] == (resolution.NO_ENTITY, False, True) and not told[7][2]
    base = records_of(spark, 6)
    checked = base.withColumn("position", F.least(F.col("source_contract_id").cast("long"), F.lit(5))).withColumns({"reason": F.when(F.col("position") == 2, resolution.NO_DATE), "url": F.lit("u"), "missing": F.lit(False)})
    twice = checked.where("position = 1").withColumn("source_contract_id", F.lit("77"))
    lost = checked.where("position = 0").withColumns({"position": F.lit(8).cast("long"), "url": F.lit("v"), "missing": F.lit(True)})
    known = base.limit(1).withColumns({"id": F.lit(9), "contract_number": F.lit("other"), "row_hash": F.lit("h")})
    args = resolution.discovered(t, entities, found), checked.where("position <> 3").unionByName(twice).unionByName(lost), known, known.limit(0).withColumn("pos", F.lit(0))
    done = resolution.resolved(*args)
    got = {r["position"]: (r["status"], r["notes"]) for r in done.outcomes.collect()}
    assert got[0] == ("recovered", "search returned 1 exact candidate(s); recovered original row") and got[1] == ("ambiguous", "search returned 2 exact candidate(s); 2 validated candidates remain")
    assert got[2] == ("unrecoverable", f"search returned 1 exact candidate(s); {resolution.NO_DATE}") and got[3] == ("unrecoverable", "search returned 0 exact candidate(s)") and got[6] == ("unrecoverable", resolution.NO_ENTITY)
    assert got[7] == ("ambiguous", resolution.NO_URL) and got[8] == ("pending", "error: no page for v")
    # targets 0, 4 and 5 found the same contract under three ids: the first in order is written, the others have it already
    assert got[4] == ("recovered", f"search returned 1 exact candidate(s); {resolution.SAME_ROW}") and got[5] == ("recovered", f"{resolution.MANUAL}; {resolution.SAME_ROW}")
    assert [r["position"] for r in done.added.collect()] == [0]
    dry = resolution.resolved(*args, dry_run=True)
    assert dry.added.count() == 0 and {r["position"]: r["status"] for r in dry.outcomes.collect()}[4] == "recovered"


def in_sequence(records, known, recovered):
    """Conflicts as a loop over the records finds them, each written where it may be."""
    kinds, written = [], [dict(r) for r in recovered]
    zero = lambda x: x or 0
    present = lambda x, y: not x or not y or x == y

    def verdict(old, new, equal):
        if all((zero(old[c]) == zero(new[c])) if c == "cancelled" else old[c] == new[c] for c in sources.RECORD):
            return "identical", equal
        alike = all(old[c] == new[c] for c in ("contract_number", "entity", "amount", "award_date", "valid_from", "valid_to"))
        if alike and not old["amendment"] and present(old["entity_number"], new["entity_number"]) and zero(old["amount_receivable"]) == zero(new["amount_receivable"]) and present(old["family"], new["family"]):
            return ("identical", resolution.SAME_ROW) if old["source_type"] == "live_recovery" else ("needs_enrichment", resolution.DEFER)
        return None

    for r in records:
        twin = next((x for x in [*known, *written] if x["row_hash"] == r["row_hash"]), None)
        parent = next((x for x in [*known, *written] if (x["contract_number"], x["entity"]) == (r["contract_number"], r["entity"]) and not x["amendment"]), None)
        if twin:
            kinds.append(verdict(twin, r, resolution.SAME_ROW) or ("hash_conflict", resolution.COLLISION))
        elif parent:
            kinds.append(verdict(parent, r, resolution.SAME_ORIGINAL) or ("family_conflict", resolution.OTHER_FAMILY if parent["family"] != r["family"] else resolution.OTHER_ROW))
        else:
            kinds.append(("ok", resolution.READY))
            written.append(r)
    return kinds


@pytest.mark.parametrize("seed", range(4))
def test_conflicts_are_those_of_a_loop_over_targets(spark, seed):
    import random

    rng = random.Random(seed)
    base = records_of(spark, 1).first().asDict()

    def made(n, original):
        out = []
        for k in range(n):
            r = base | {"contract_number": f"N{rng.randrange(6)}", "entity": rng.choice("EF"), "contractor": rng.choice(["Ace", "Ace Inc", "Bolt"]), "amount": rng.choice([1.0, 2.0]), "amount_receivable": rng.choice([None, 0.0, 5.0]), "entity_number": rng.choice([None, "1", "2"]), "source_type": rng.choice(["csv", "live_recovery"]), "cancelled": rng.choice([0, None]), "amendment": "" if original or rng.random() < 0.5 else "A"}
            out.append(r | {"family": r["contractor"].replace(" Inc", "").upper(), "row_hash": "|".join(str(r[c]) for c in ("contract_number", "entity", "contractor", "amendment", "amount")), "id": k, "pos": k, "rank": k})
        return out

    records, known, recovered = made(40, True), made(4, False), made(4, False)
    schema = records_of(spark, 1).limit(0).withColumns({"family": F.lit(""), "id": F.lit(0), "pos": F.lit(0), "rank": F.lit(0)}).schema
    for field in schema:
        field.nullable = True
    frame = lambda rows: spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema)
    got = resolution.conflicts(frame(records), frame(known), frame(recovered), True).collect()
    assert [(r["conflict"], r["conflict_note"]) for r in sorted(got, key=lambda r: r["rank"])] == in_sequence(records, known, recovered)


def test_recovery_from_end_to_end(spark, tmp_path):
    """Seed targets, work on them, write what they recovered, and seed again."""
    firm, entity = "IEMES PSC", "Autoridad de Transporte"
    load = lambda rows: rows_of(spark, rows).withColumns({c: F.lit(None).cast("string") for c in ("entity_number", "source_type", "pco_number", "document_url", "source_url", "source_contract_id")} | {"amount_receivable": F.lit(0.0), "row_hash": F.concat(F.lit("h"), F.col("id").cast("string"))})
    rows = [(1, "2022-000019", f"3136 | {entity}", firm, "A", "c", 1.0), (2, "2022-000019", entity, firm, "B", "c", 1.0)]
    scan = recovery.family_scan(load(rows))
    t = recovery.seeded(spark.createDataFrame([], TARGETS), scan).withColumn("position", F.lit(0).cast("long"))
    assert [tuple(r) for r in t.select("contract_number", "entity", "status").collect()] == [("2022-000019", f"3136 | {entity}", "pending")]
    search = spark.createDataFrame([search_json()], live.SEARCH_ROW)
    pages = spark.createDataFrame([(f"{BASE}/contract/details?contractid=5248440", DETAIL)], "url string, html string")
    entities = spark.createDataFrame([(entity, "3136")], "name string, code string")
    empty = spark.createDataFrame([], records_of(spark, 1).withColumn("pos", F.lit(0)).schema)
    done = resolution.recover(t, search, pages, entities, load(rows), empty, BASE)
    assert [(r["status"], r["notes"]) for r in done.outcomes.collect()] == [("recovered", f"search returned 1 exact candidate(s); {resolution.RECOVERED}")]
    path = str(tmp_path / "recovered")
    sources.write_recovered(done.added, path)
    back = sources.canonical(sources.read_recovered(spark, path), "live_recovery").collect()
    assert [(r["contract_number"], r["source_type"], r["amendment"]) for r in back] == [("2022-000019", "live_recovery", "")]
    again = recovery.family_scan(load([*rows, (3, "2022-000019", entity, firm, "", "c", 16200.0)]))
    assert recovery.missing_originals(again).count() == 0
    kept = t.drop("position").withColumn("status", F.lit("recovered")).withColumn("position", F.lit(0).cast("long"))
    assert recovery.seeded(kept, again).count() == 1 and recovery.seeded(t, again).count() == 0


def test_files_are_read_by_header(spark, tmp_path):
    path = tmp_path / "recovered.csv"
    path.write_text("entity,contract_number,extra,source_type\nE,N1,x,\n")
    row = sources.read_recovered(spark, str(path)).first()
    assert (row["contract_number"], row["entity"], row["contractor"], row["source_type"]) == ("N1", "E", None, None)
    path = tmp_path / "targets.csv"
    path.write_text("status,contract_number,notes,entity\n ,N1,\" \"\"x\"\" \",E\npending,N2,,E\n")
    assert [r["status"] for r in sources.read_targets(spark, str(path)).orderBy("position").collect()] == ["pending", "pending"]
    assert [(r["contract_number"], r["status"], r["notes"]) for r in recovery.publishable(sources.read_targets(spark, str(path), None)).collect()] == [("N1", None, "x")]


def records_of(spark, n):
    """Records of ``n`` search rows, as a literal table."""
    got = live.search_records(spark.createDataFrame([search_json(contract_id=k) for k in range(n)], live.SEARCH_ROW), BASE, "live_recovery")
    return spark.createDataFrame(got.collect(), got.schema)


def test_upsert_is_idempotent(spark):
    base = records_of(spark, 3)
    have = base.where("source_contract_id < '2'").withColumn("pos", F.col("source_contract_id").cast("long"))
    got = resolution.upserted(have, base).collect()
    assert sorted(r["source_contract_id"] for r in got) == ["0", "1", "2"] and [r["pos"] for r in got if r["source_contract_id"] == "2"] == [None]


def test_load_folder(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "contratos_2021-2022.csv").write_text('Núm. Contrato ,Entidad,Contratista,Enmienda,Cuantía,Otorgado en\n2022-000019,"12 | Entidad, ""Demo""",IEMES PSC,,"$10,000.00",2021-08-01\n2022-000019,12 | Entidad,IEMES PSC,A,,\n', encoding="utf-8")
    (raw / "contratos_2020-2021.csv").write_bytes("NumContrato,Entidad Gubernamental,Contratista,Monto,Fecha Otorgamiento\n2021-000001,Educación,José,5,25/12/2020\n2021-000001,Educación,José,5,25/12/2020\n".encode("latin-1"))
    (raw / "notes.csv").write_text("Entidad\nx\n")
    recovered = tmp_path / "recovered.csv"
    rows = sources.load_folder(spark, str(raw), str(recovered))
    assert rows.where("source_type = 'csv'").count() == 5
    got = {(r["contract_number"], r["amendment"]): r for r in loading.first_wins(rows).collect() if r["contract_number"]}
    assert got["2021-000001", ""]["entity"] == "Educación" and str(got["2021-000001", ""]["award_date"]) == "2020-12-25" and got["2021-000001", ""]["fiscal_year"] == "2020-2021"
    assert got["2022-000019", ""]["amount"] == 10000.0 and got["2022-000019", "A"]["amount"] is None and len(got) == 3
    log = {r["file"]: (r["parsed"], r["new_rows"], r["duplicates"]) for r in loading.load_log(rows).collect()}
    assert log["contratos_2020-2021.csv"] == (2, 1, 1)
    assert [r[0] for r in sources.export_years(sources.utf8_files(spark, str(raw))).collect()] == ["2021-2022", "2020-2021"]
    first = live.search_records(spark.createDataFrame([search_json()], live.SEARCH_ROW), BASE, "live_recovery")
    sources.write_recovered(first, str(recovered))
    again = sources.load_folder(spark, str(raw), str(recovered))
    back = again.where("source_rank = 1").first()
    assert again.count() == 6 and back["source_type"] == "live_recovery" and back["row_hash"] == first.first()["row_hash"]
    ids = loading.load_ids(again, parts=3).collect()
    assert sorted(r["id"] for r in ids) == [1, 2, 3, 4, 5, 6] and max(ids, key=lambda r: r["id"])["source_rank"] == 1
    loading.publish(again.withColumn("id", F.monotonically_increasing_id()), str(tmp_path / "published"))
    assert spark.read.parquet(str(tmp_path / "published")).columns.__len__() == 22


def test_target_files(spark, tmp_path):
    path = str(tmp_path / "targets")
    assert sources.read_targets(spark, path).count() == 0
    t = spark.createDataFrame([target("B", 1, status=" "), target("A", 2, notes='say "x", y')], TARGETS)
    sources.write_targets(t.orderBy(*recovery.target_order()), path)
    back = sources.read_targets(spark, path).orderBy("position").collect()
    assert [r["contract_number"] for r in back] == ["A", "B"] and back[0]["notes"] == 'say "x", y' and back[1]["status"] == "pending" and back[1]["source_url"] is None


def test_exports_are_refused_beyond_the_cap(spark):
    rows = rows_of(spark, [(k, f"N{k}", "E", "Firm, Inc", "", "c", 1.0) for k in range(5)]).withColumns({c: F.lit(None).cast("string") for c in ("entity_number", "source_type")} | {"amount_receivable": F.lit(0.0)})
    assert loading.export(rows, "detailed", 5).columns == loading.DETAILED
    for cap, df in ((4, rows), (5, rows.limit(0))):
        with pytest.raises(ValueError):
            loading.export(df, "detailed", cap)
    assert loading.printed(families.summaries(families.rollup(rows)), "summary").first()["amount"] == "$1.00"


def test_monitor_enriches_and_keeps_only_unknown(spark, tmp_path):
    folder, store, log, cursor = (str(tmp_path / n) for n in ("in", "store", "log", "cursor"))
    (tmp_path / "in").mkdir()
    write = lambda name, rows: (tmp_path / "in" / name).write_text(json.dumps({"draw": 1, "recordsTotal": 1, "recordsFiltered": 1, "data": rows}))
    details = spark.createDataFrame([(f"{BASE}/contract/details?contractid=5248440", DETAIL.replace("</body>", '<input id="Fund" value="Fondo" /></body>'))], "url string, html string")
    write("1.json", [search_json(), search_json(contract_id=2, number="2022-000021")])
    monitor(spark, folder, store, log, cursor, BASE, details)
    write("2.json", [search_json(), search_json(contract_id=3, number="2022-000022")])
    monitor(spark, folder, store, log, cursor, BASE, details)
    got = {r["contract_number"]: r for r in spark.read.parquet(store).collect()}
    assert len(got) == spark.read.parquet(store).count() == 3 and got["2022-000019"]["fund_type"] == "Fondo" and got["2022-000021"]["fund_type"] is None
    runs = sorted((r["number"], r["seen"], r["added"], r["known"], r["key"]) for r in spark.read.parquet(log).collect())
    assert [r[:4] for r in runs] == [(1, 2, 2, 0), (2, 2, 1, 1)]
    assert run_digest(spark, store, runs[1][4]).count() == 1
