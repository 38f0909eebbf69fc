"""Detail pages against an HTML parser; the keyword index, the store, the stored roll-up and rewrites after several loads."""

import json
import os
import random
from html.parser import HTMLParser

import pytest
from conftest import rows as sorted_rows
from pyspark.sql import functions as F
from test_register_values import BASE, DETAIL, rows_of, search_json

from ledgerloom.operators import families, keyword_index, loading, rollup_store, search, store
from ledgerloom.plans.base import by_hash
from ledgerloom.sources import contracts as sources
from ledgerloom.sources import live
from ledgerloom.streaming.intake import monitor, run_digest


class Page(HTMLParser):
    """Values and texts of the elements with ids, for pages whose elements are closed."""

    def __init__(self, html):
        super().__init__()
        self.found, self.open = {}, []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        name = given.get("id")
        if name and name not in self.found:
            self.found[name] = given.get("value", [])
            if tag not in ("input", "br"):
                self.open.append((tag, name))
                return
        if tag not in ("input", "br"):
            self.open.append((tag, None))

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        for _, name in self.open:
            if name and isinstance(self.found[name], list) and data.strip():
                self.found[name].append(" ".join(data.split()))

    def value(self, name):
        got = self.found.get(name)
        return " ".join(got) or None if isinstance(got, list) else got


def random_page(rng):
    """Elements in any order, attributes shuffled and quoted in several ways, texts with tags and entities inside."""
    out = []
    for name in rng.sample([*live.DETAIL_FIELDS, "Other", "Contract"], 10):
        value = rng.choice(["", "x", "a &amp; b", "Jos&eacute; &#241;", "12 mar. 2022", "1 &gt; 0", "id=Amount"])
        q = rng.choice(['"', "'"])
        attrs = [f"id={q}{name}{q}" if rng.random() < 0.8 else f"id={name}", "class='form-control'", 'data-id="no"']
        if rng.random() < 0.6:
            attrs.append(f"value={q}{value}{q}")
            rng.shuffle(attrs)
            out.append(f"<{rng.choice(['input', 'INPUT'])} {' '.join(attrs)} {rng.choice(['/', ''])}>")
        else:
            rng.shuffle(attrs)
            tag = rng.choice(["div", "span"])
            inner = rng.choice([value, f" <b>{value}</b> more ", f"<i id={q}In{name}{q}>{value}</i> <b>end</b>"])
            out.append(f"<{tag} {' '.join(attrs)}>{inner}</{tag}>")
    return "<html><body>" + "\n".join(out) + "</body></html>"


def test_fields_are_those_of_a_parser(spark):
    rng = random.Random(11)
    pages = [random_page(rng) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(pages)), "n int, html string").withColumn("f", live.elements(F.col("html"), tuple(live.DETAIL_FIELDS)))
    got = df.select("n", *(live.field(F.col("html"), F.col("f"), k).alias(k) for k in live.DETAIL_FIELDS)).collect()
    for r in got:
        want = Page(pages[r["n"]])
        assert {k: r[k] for k in live.DETAIL_FIELDS} == {k: want.value(k) for k in live.DETAIL_FIELDS}, pages[r["n"]]


def test_contractors_are_found_under_any_spelling_of_their_heading(spark):
    names = lambda html: spark.createDataFrame([(html,)], "html string").select(live.table_names(F.col("html"))).first()[0]
    table = "<table class='t'><tbody><tr><td> Uno <b>SA</b></td><td>x</td></tr><tr class='y'><th>Dos &amp; Co</th></tr></tbody></table>"
    for heading in ("<h5><i></i> Contratista</h5>", "<h5>Contratísta</h5>", "<h4 class='x'><span>CONTRATISTA</span></h4>", "<H6>\n contratista </H6>"):
        assert names(f"<h5>Otro</h5><table><tbody><tr><td>no</td></tr></tbody></table>{heading}<p></p><h5>Más</h5>{table}") == ["Uno SA", "Dos & Co"]
    assert names("<h5>Contratista</h5><table><tr><td>x</td></tr></table>") == [] and names("<h3>Contratista</h3>" + table) == [] and names("") == []


def contracts_of(spark, n=60):
    return rows_of(spark, [(k, f"N{k % 7}", ["Educación", "SALUD", "Hacienda Pública"][k % 3], ["Ácme Corp", "Zeta LLC", "Ñandú"][k % 3 - 1], "" if k % 4 == 0 else "A", f"cat{k % 5}", float(k)) for k in range(n)])


def test_index_follows_loads_and_equals_the_scan(spark, tmp_path):
    rows, path = contracts_of(spark), str(tmp_path / "index")
    for load in range(3):
        keyword_index.add(rows.where(F.col("id") % 3 == load), path)
        held = rows.where(F.col("id") % 3 <= load)
        for query in ("educ", "acme cat1", "pública ñan", "ucaci", "zeta nothing", "", "a cat3", "ac acme"):
            want = sorted(r["id"] for r in search.keyword(held, query).collect())
            assert sorted(r["id"] for r in search.filtered(held, {"keyword": query}, index=path).collect()) == want, query
    keyword_index.add(rows.where("id < 5"), path)
    keyword_index.compact(spark, path)
    assert spark.read.parquet(path).count() == keyword_index.postings(rows).count()
    plan = keyword_index.hits(spark, path, "educ")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(first" in plan and "StringStartsWith(word,EDUC)" in plan
    assert keyword_index.hits(spark, str(tmp_path / "none"), "x").count() == 0


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_store_reads_what_a_batch_needs_and_takes_nothing_twice(spark, tmp_path, monkeypatch):
    path, state = str(tmp_path / "store"), str(tmp_path / "state")
    rows = by_hash(contracts_of(spark, 400)).withColumns({"source_rank": F.lit(0), "file": F.lit("a"), "pos": F.col("id")})
    first = store.load(rows.where("id < 300"), path, state, "one", "2024-01-01")
    assert (first["seen"], first["added"], first["known"], first["number"]) == (300, 300, 0, 1)
    assert store.load(rows.where("id < 300"), path, state, "one") == first | {"cursor": "2024-01-01"}
    few = rows.where("id between 298 and 301")
    known = store.known_hashes(few, path)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert known.count() == 2 and "PartitionFilters: [part" in plan and "In(row_hash" in plan
    monkeypatch.setattr(store, "BY_VALUE", 2)  # the way of large batches
    assert {r[0] for r in store.known_hashes(few, path).collect()} == {r[0] for r in known.collect()}
    second = store.load(rows, path, state, "two")
    assert (second["added"], second["known"], second["number"]) == (100, 300, 2) and store.stored(spark, path).count() == 400
    assert store.last_cursor(spark, state) == "2024-01-01"


def test_a_failed_load_is_completed_and_leaves_the_cursor(spark, tmp_path, monkeypatch):
    path, state = str(tmp_path / "store"), str(tmp_path / "state")
    rows = by_hash(contracts_of(spark, 30)).withColumns({"source_rank": F.lit(0), "file": F.lit("a"), "pos": F.col("id")})
    asked = []

    def fetch(start):
        asked.append(start)
        return rows.where("id < 20")

    store.sync(fetch, spark, path, state, "2024-01-10")
    failing = monkeypatch.context()
    with failing as m:
        m.setattr(store, "STATE", "broken")
        m.setattr(store, "loads", lambda spark, state: spark.read.parquet(state))
        with pytest.raises(Exception):  # noqa: B017  (records are added, then the state cannot be written)
            store.sync(lambda start: rows, spark, path, state, "2024-01-20")
    assert store.last_cursor(spark, state) == "2024-01-10" and store.stored(spark, path).count() == 30
    again = store.sync(lambda start: asked.append(start) or rows, spark, path, state, "2024-01-20")
    assert (again["added"], again["known"], again["number"]) == (10, 20, 2) and store.stored(spark, path).count() == 30
    assert asked == ["2024-01-03", "2024-01-10"] and store.last_cursor(spark, state) == "2024-01-20"
    assert loading.start_date("2020-05-05", "2024-01-20", "2024-02-01") == "2020-05-05"


def test_monitor_with_a_new_checkpoint_on_an_old_store(spark, tmp_path):
    folder, path, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    os.mkdir(folder)
    write = lambda name, found: (tmp_path / "in" / name).write_text(json.dumps({"draw": 1, "recordsTotal": 1, "recordsFiltered": 1, "data": found}))
    details = spark.createDataFrame([(f"{BASE}/contract/details?contractid=5248440", DETAIL)], "url string, html string")
    write("1.json", [search_json(), search_json(contract_id=2, number="2022-000021")])
    monitor(spark, folder, path, state, str(tmp_path / "c1"), BASE, details)
    write("2.json", [search_json(contract_id=3, number="2022-000022")])
    monitor(spark, folder, path, state, str(tmp_path / "c2"), BASE, details)  # reads both files again
    runs = sorted((r["number"], r["seen"], r["added"], r["known"]) for r in store.loads(spark, state).collect())
    assert runs == [(1, 2, 2, 0), (2, 3, 1, 2)] and store.stored(spark, path).count() == 3
    last = store.loads(spark, state).orderBy(F.desc("number")).first()["key"]
    assert [r["contract_number"] for r in run_digest(spark, path, last).collect()] == ["2022-000022"]


def test_stored_families_equal_a_whole_roll_up(spark, tmp_path):
    rows, path = contracts_of(spark, 200), str(tmp_path / "families")
    rows = rows.withColumn("entity", F.when(F.col("id") % 11 > 0, F.col("entity")))  # null keys too
    for load in range(3):
        rollup_store.refresh(rows.where(F.col("id") % 3 == load), path, load)
        want = families.rollup(rows.where(F.col("id") % 3 <= load))
        assert sorted_rows(rollup_store.families(spark, path)) == sorted_rows(want)
    before = files_of(path)
    assert rollup_store.refresh(rows.where("id % 3 = 2"), path, 2) == [] and files_of(path) == before
    one = rows.limit(1).withColumn("id", F.lit(1000).cast("long"))
    assert len(rollup_store.refresh(one, path, 3)) == 1 and len(before - files_of(path)) == 1
    assert sorted_rows(rollup_store.families(spark, path)) == sorted_rows(families.rollup(rows.unionByName(one)))


def test_only_changed_years_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([(k, f"{2019 + k % 4}-{2020 + k % 4}", "03/05/2020" if k % 4 == 1 else "2020-03-05", " A" if k == 7 else "A") for k in range(40)], "id long, fiscal_year string, award_date string, amendment string")
    rows.withColumns({"valid_from": F.col("award_date"), "valid_to": F.lit(None).cast("string")}).write.partitionBy("fiscal_year").parquet(path)
    before = files_of(path)
    assert store.rewrite_changed(spark, path) == ["2020-2021", "2022-2023"]
    after = files_of(path)
    kept = {f for f in before if "2019-2020" in f or "2021-2022" in f}
    assert kept == before & after and spark.read.parquet(path).count() == 40
    assert {(r["award_date"], r["amendment"]) for r in spark.read.parquet(path).collect()} == {("2020-03-05", "A")}
    assert store.rewrite_changed(spark, path) == [] and files_of(path) == after


def test_amendment_counts_keep_rows_with_null_keys(spark):
    rows = contracts_of(spark, 12).withColumn("entity", F.lit(None).cast("string"))
    assert families.amendment_counts(rows).count() == 12


def test_manifest_is_one_document(spark, sf, tmp_path):
    from ledgerloom.plans.registry import QUERIES

    parts = QUERIES["manifest_of_archived_years"](spark, sf)
    loading.write_manifest(parts.repartition(7), str(tmp_path / "manifest"))
    text = "".join(open(tmp_path / "manifest" / f, encoding="utf-8").read() for f in sorted(os.listdir(tmp_path / "manifest")) if f.startswith("part-"))
    made = json.loads(text)
    assert made["fiscal_years"] == ["1996-1997", "1994-1995"] and len(made["dashboard"]["yearly_spending"]) == 2 and made["row_count"] == 6000
    assert len(made["recovery_targets"]) == parts.count() - 2 and all(set(t) == set(sources.TARGET) and t["status"] != "pending" for t in made["recovery_targets"])
    money = [x["total_amount"] for x in made["dashboard"]["top_entities"]]
    assert money == sorted(money, reverse=True)
    c = contracts_of(spark, 3)
    none = spark.createDataFrame([], ", ".join(f"{x} string" for x in sources.TARGET) + ", position long")
    empty = json.loads("".join(r["text"] for r in loading.manifest_parts(c.limit(0), families.rollup(c.limit(0), False), none).orderBy("section", "place").collect()))
    assert empty["row_count"] == 0 and empty["recovery_targets"] == [] and empty["dashboard"]["top_contractors"] == []


def test_pages_by_position_with_nulls_and_ties(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(k, rng.choice([None, 1.0, 2.0, 3.0]), rng.choice([None, "a", "b"])) for k in range(333)], "id long, amount double, word string")
    for order in (search.Order("amount"), search.Order("amount", False), search.Order("word", True, "id", True), search.Order("word", False, "id", True)):
        want = [r["id"] for r in rows.orderBy(*order.columns()).collect()]
        starts = search.page_starts(rows, order, 50).persist()
        assert starts.count() == 7
        last, seen = None, []
        for number in range(1, 8):
            page = sorted(search.page_at(rows, starts, number, order, 50).collect(), key=lambda r: want.index(r["id"]))
            assert [r["id"] for r in page] == want[50 * number - 50 : 50 * number]
            again = search.page_after(rows, order, last, 50).collect()
            assert {r["id"] for r in again} == {r["id"] for r in page}
            last = (page[-1][order.sort], page[-1]["id"])
            seen += [r["id"] for r in page]
        assert seen == want and search.page_at(rows, starts, 8, order).count() == 0


def test_many_exports_of_few_layouts(spark, tmp_path):
    """Files of two encodings and three layouts, fields over several lines, a mark before the header, empty files and folders."""
    raw = tmp_path / "raw"
    raw.mkdir()
    assert sources.load_folder(spark, str(raw)).count() == 0 and set(loading.first_wins(sources.load_folder(spark, str(raw))).columns) >= set(sources.RECORD)
    for k in range(60):
        head, row = [("Núm. Contrato,Entidad,Contratista,Cuantía", f"N{k},Educación,José,{k}"), ("NumContrato,Entidad Gubernamental,Contratista,Monto,Enmienda", f'N{k},"Salud, ""A""",X,{k},B'), ("Contratista,Num. Contrato,Entidad", f'"dos\nlíneas",N{k},E')][k % 3]
        (raw / f"contratos_{1950 + k}-{1951 + k}.csv").write_bytes(f"{head}\n{row}\n".encode("latin-1" if k % 2 else "utf-8-sig" if k % 4 == 0 else "utf-8"))
    (raw / "contratos_2030-2031.csv").write_bytes(b"")
    files = sources.export_files(spark, str(raw)).collect()
    assert len(files) == 60 and {(r["utf8"], r["multiline"]) for r in files if "Contratista,Num" in r["header"]} == {(True, True), (False, True)}
    rows = sources.load_folder(spark, str(raw))
    got = {r["contract_number"]: r for r in rows.collect()}
    assert len(got) == 60 and got["N1"]["entity"] == 'Salud, "A' and got["N1"]["amendment"] == "B" and got["N3"]["contractor"] == "José" and got["N3"]["amount"] == 3.0 and got["N2"]["contractor"] == "dos\nlíneas"
    assert got["N6"]["fiscal_year"] == "1956-1957" and {got[f"N{k}"]["entity"] for k in range(0, 60, 3)} == {"Educación"}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 12  # one for each layout, and not for each file


def test_words_and_prefixes_of_odd_texts(spark):
    """Words, their beginnings and parts of them as plain Python finds them, over signs, accents, marks and blanks of all kinds."""
    import re
    import unicodedata

    rng = random.Random(5)
    pieces = ["Educación", "EDUCACIÓN", "x1", "ac", "Acme", "ÁCME", "ß", "́", "-", "_", "\n", "\x00", "", "ɏo", "Ω", "1", "a.b", "&", "𝔸1", " ñ "]
    texts = [[None if rng.random() < 0.1 else "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(4)) for _ in search.TEXT_COLUMNS] for _ in range(400)]
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "id long, " + ", ".join(f"{c} string" for c in search.TEXT_COLUMNS))
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").upper()
    words = {k: set(re.findall("[0-9A-ZÀ-ɏ]+", plain(" ".join(x for x in t if x is not None)))) for k, t in enumerate(texts)}
    got = {r["id"]: set(r["w"]) - {""} for r in rows.select("id", search.words().alias("w")).collect()}
    assert got == words
    assert {(r["word"], r["id"]) for r in keyword_index.postings(rows).collect()} == {(w, k) for k, ws in words.items() for w in ws}
    for query in ("educ", "ac 1", "ácme x", "ss", "b a", "ñ", "cme", "1 1", "ɏ"):
        asked = search.tokens(query)
        begins = {k for k, ws in words.items() if all(any(w.startswith(t) for w in ws) for t in asked)}
        part = {k for k, t in enumerate(texts) if all(any(q in plain(x or "") for x in t) for q in asked)}
        assert {r["id"] for r in rows.where(search.keyword_prefix(query)).collect()} == begins, query
        assert {r["id"] for r in rows.where(search.keyword_part(query)).collect()} == part, query
    # a pattern of a split is compiled for each row, and an exists looks at all words once for each word asked
    plan = rows.where(search.keyword_prefix("educ ac x")).select(search.words())._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "exists(" not in plan


def test_index_makes_its_contracts_once(spark, sf):
    """Loads, ranges and the query read one table, and a merge moves the postings once."""
    from ledgerloom.plans.registry import QUERIES

    plan = QUERIES["indexed_keyword_fallback"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_merged_index_moves_its_postings_once(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    rows, path, plans = contracts_of(spark), str(tmp_path / "index"), []
    for part in (rows, rows.where("id < 5")):
        keyword_index.add(part, path)
    kept = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: plans.append(self._df._jdf.queryExecution().executedPlan().toString()) or kept(self, *a, **b))
    keyword_index.compact(spark, path)
    assert len(plans) == 1 and plans[0].count("Exchange") == 1
    assert spark.read.parquet(path).count() == keyword_index.postings(rows).count()


def test_a_load_moves_its_rows_once(spark, tmp_path, monkeypatch):
    """One exchange for the first rows, the known hashes and the store's ranges; repeats and rows without a hash as before."""
    from pyspark.sql import DataFrameWriter

    path, state, plans = str(tmp_path / "store"), str(tmp_path / "state"), []
    rows = by_hash(contracts_of(spark, 400)).withColumns({"source_rank": F.lit(0), "file": F.lit("a"), "pos": F.col("id")})
    rows = rows.withColumn("row_hash", F.when(F.col("id") % 50 > 0, F.col("row_hash")))  # eight rows without a hash
    twice = rows.unionByName(rows.withColumns({"file": F.lit("b"), "contractor": F.lit("later")}))
    store.load(rows.where("id < 100"), path, state, "one")
    kept = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, to, *a, **b: plans.append((to, self._df._jdf.queryExecution().executedPlan().toString())) or kept(self, to, *a, **b))
    monkeypatch.setattr(store, "BY_VALUE", 2)  # the way of large batches
    second = store.load(twice, path, state, "two")
    assert [to for to, _ in plans] == [path, state] and plans[0][1].count("Exchange") == 1
    assert (second["seen"], second["added"], second["known"]) == (800, 295, 505)  # 392 hashes, 98 known; one of the rows without
    got = store.stored(spark, path)
    assert got.groupBy("row_hash").count().where("count > 1").where("row_hash is not null").count() == 0 and got.where("contractor = 'later'").count() == 0
    sizes = [os.path.getsize(f) for f in files_of(path)]
    assert max(sizes) < 100_000  # a filter of a megabyte for few hashes would show


def test_a_refresh_moves_rows_and_parts_once(spark, tmp_path, monkeypatch):
    """Nothing is written but the roll-up itself, after one exchange; folders in several pieces give the same families."""
    from pyspark.sql import DataFrameWriter

    rows, path, plans = contracts_of(spark, 200), str(tmp_path / "families"), []
    kept = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, to, *a, **b: plans.append((to, self._df._jdf.queryExecution().executedPlan().toString())) or kept(self, to, *a, **b))
    monkeypatch.setattr(rollup_store, "many_parts", lambda *a: 7)
    for load in range(3):
        rollup_store.refresh(rows.where(F.col("id") % 3 == load), path, load, True, 3)
    assert [to for to, _ in plans] == [path] * 3 and all(plan.count("Exchange") == 1 for _, plan in plans)
    assert sorted_rows(rollup_store.families(spark, path)) == sorted_rows(families.rollup(rows))
