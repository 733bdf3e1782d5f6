from pyspark.sql import functions as F

from finloom.operators import align, filters, match, ordered, route, rules, store
from finloom.sources import readers

TERMS = "canonical string, section string, statement string, variations array<string>, ord int"


def statement(spark, pairs, doc="d"):
    return spark.createDataFrame([(doc, "a", 0, i, l, float(v) if v is not None else None) for i, (l, v) in enumerate(pairs)], "doc_id string, source string, table_idx int, row_idx int, label string, value double")


def test_row_types(spark):
    labels = {"Total actif": "total_asset", "Total des capitaux propres et passifs": "total_equity_and_liabilities", "Stocks": "asset", "Emprunts": "liability", "Réserves": "equity", "Divers": "other", "Total": "total"}
    df = spark.createDataFrame([(k,) for k in labels], "l string").select("l", filters.row_type(F.col("l")).alias("k"))
    assert {r.l: r.k for r in df.collect()} == labels


def test_balance_and_report(spark):
    good = statement(spark, [("Total actif", 1000), ("Total passif", 600), ("Total capitaux propres", 400)])
    bad = statement(spark, [("Total actif", 1000), ("Total passif", 600), ("Total capitaux propres", 100)], "e")
    none = statement(spark, [("Total passif", 5)], "f")
    checks = rules.balance(good.unionByName(bad).unionByName(none), ["doc_id"])
    got = {r.doc_id: r.passed for r in checks.collect()}
    assert got == {"d": True, "e": False}
    report = {r.doc_id: (r.total, r.critical, r.score) for r in rules.report(checks, ["doc_id"]).collect()}
    assert report == {"d": (1, 0, 1.0), "e": (1, 1, 0.0)}


def test_income_anomaly_ratio(spark):
    rows = statement(spark, [("Résultat d'exploitation", 300), ("Résultat financier", -50), ("Impôts sur les bénéfices", -150), ("Résultat net", 100), ("Capital social", -5), ("Chiffre d'affaires", 0)])
    rows = rows.withColumn("statement", F.when(F.col("label") == "Capital social", "bilan").otherwise("compte_resultat")).withColumn("table_idx", F.when(F.col("statement") == "bilan", 1).otherwise(0))
    got = {r.check_name: r.passed for r in rules.validate(rows, spark).collect()}
    assert got["V1-003 Income equation"] and got["V3-001 Negative capital"] is False and got["V3-002 Revenue is zero"] is False and got["V4-001 Working capital"]


def test_footing(spark):
    def rows(total):
        return statement(spark, [("a", 100), ("b", 200), ("Total des x", total)]).withColumns({"section": F.lit("s"), "is_subtotal": F.col("row_idx") == 2})

    assert [r.valid for r in ordered.footing(rows(300)).collect()] == [True]
    assert [r.valid for r in ordered.footing(rows(999)).collect()] == [False]
    lone = statement(spark, [("Total des x", 5)]).withColumns({"section": F.lit("s"), "is_subtotal": F.lit(True)})
    assert [r.valid for r in ordered.footing(lone).collect()] == [None]


def test_row_sums(spark):
    got = ordered.row_sums(statement(spark, [("h", None), ("a", 1), ("b", 2), ("Total", 3), ("c", 5), ("d", 5), ("Total", 99)])).orderBy("row_idx").collect()
    assert [(r.actual, r.passed) for r in got] == [(3.0, True), (10.0, False)]


def test_variation(spark):
    rows = spark.createDataFrame([("d", 0, "x", 113.33, 100.0, 13.3, "13,3%"), ("d", 1, "y", 120.0, 100.0, 50.0, "5'0")], "doc_id string, row_idx int, label string, current double, prior double, reported double, variation string")
    assert [r.passed for r in ordered.variation_check(rows).orderBy("row_idx").collect()] == [True, False]
    assert [r.variation for r in ordered.correct_variation(rows).orderBy("row_idx").collect()] == ["13,3%", "+20,0%"]


def test_explode_merged_rows(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc", "x", "1\n2"), (2, "a\nb", "y", "z")], "k int, p string, q string, r string")
    got = sorted(map(tuple, ordered.explode_merged_rows(rows, ["k"], ["p", "q", "r"]).collect()))
    assert got == [(1, 0, "a", "x", "1"), (1, 1, "b", "x", "2"), (1, 2, "c", "x", ""), (2, 0, "a\nb", "y", "z")]


def test_page_merge(spark):
    def tables(second, header="Label Net", offsets=(1.0, 2.0)):
        data = [("d", 0, 0, ["Label", "Net"], [1.0, 2.0], [["x", "1"], ["y", "2"]]), ("d", second, 0, ["a", "b"], list(offsets) if offsets else None, [header.split(), ["z", "3"]])]
        return spark.createDataFrame(data, "doc_id string, page int, table_idx int, columns array<string>, x_offsets array<double>, rows array<array<string>>")

    got = [(r.merged, r.row_idx, [(c.name, c["value"]) for c in r.cells]) for r in ordered.merge_pages(tables(1)).orderBy("merged", "row_idx").collect()]
    assert got == [(0, 0, [("Label", "x"), ("Net", "1")]), (0, 1, [("Label", "y"), ("Net", "2")]), (0, 2, [("Label", "z"), ("Net", "3")])]
    assert {r.merged for r in ordered.merge_pages(tables(5)).collect()} == {0, 1}
    assert ordered.merge_pages(tables(1, "p q", None)).count() == 4  # neutral signals go on, the first row is data
    assert {r.merged for r in ordered.merge_pages(tables(1, "p total", (50.0, 90.0))).collect()} == {0, 1}


def test_fuzzy_cascade(spark):
    terms = spark.createDataFrame([("Immobilisations incorporelles", "actifs_non_courants", "bilan", [], 0), ("Revenus", "r", "compte_resultat", ["Chiffre d'affaires"], 1), ("Capital social", "capitaux_propres", "bilan", [], 2)], TERMS)
    labels = spark.createDataFrame([("Capital social",), ("chiffre d'affaires",), ("Immobilisation incorporelle",), ("zzz qqq",), ("",)], "label string")
    got = {r.label: (r.canonical, r.match_type) for r in match.fuzzy_match(labels, terms).collect()}
    assert got["Capital social"] == ("Capital social", "exact")
    assert got["chiffre d'affaires"] == ("Revenus", "resolved")
    assert got["Immobilisation incorporelle"] == ("Immobilisations incorporelles", "fuzzy")
    assert got["zzz qqq"][1] == "custom" and got[""][1] == "unrecognized"


def test_fuzzy_rules(spark):
    """Scope, customs and approved meanings by the label as written, canonical forms only by similarity."""
    terms = spark.createDataFrame([("Immobilisations incorporelles", "actifs_non_courants", "bilan", ["Actifs incorporels"], 0), ("Autres créances", "actifs_courants", "bilan", [], 1), ("Autres dettes", "passifs_courants", "bilan", [], 2), ("Autres", "passifs_courants", "bilan", ["Autres créances"], 3)], TERMS)
    labels = spark.createDataFrame([("Mon poste libre", None), ("mon poste libre", None), ("Actif incorporels", None), ("Autres créances", "passifs_courants"), ("Autres créances", "nowhere"), ("machin", None), ("truc", None)], "label string, section string")
    customs = spark.createDataFrame([("Mon poste libre",)], "label string")
    approved = spark.createDataFrame([("machin", "Autres dettes"), ("truc", "no such term")], "raw_text string, matched_to string")
    got = {(r.label, r.section): (r.canonical, r.match_type, round(r.match_confidence, 2)) for r in match.fuzzy_match(labels, terms, approved, customs).collect()}
    assert got[("Mon poste libre", None)] == (None, "custom", 0.0) and got[("machin", None)] == ("Autres dettes", "resolved", 0.98)
    assert got[("Actif incorporels", None)][1] in ("custom", "fuzzy") and got[("Actif incorporels", None)][2] != 0.97
    assert got[("Autres créances", "passifs_courants")] == ("Autres", "resolved", 0.98) and got[("Autres créances", "nowhere")] == ("Autres créances", "exact", 1.0)
    assert got[("truc", None)][1] == "custom"


def test_wildcards(spark):
    terms = spark.createDataFrame([("Résultat", "r", "bilan", [], 0), ("Stocks", "a", "bilan", [], 1), ("Résultat de l'exercice", "r", "bilan", [], 2), ("pane", None, "bilan", [], 3), ("pine", None, "bilan", [], 4)], TERMS)
    labels = spark.createDataFrame([("R?sultat",), ("St�cks",), ("Zz?",), ("R?s?lt?t de l'exercice",), ("p?ne",)], "label string")
    got = {r.label: (r.hits, r.best, round(r.confidence, 2)) for r in match.wildcard_join(labels, terms).collect()}
    assert got["R?sultat"] == (1, "Résultat", 0.99) and got["St�cks"] == (1, "Stocks", 0.99) and got["Zz?"] == (0, "Zz?", 0.5)
    assert got["R?s?lt?t de l'exercice"] == (1, "Résultat de l'exercice", 0.8) and got["p?ne"] == (2, "pane", 0.8)


def test_classify(spark):
    rows = spark.createDataFrame([("a", "Total actif", None), ("a", "Capitaux propres", None), ("b", "Charges de personnel", None), ("c", "xyz", None)], "doc_id string, label string, statement string")
    got = {r.doc_id: (r.label, r.strict) for r in match.classify_statements(rows, ["doc_id"]).collect()}
    assert got == {"a": ("bilan", "bilan"), "b": ("compte_resultat", "compte_resultat"), "c": ("unknown", "unknown")}


def test_alignment(spark):
    schema = "doc_id string, row_idx int, label string, canonical string, section string"
    a = spark.createDataFrame([("d", 0, "Stocks", "Stocks", None), ("d", 1, "Custom Row Foo", None, None), ("d", 2, "aaa", None, "s"), ("d", 3, "only here", None, "t")], schema)
    b = spark.createDataFrame([("d", 0, "Custom Row Foo!", None, None), ("d", 1, "stoks", "Stocks", None), ("d", 2, "zzz", None, "s")], schema)
    got = {(r.a_idx, r.b_idx): r.method for r in align.align_rows(a, b, ["doc_id"]).collect()}
    assert got == {(0, 1): "canonical", (1, 0): "text", (2, 2): "position", (3, None): "a_orphan"}


def test_votes(spark):
    cells = spark.createDataFrame([(1, "a", 0.5, 10.0), (1, "b", 0.3, 10.5), (1, "c", 0.2, 99.0), (2, "a", 0.4, 1.0), (2, "b", 0.3, 9.0), (2, "c", 0.3, 9.0)], "k int, source string, weight double, value double")
    got = {r.k: (r.value, r.delta, r.flag) for r in align.vote_cells(cells, ["k"]).collect()}
    assert got == {1: (10.0, 0.2, "yellow"), 2: (9.0, 0.4, "yellow")}


def test_green_flag(spark):
    def gate(*v):
        return spark.range(1).select(*[c.alias(k) for k, c in route.green_flag(*[F.lit(x) for x in v]).items()]).first()

    assert gate(0.98, 0.0, 0.9, None, 0.8).green
    assert gate(0.70, 0.0, 0.9, True, 0.8).reasons == ["match_rate"]
    assert gate(0.98, 0.05, 0.9, True, 0.8).reasons == ["parse_failures"]


def test_enrichment(spark):
    terms = spark.createDataFrame([("Stocks", "actifs_courants", "bilan", [], 0), ("Clients", "actifs_courants", "bilan", [], 1)], TERMS)
    data = [("ACTIFS COURANTS", ""), ("Stocks", "100"), ("Clients", "200"), ("Total des actifs courants", "300")]
    rows = spark.createDataFrame([("d", "a", 0, i, l) for i, (l, _) in enumerate(data)], "doc_id string, source string, table_idx int, row_idx int, label string")
    cells = spark.createDataFrame([("d", "a", 0, i, c, x) for i, r in enumerate(data) for c, x in enumerate(r)], "doc_id string, source string, table_idx int, row_idx int, col_idx int, raw_value string")
    got = route.enrich(rows, cells, terms, [("actifs_courants", "actifs courants")]).orderBy("row_idx").collect()
    assert [r.section for r in got] == ["actifs_courants"] * 4
    assert [r.match_type for r in got][1:3] == ["exact", "exact"] and got[3].footing_valid and got[3].flag == "green"


def test_state_machine(spark):
    docs = spark.createDataFrame([("a", "draft", 1), ("b", "archived", 2)], "document_id string, status string, version int")
    commands = spark.createDataFrame([("a", "validated", 1), ("b", "draft", 2), ("a", "validated", 9), ("x", "validated", 1)], "document_id string, target string, version int")
    got = sorted((r.document_id, r.version, r.code) for r in store.transition(docs, commands).collect())
    assert got == [("a", 1, 200), ("a", 9, 412), ("b", 2, 409), ("x", 1, 404)]


def test_promotions(spark):
    log = spark.createDataFrame([("r", "A")] * 3 + [("s", "A")] * 3 + [("s", "B")] + [("t", "A")] * 2, "raw_text string, matched_to string")
    assert [tuple(r) for r in store.promotable(log).collect()] == [("r", "A", 3)]


def test_url_guard(spark):
    urls = ["https://example.com/x", "http://127.0.0.1/", "ftp://example.com", "http://10.1.2.3", "http://localhost:8", None, "http://172.20.0.1/", "http://[::1]/", "http://[fd00::1]:80/x", "http://x.internal", "http://printer.local/", "http://224.0.0.1", "http://[2606:4700::1111]/", "https://u:p@example.com:8443", "http://8.8.8.8", "http://", "http://[::ffff:10.0.0.1]/"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(filters.url_allowed(F.col("u"))).collect()]
    assert got == [True, False, False, False, False, None, False, False, False, False, False, False, True, True, True, False, False]


def test_sources(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"raw_text":"a","matched_to":"A","approved":true}\nbroken\n')
    assert readers.variation_log(spark, str(tmp_path / "log.json")).count() == 1
    (tmp_path / "rules.json").write_text('{"rules":[{"rule_id":"V1","tier":"V1","active":true,"standards":["NCT"]},{"rule_id":"V9","active":false,"standards":["NCT"]}]}')
    assert [r.rule_id for r in readers.rules(spark, str(tmp_path / "rules.json"), "NCT").collect()] == ["V1"]
    cells = spark.createDataFrame([("d", 0, 0, "Label", "x"), ("d", 0, 1, "Net", "5")], "doc_id string, row_idx int, col_idx int, col_name string, raw_value string")
    assert readers.nested_rows(cells, ["doc_id"]).first().cells == {"Label": "x", "Net": "5"}
