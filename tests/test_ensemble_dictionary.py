import json

from pyspark.sql import functions as F

from finloom.operators import align
from finloom.sources import dictionary


def test_ensemble(spark):
    rows = spark.createDataFrame(
        [("d", 0, s, i, l, None, "s", l == "Total") for s, labels in {"x": ["Stocks", "Clients", "Total"], "y": ["Clients", "Stocks"], "z": ["Stocks", "Clients", "Total", "Extra lines"]}.items() for i, l in enumerate(labels)],
        "doc_id string, table_idx int, source string, row_idx int, label string, canonical string, section string, is_subtotal boolean",
    )
    weights = spark.createDataFrame([("x", 0.5), ("y", 0.3), ("z", 0.2)], "source string, weight double")
    value = {("x", 0): 10, ("x", 1): 20, ("x", 2): 30, ("y", 0): 20, ("y", 1): 10, ("z", 0): 99, ("z", 1): 20, ("z", 2): 30, ("z", 3): 7}
    cells = spark.createDataFrame([("d", 0, s, i, "Net", float(v)) for (s, i), v in value.items()], "doc_id string, table_idx int, source string, row_idx int, col_name string, value double")
    assert align.anchors(rows, weights).first().source == "x"
    got = {r.group_id: (r.value, r.delta, r.flag) for r in align.ensemble(rows, cells, weights).collect()}
    assert got == {"a:0": (10.0, 0.2, "yellow"), "a:1": (20.0, 0.0, "green"), "a:2": (30.0, 0.0, "green"), "z:3": (7.0, 0.0, "yellow")}
    heads = {r.group_id: (r.label, r.is_subtotal, r.members) for r in align.vote_groups(align.row_groups(rows, weights), weights).collect()}
    assert heads["a:2"] == ("Total", True, 2) and heads["z:3"] == ("Extra lines", False, 1)


def test_merge_rows(spark):
    schema = "doc_id string, row_idx int, label string, canonical string, section string"
    a = spark.createDataFrame([("d", 0, "Stok", None, None), ("d", 1, "Ventes", "Ventes", None)], schema)
    b = spark.createDataFrame([("d", 0, "Stock", "Stocks", "x"), ("d", 1, "Achats", "Achats", None), ("d", 2, "zzzzzzzz", None, None)], schema)
    pairs = spark.createDataFrame([("d", 0, 0, "text"), ("d", 1, 1, "position"), ("d", None, 2, "b_orphan")], "doc_id string, a_idx int, b_idx int, method string")
    got = sorted((r.b_idx, r.label, r.conflict, r.flag) for r in align.merge_rows(pairs, a, b, ["doc_id"]).collect())
    assert got == [(0, "Stock", False, "green"), (1, "Ventes", True, "red"), (2, "zzzzzzzz", False, "yellow")]


def test_dictionary(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"entries": [{"canonical": "Stocks", "section": "ac", "statement": "bilan", "variations": ["Stock"]}, {"canonical": "Ventes", "statement": "compte_resultat"}]}))
    found = dictionary.terms(spark, str(tmp_path / "t.json"))
    assert [(r.canonical, r.ord, r.variations) for r in found.orderBy("ord").collect()] == [("Stocks", 0, ["Stock"]), ("Ventes", 1, [])]
    assert dictionary.prompt_vocabulary(found).first().prompt == "- Stocks\n- Ventes"
    (tmp_path / "a.json").write_text(json.dumps({"accounts": {"1": "Capital", "10": "Capital social"}}))
    assert {(r.code, r.parent) for r in dictionary.accounts(spark, str(tmp_path / "a.json")).collect()} == {("1", None), ("10", "1")}
    sections = spark.createDataFrame([("ac", "actif")], "section string, side string")
    assert {r.keyword for r in dictionary.side_keywords(found, sections).collect()} == {"stocks", "stock"}
