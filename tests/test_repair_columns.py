import io
import zipfile

import duckdb
from pyspark.sql import functions as F

from finloom.operators import columns, repair, store
from finloom.plans import catalog
from finloom.sources import documents

TABLE = "doc_id string, source string, table_idx int, "


def test_vocabulary():
    v = repair.Vocabulary(["Total", "des", "actifs", "résultat", "net"])
    assert v.correct("totaldesactifs") == "total des actifs"
    assert v.correct("RESULTAT,") == "RÉSULTAT,"
    assert v.correct("resultaf") == "résultat"
    assert v.correct("(Nett)") == "(Net)"
    assert v.correct("xyzzyx") == "xyzzyx" and v.correct("12") == "12"


def test_correct_phrases(spark):
    words = spark.createDataFrame([("total",), ("des",), ("actifs",)], "word string")
    rows = spark.createDataFrame([(1, "Totaldes  actifs"), (2, "1 500,00"), (3, None), (4, "total")], "i int, label string")
    got = {r.i: (r.label, r.changed) for r in repair.correct_phrases(rows, "label", words).collect()}
    assert got == {1: ("Total des actifs", True), 2: ("1 500,00", False), 3: (None, False), 4: ("total", False)}


def test_correction_counts_of_letters_between_digits(spark, tmp_path):
    """Every letter that is read as a digit, alone and with a sign before; the query gives what its SQL gives."""
    texts = ["1O2 1o2 1l2 1I2 1S2 1B2", "=1S5 and :2B2", "1S1S1", "nothing", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_sign, r.n_glyph, r.n_corrections) for r in repair.correction_counts(docs).collect()}
    assert got == {0: ("102 102 112 112 152 182", 0, 6, 6), 1: ("-155 and -282", 2, 2, 4), 2: ("151S1", 0, 1, 1), 3: ("nothing", 0, 0, 0), 4: ("", 0, 0, 0)}
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    rel = con.sql(catalog.ORACLES["correction_stats"])
    assert sorted(map(tuple, catalog.correction_stats(spark, str(tmp_path)).select(*rel.columns).collect())) == sorted(rel.fetchall())


def layout(spark, headers, rows):
    h = spark.createDataFrame([("d", "s", 0, i, n) for i, n in enumerate(headers)], TABLE + "col_idx int, col_name string")
    c = spark.createDataFrame([("d", "s", 0, r, i, v) for r, row in enumerate(rows) for i, v in enumerate(row)], TABLE + "row_idx int, col_idx int, raw_value string")
    return columns.identify(c, h).first(), h, c


def test_layouts(spark):
    got, h, c = layout(spark, ["Désignation", "Brut", "Amortissement", "Net"], [["Stocks et en cours", "100", "10", "90"]] * 3)
    assert (got.model, got.confidence, got.label_col) == ("brut_amort_net", 0.95, 0) and got.numeric_cols == [1, 2, 3]
    from finloom.operators import filters

    assert columns.value_column(h, filters.numeric_columns(c)).first().value_col == 3
    got, _, _ = layout(spark, ["Libellé", "Note", "Exercice N", "Exercice N-1"], [["Ventes de marchandises", "1", "100", "90"]] * 3)
    assert got.model == "n_n1" and got.confidence == 0.90
    got, _, _ = layout(spark, ["aaaa", "bbbb"], [["text only", "more text"]] * 3)
    assert got.model == "unknown" and got.confidence == 0.30


def test_docx(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    table = "".join(f"<w:tr>{cell(a)}{cell(b)}</w:tr>" for a, b in [("Label", "Net"), ("x", "1"), ("y", "2")])
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Bilan au 31/12</w:t></w:r></w:p><w:tbl>{table}</w:tbl></w:body></w:document>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/media/a.png", b"png")
    files = spark.createDataFrame([("a.docx", "docx", bytearray(buf.getvalue())), ("b.docx", "docx", bytearray(b"broken"))], "path string, kind string, content binary")
    got = sorted((r.row_idx, r.col_name, r.raw_value) for r in documents.scan_cells(files).collect())
    assert got == [(0, "Label", "x"), (0, "Net", "1"), (1, "Label", "y"), (1, "Net", "2")]
    assert documents.document_text(documents.scan_text(files)).first().scanned
    assert documents.docx_images(buf.getvalue()) == [("word/media/a.png", b"png")]


def test_jobs(spark):
    jobs = spark.createDataFrame([(1, "running", 0), (2, "running", 1), (3, "running", 3), (4, "queued", 0)], "job_id int, status string, attempt int")
    ends = spark.createDataFrame([(1, True, None), (2, False, "e" * 9000), (3, False, "e")], "job_id int, ok boolean, error string")
    got = {r.job_id: (r.status, r.attempt, r.wait, len(r.error or "")) for r in store.job_step(jobs, ends).collect()}
    assert got == {1: ("done", 0, None, 0), 2: ("queued", 2, 2.0, 4000), 3: ("failed", 3, None, 1), 4: ("queued", 0, None, 0)}


def test_jobs_with_more_errors_than_can_be_broadcast(spark, tmp_path):
    """12 MB of errors, which Spark plans as 20 bytes each, where 4 MB can be broadcast; the query gives what its SQL gives."""
    kind = F.get(F.array(*map(F.lit, ["error", "error", "error", "error", "purchase", "view"])), (F.col("id") % 6).cast("int"))
    spark.range(3600).select(F.col("id").alias("event_id"), kind.alias("event_type")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    rel = con.sql(catalog.ORACLES["job_steps"])
    spark.conf.set("spark.sql.maxBroadcastTableSize", "4m")
    try:
        got = catalog.QUERIES["job_steps"](spark, str(tmp_path)).select(*rel.columns).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rel.fetchall()))
