"""The registered queries over the smallest tables: contract columns, DuckDB twins, brute force where SQL has no say."""

import os

import duckdb
import pytest

from finloom.llm import registry

from . import brute

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted",
    "op2_licenses": "doc_id template license n_template n_shared containment",
    "op3_mixing": "doc_id size source_size target taken",
    "op4_html": "page_id url text n_chars",
    "op5_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op6_near_duplicates": "doc_id class_id",
    "op7_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans has_pii",
    "op8_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated n_near_items",
    "op10_line_dedup": "doc_id n_lines n_dropped kept_sha256",
}


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, rows, name):
    df = registry.QUERIES[name](spark, DIR)
    assert df.columns == COLUMNS[name].split()
    got = df.collect()
    if name == "op4_html":
        assert len(got) == 50 and all(r.n_chars == len(r.text) and r.text for r in got)
    elif name != "op2_licenses":
        assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    if name == "op5_suffix_dedup":
        assert {r.doc_id: tuple(r)[1:] for r in got} == brute.repeats(rows)
    if name == "op6_near_duplicates":
        assert {r.doc_id: r.class_id for r in got} == brute.classes(rows)
    if name == "op7_pii":
        assert {r.doc_id: ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) for r in got} == {i: brute.pii(t)[:2] for i, t in rows}
        assert {r.doc_id: r.spans for r in got} == {i: brute.all_spans(t) for i, t in rows}
    if name in registry.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
        rel = con.sql(registry.ORACLES[name])
        names = rel.columns
        assert sorted(names) == sorted(df.columns)
        assert sorted(repr(tuple(r[c] for c in names)) for r in got) == sorted(map(repr, rel.fetchall()))
