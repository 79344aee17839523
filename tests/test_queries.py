"""Queries against their SQL in DuckDB over the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

CHECKED = (
    "p5_found", "p5_report", "profile_shares", "profile_conditions", "profile_lengths", "cohort_select", "first_labs_per_patient", "upsert_first_wins", "coerced_results",
    "parsed_times", "split_examples", "lab_router", "lab_series", "lexical_two_pass", "vector_topk", "rrf_fusion", "temporal_recent", "context_window", "pooled_metrics",
    "temporal_metrics", "judge_cached", "tolerant_json", "median_votes", "sentence_split", "window_chunks", "phi_recall", "best_positive", "labelled_pairs", "audit_breakdown",
)


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck(data):
    import glob
    import os

    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    mine = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted(repr([plain(dict(zip(names, r))[c]) for c in columns]) for r in found.fetchall())
    assert mine == theirs


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
    assert {f"p{n}_found" for n in (1, 5, 6)} <= set(queries)


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_text_queries_go_alone_where_a_library_is_missing(monkeypatch):
    import builtins
    import sys

    real = builtins.__import__
    for name in [m for m in sys.modules if m.startswith("chartloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", lambda name, *a, **k: (_ for _ in ()).throw(ModuleNotFoundError(name=name)) if name == "ahocorasick" else real(name, *a, **k))
    left = set(entry.queries())
    assert "p1_found" in left and "hybrid_rrf" in left and "p3_found" not in left
