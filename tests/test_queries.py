"""Registered queries against DuckDB, and the entry module without the training-data folders."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from lexiloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["wordlist_scan", "filter_script", "preprocess", "useful_docs", "title_map", "id_map_intersect", "word_stats", "tfidf", "phi", "pair_profile", "sparse_matrix", "ti_score", "cue_pmf", "pmi_pmf", "esa_pmf", "taxonomy_sim", "pivot_pmf", "mixture_fixed", "em_mixture", "em_fine", "em_cluster_steps", "label_translate", "filter_stopwords", "assign_ids", "eval_lexicon_sum", "eval_spearman", "train_test_split", "agree_kappa", "agree_alpha", "avg_label_distance", "eval_pivot"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return float(round(v, 6)) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", QUICK)
def test_same_as_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = con.sql(registry.SQL[name])
    assert sorted(want.columns) == columns
    rows = lambda x: sorted((tuple(map(plain, r)) for r in x), key=str)
    assert rows(df.select(*[f"`{c}`" for c in columns]).collect()) == rows(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_does_not_need_llm(tmp_path):
    """A copy of the repository without the training-data folders imports and lists the other queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "lexiloom"), tmp_path / "lexiloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.SQL))], out.stderr
