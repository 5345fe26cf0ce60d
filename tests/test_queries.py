"""Registered queries against DuckDB at the smallest scale.

STYLEGRAPH_ALL=1 runs every query; by default one per area runs.
"""

import os

import pytest

from oracle import compare, connect
from stylegraph.registry.all import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
SOME = ["dbscan", "eps_sweep", "silhouette_cosine", "cluster_tfidf", "explain_documents",
        "explain_prediction", "model_performance", "attribution_eer_auc", "author_pair_score",
        "greedy_select_by_class", "gain_mmd", "extract_levels", "chunk_text", "read_documents",
        "group_by_author", "split_authors", "select_sweep_point", "affinity", "mine_phrases"]
NAMES = list(SQL) if os.environ.get("STYLEGRAPH_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, SQL[name]) is None


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
