"""Registered queries against their SQL on the small tables; RELISH_ALL=1 runs every one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, compare
from relish import queries as registry

SF = "/root/testdata/sf0.001"
QUICK = ("naive_topn", "naive_exclude_ci", "variety_topn", "naive_eval", "catalog_clean", "catalog_prep", "interactions_prep",
         "neg_sample_eval", "sampled_rank_eval", "ncf_forward", "ncf_topn", "vec_recommend", "vec_explain", "naive_request",
         "dispatch_batch", "src_reviews_csv", "src_bulk_csv", "stream_rate_5s", "stream_item_mean", "split_exact_ratio",
         "last_rating_per_item", "one_hot_unknown", "feature_matrix", "valid_ratings", "rf_recommend", "src_probe", "src_probe_rows",
         "sink_versions", "catalog_sparse", "feature_matrix_sparse", "stream_outbox")
NAMES = tuple(registry.ORACLES) if os.environ.get("RELISH_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 200 * 5


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    text, ok = compare(spark, duck, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text
