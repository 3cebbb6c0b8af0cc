"""One order, one store, one SKU, one feed and one note source hold a third of all rows."""

from __future__ import annotations

import pytest
from compare import check, connect
from conftest import SMALL

from kpisleuth.plans import all_queries
from kpisleuth.plans.registry import compose

HOT = {
    "lineitem": "SELECT * REPLACE (CASE WHEN hash(l_orderkey, l_partkey, l_linenumber) % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey, "
                "CASE WHEN hash(l_partkey, l_suppkey, l_quantity) % 3 = 0 THEN 3 ELSE l_suppkey END AS l_suppkey, "
                "CASE WHEN hash(l_suppkey, l_quantity, l_orderkey) % 3 = 0 THEN 11 ELSE l_partkey END AS l_partkey) FROM lineitem",
    "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 2 ELSE user_id END AS user_id, "
              "CASE WHEN event_id % 3 = 1 THEN 'view' ELSE event_type END AS event_type, "
              "CASE WHEN event_id % 3 = 0 THEN 5.25 ELSE value END AS value) FROM events",
    "documents": "SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN 'src0' ELSE source END AS source, "
                 "CASE WHEN doc_id % 3 = 0 THEN 'one note copied very often' ELSE text END AS text) FROM documents",
}
CHECKED = [
    "c3_store_code_changes", "c4_processed_period", "c9_reconcile", "c10_allocate", "k1_net_revenue", "k2_transactions",
    "k3_conversion_rate", "k4_avg_selling_price", "k6_qcomm_fulfilment", "k11_contribution", "d9_price_mix", "d10_rank_cells",
    "g1_completeness", "g2_incident_impact", "e4_chi_square", "e12_contradictions", "e13_concordance", "m3_sufficiency",
    "m10_did_region", "t3_resolve", "t3_misses", "t4_telemetry", "q3_orphans", "q5_duplicates", "x2_stream_freshness",
]


@pytest.fixture(scope="module")
def hot(tmp_path_factory):
    folder = tmp_path_factory.mktemp("hot")
    con = connect(SMALL)
    for (name,) in con.execute("SELECT view_name FROM duckdb_views() WHERE NOT internal").fetchall():
        con.execute(f"COPY ({HOT.get(name, f'SELECT * FROM {name}')}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    con.close()
    return str(folder)


@pytest.mark.parametrize("name", CHECKED)
def test_hot_keys_change_nothing(spark, hot, name):
    entry = all_queries()[name]
    problem, _ = check(spark, connect(hot), hot, entry.run, compose(entry.sql))
    assert problem is None, problem
