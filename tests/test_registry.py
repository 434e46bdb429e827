"""The registered queries on the smallest tables, against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as registry
import check

SMALL = "/root/testdata/sf0.001"
# One query per family; check.py runs all of them.
CHOSEN = (
    "b6_mutual_edges c8_cum_lookup d13_gini f3_choose_seeds i2_lmsi_mutual_hop_cost j9_summary "
    "k3_training_vectors l2_fleiss_kappa"
).split()


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    own = {n for m in registry.MODULES for n in m.QUERIES}
    missing = own - set(registry.oracle_sql())
    assert missing == {
        "j7_bootstrap_multinomial", "j10_sweep_waves_full",
        "k9_random_forest", "k11_prediction_table", "k11_snowball_classification",
    }


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    assert check.compare(spark, con, name, SMALL).startswith("ok")
