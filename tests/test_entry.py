"""The entry points: every query is registered once and the flagship runs."""

import duckdb
import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ("threshold_summary", "library_ratios", "disease_coverage", "codon_table",
          "normalize_conditions", "familywise_pvalues", "adapter_survey")


def test_flagship(spark):
    found = driver.entry(spark)
    assert set(found.columns) == {"quantity", "mean_difference", "ci_low", "ci_high",
                                  "consistent", "n_treated", "n_control"}


def test_oracles_belong_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_a_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("lineitem", "orders", "customer", "part", "supplier"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    mine = driver.queries()[name](spark, FOLDER).toPandas()
    theirs = con.execute(driver.oracle_sql()[name]).df()
    from tools.compare import difference

    assert difference(mine, theirs) == ""
