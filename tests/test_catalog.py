import pytest
from conftest import same_rows

from weft.plans import catalog


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, data, duck, name):
    same_rows(catalog.QUERIES[name](spark, data), duck, catalog.SQL[name])


@pytest.mark.parametrize("zone, years", [("UTC", 60), ("America/New_York", 0)])
def test_file_times_before_1970_and_in_other_zones(spark, duck, tmp_path, data, zone, years):
    """Minutes of times before 1970 end towards it, as in the SQL, and the session's zone changes no time."""
    con = duck.cursor()
    con.execute(f"COPY (SELECT * REPLACE (ts - to_years({years}) AS ts) FROM '{data}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE TEMP VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        same_rows(catalog.QUERIES["dedupe_priority"](spark, str(tmp_path)), con, catalog.SQL["dedupe_priority"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
