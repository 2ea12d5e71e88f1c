"""Every query against its SQL."""

import pytest

from keystrata.plans import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf, duck, same, name):
    wanted = duck.sql(queries.ORACLES[name]).df()
    assert len(wanted), "nothing compared with nothing"
    same(queries.QUERIES[name](spark, sf).toPandas(), wanted)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["latest_stream", "hot_keys_stream", "age_histogram"])
def test_any_session_zone_and_a_second_run(spark, sf, duck, same, name):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        same(queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.ORACLES[name]).df())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_entry(spark):
    import __spark_entry__

    flagship = __spark_entry__.entry(spark)
    assert flagship.columns[:2] == ["key", "seqno"] and flagship.count() > 0
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
