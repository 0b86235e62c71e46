"""Registered queries that run over whole tables, against their SQL."""

import collections

import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def both(spark, name, table):
    """Rows of a query, and of its SQL over the table."""
    duck = duckdb.connect()
    duck.execute("SET TimeZone = 'UTC'")
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    assert got.columns == [c[0] for c in want.description]
    return collections.Counter(map(tuple, got.collect())), collections.Counter(want.fetchall())


def test_all_expressions(spark):
    got, want = both(spark, "expressions_evaluated", "lineitem")
    assert got == want and sum(got.values()) == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_all_jobs(spark):
    got, want = both(spark, "job_replay", "events")
    assert got == want and sum(got.values()) == spark.read.parquet(f"{SF}/events.parquet").count()


def test_tree_tables_are_parsed_once_and_never_broadcast(spark):
    """What Spark takes a parsed table's size to be is that of its compressed input: a broadcast of it filled the driver."""
    got, want = both(spark, "tree_relations", "part")
    plan = entry.queries()["tree_relations"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert got == want and "MapInArrow" not in plan and "Broadcast" not in plan
