"""Every registered query against its SQL counterpart, and small hand-made cases."""

from decimal import Decimal

import duckdb
import pytest

from memspark.fixtures import VIEWS, needed, with_views
from memspark.library import Library
from memspark.operators.listing import activation, normalized
from memspark.plans import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


def rows_of(names, rows):
    at = [names.index(n) for n in sorted(names)]
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", [n for n in queries.OPERATORS if n in oracle_sql()])
def test_query_equals_its_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    said = duck.execute(oracle_sql()[name])
    names = [d[0] for d in said.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, said.fetchall())


def test_views_are_listed_after_what_they_need():
    assert needed(VIEWS["fx_relevant"]) == ["fx_queries"]
    assert with_views("SELECT * FROM fx_relevant").index("fx_queries AS") < with_views("SELECT * FROM fx_relevant").index("fx_relevant AS")


def test_normalized_query(spark):
    df = spark.createDataFrame([("The State of the Art, in-depth: ART",), ("",)], "q string")
    from pyspark.sql import functions as F

    assert [r.n for r in df.select(normalized(F.col("q")).alias("n")).collect()] == ["art depth state", ""]


def test_activation_falls_with_age_and_is_zero_unused(spark):
    from pyspark.sql import functions as F

    df = spark.sql("SELECT * FROM VALUES (3L, TIMESTAMP'2024-01-30'), (3L, TIMESTAMP'2023-01-30'), (0L, NULL) v(n, t)")
    a, b, c = (r.a for r in df.select(activation(F.col("n"), F.col("t"), F.lit("2024-01-31").cast("timestamp")).alias("a")).collect())
    assert a > b > c == 0.0


def test_events_keep_one_row_for_each_use(spark):
    lib = Library(spark, SF)
    assert lib.events.filter("event IN ('used', 'selected')").groupBy("trace_id", "chunk_id", "event").count().filter("count > 1").isEmpty()
    assert lib.events.filter("event LIKE 'task_%'").groupBy("trace_id").count().filter("count > 1").isEmpty()
    assert lib.events.filter("event = 'retrieved'").count() == lib.usage.filter("event = 'retrieved'").count()
