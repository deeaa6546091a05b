import duckdb
import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A small table over several partitions."""

    def make(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make


@pytest.fixture(scope="session")
def sql():
    """Rows of a query's DuckDB SQL over tables given as pandas frames."""

    def run(text, **tables):
        con = duckdb.connect()
        for name, table in tables.items():
            con.register(name, table)
        result = con.execute(text)
        return [d[0] for d in result.description], result.fetchall()

    return run
