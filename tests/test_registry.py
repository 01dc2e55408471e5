import __spark_entry__ as entry


def test_every_query_is_callable_and_every_sql_has_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 180 and set(sql) <= set(queries) and all(callable(q) for q in queries.values())


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"cell_type", "n_cells", "mean_log_total"}
