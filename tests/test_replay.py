"""The replayed event table, whatever files it comes in and wherever Arrow batches cut it, against its SQL."""

from datetime import datetime, timedelta
from random import Random

import pytest

from tessera.jobs import catalog

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("files", [1, 3])
def test_changes_in_no_order_are_folded_in_order(spark, tmp_path, files):
    duckdb = pytest.importorskip("duckdb")
    draw = Random(7)
    kinds = ["signup"] * 4 + ["error"] * 4 + ["view", "purchase", "other"]
    rows = [(i, START + timedelta(seconds=draw.randrange(500)), i % 5, draw.choice(kinds)) for i in range(200)]
    draw.shuffle(rows)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    table = f"{tmp_path}/events.parquet"
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(table)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{table}/*.parquet'")
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(most)
    spark.conf.set(most, "7")
    try:
        got = sorted(map(tuple, catalog.QUERIES["stm1_streamed_changes"](spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set(most, before)
    assert got == sorted(con.execute(catalog.ORACLES["stm1_streamed_changes"]).fetchall())
