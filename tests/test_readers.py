"""Batches in order, and readers that share an epoch."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelspark.operators import records


@pytest.fixture(scope="module")
def samples(spark):
    rows = [("one" if i % 5 else "two", f"same-prefix-{i:04}", float(i)) for i in range(101)] + [("two", "same-prefix-0000", -1.0)]
    return spark.createDataFrame(rows, "country string, patch_id string, x double").repartition(5)


def test_places_are_those_of_the_order(samples):
    rows = sorted(records.in_order(samples).collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(102))
    keys = [(r.country, r.patch_id) for r in rows]
    assert keys == sorted(keys)
    one, other = ({(r.patch_id, r.x): r.place for r in records.in_order(df, 3, training=True).collect()} for df in (samples, samples.coalesce(1)))
    assert one == other != {(r.patch_id, r.x): r.place for r in records.in_order(samples, 4, training=True).collect()}
    assert sorted(one.values()) == list(range(102))


def test_keys_with_one_beginning_are_dealt_to_many_tasks(samples):
    plan = records.in_order(samples)._jdf.queryExecution().toString()
    assert "substring(patch_id" not in plan
    assert records.in_order(samples.limit(0)).count() == 0


@pytest.mark.parametrize("training", [True, False])
def test_readers_share_an_epoch(samples, training):
    for readers in (1, 3, 4):
        rows = records.dealt(samples, 8, readers, 1, training=training).collect()
        assert len(rows) == 102 and len({(r.country, r.patch_id, r.x) for r in rows}) == 102
        sizes = np.bincount([r.reader for r in rows], minlength=readers)
        assert sizes.max() - sizes.min() <= 1
        for reader in range(readers):
            own = sorted((r.batch, r.place) for r in rows if r.reader == reader)
            assert own == [(k // 8, k % 8) for k in range(len(own))]


def test_readers_run_together_and_see_their_batches_in_order(spark, samples):
    from pyspark import BarrierTaskContext

    def consume(reader, batches):
        everyone = sorted(int(a) for a in BarrierTaskContext.get().allGather(str(reader)))
        for k, batch in enumerate(batches):
            assert set(batch.column("batch").to_pylist()) == {k} and batch.column("place").to_pylist() == list(range(batch.num_rows))
            yield pa.RecordBatch.from_pydict({"reader": [reader], "readers": [len(everyone)], "batch": [k], "n": [batch.num_rows], "x": [sum(batch.column("x").to_pylist())]})

    parts = records.dealt(samples, 8, 3, 2)
    want = parts.groupBy("reader", "batch").agg(F.count("*").alias("n"), F.sum("x").alias("x"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = records.read_together(parts, 3, consume, "reader long, readers long, batch long, n long, x double").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.readers for r in got} == {3}
    assert {(r.reader, r.batch): (r.n, r.x) for r in got} == {(r.reader, r.batch): (r.n, r.x) for r in want.collect()}


def test_a_reader_that_fails_is_heard(samples):
    def consume(reader, batches):
        raise RuntimeError("no weights")
        yield

    with pytest.raises(Exception, match="no weights"):
        records.read_together(records.dealt(samples, 8, 2), 2, consume, "x long").collect()
