"""What the driver holds while a job of many steps runs."""

import gc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import common, jaccard_join


@pytest.mark.parametrize("filled", [0.0, 1.0])
def test_garbage_of_finished_steps_is_collected_once_it_fills_a_share_of_the_heap(spark, monkeypatch, filled):
    monkeypatch.setattr(common, "_FILLED", filled, raising=False)
    monkeypatch.setattr(common, "_left", {}, raising=False)
    jvm = spark._jvm
    garbage = spark.sparkContext._gateway.new_array(jvm.long, 1000)
    held = jvm.java.lang.ref.SoftReference(garbage) if filled else jvm.java.lang.ref.WeakReference(garbage)
    del garbage
    gc.collect()
    with common.scratch(spark):
        assert common.saved(spark.range(10), "few").count() == 10
    assert (held.get() is None) == (not filled)


def test_tables_of_slots_are_packed_in_the_driver(spark):
    slots = [0, 7, 8, 32767, 32768, 99_999, (1 << 20) - 1]
    df = spark.createDataFrame([(s,) for s in slots * 2], "slot long")
    for bits in (20, jaccard_join._CROWD_BITS):
        got = jaccard_join._table(df, bits)
        assert got.nbytes == (1 << bits) // 8
        assert np.flatnonzero(np.unpackbits(got, bitorder="little")).tolist() == slots


def test_only_hashes_of_the_asked_slots_are_shown(spark):
    rng = np.random.default_rng(5)
    h = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))
    df = spark.createDataFrame([(1, len(h), bytearray(h.tobytes())), (2, 0, bytearray())], "id long, n int, window binary")
    few = h[::7]
    rows, slots = jaccard_join._asked(df.select("id", "n", F.lit(bytearray(few.tobytes())).alias("window")).where("id = 1"))
    assert {r["s"] for r in rows.collect()} == set(few.view(np.int64).tolist())
    asked = set((few >> np.uint64(63 - jaccard_join._CROWD_BITS)).tolist())
    want = [x for x in h.tolist() if x >> (63 - jaccard_join._CROWD_BITS) in asked]
    assert sorted(r["s"] for r in jaccard_join._rows(df, only=slots).collect()) == want


def test_garbage_is_looked_for_within_a_long_step(spark, monkeypatch):
    def slow(batches):
        import time

        time.sleep(4)
        yield from batches

    calls = []
    monkeypatch.setattr(common, "_EVERY", 0.2, raising=False)
    monkeypatch.setattr(common, "_watching", {}, raising=False)
    monkeypatch.setattr(common, "tidied", lambda session: calls.append(list(common._writing)))
    with common.scratch(spark):
        assert common.saved(spark.range(10).coalesce(1).mapInArrow(slow, "id long"), "slow").count() == 10
    assert len(calls) > 5 and all(calls[:5])
    monkeypatch.undo()
    assert common._writing == []
