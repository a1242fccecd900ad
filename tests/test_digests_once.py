"""Digests travel once: the splits of a digest are a small set, not a second shuffle of all digests."""

from voicelake.operators import joins


def test_copies_are_grouped_once(spark):
    rows = spark.createDataFrame([("d1", "x", "r1"), ("d1", "y", "r1"), ("d1", "x", "r2"), ("d2", "x", "r3"), ("d2", "x", None), (None, "x", "r3"), (None, "y", "r4"), ("d3", None, "r4"), ("d3", "x", "r4")], "digest string, split string, rec string")
    found, met = joins.hash_dupes(rows, "digest"), joins.recording_collision(rows, "rec")
    assert sorted((r.digest, r.copies, r.splits, r.scope) for r in found.collect()) == [("d1", 3, 2, "cross_split"), ("d2", 2, 1, "within_split"), ("d3", 2, 1, "within_split")]
    assert sorted((r.rec, r.windows, r.splits) for r in met.collect()) == [("r1", 2, 2), ("r4", 3, 2)]
    for df in (found, met):
        assert df._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") <= 2  # partial and final of one grouping
