"""Recordings repeat their identity: distinct identities are looked up, not recordings."""

from voicelake.operators import joins
from voicelake.plans import join_queries, standins


def test_anti_exposure_looks_identities_up_once(spark, monkeypatch):
    seen, real = [], joins.anti_exposure
    monkeypatch.setattr(joins, "anti_exposure", lambda rows, keys, *rest: seen.append(keys) or real(rows, keys, *rest))
    join_queries.anti_exposure(spark, "/root/testdata/sf0.001")
    rows = standins.inventory(spark, "/root/testdata/sf0.001")
    assert seen[0].count() == 3 * rows.select("language", "speaker", "record_id", "gender").distinct().count() < 3 * rows.count()
