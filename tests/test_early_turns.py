"""Synthetic rows come from the first turns of the generators where these give enough, and from a whole walk elsewhere."""

from voicelake.operators import select


def test_synthetic_rows_are_walked_whole_only_where_they_are_missing(spark, monkeypatch):
    rows = [("a", f"a{i:03}", f"s{i}", f"t{i}", f"g{i % 2}", f"c{i // 3}") for i in range(60)]
    rows += [("b", f"b{i:03}", "s0" if i < 30 else f"s{i}", f"t{i}", "g0", "c0" if i < 34 else f"c{i}") for i in range(40)] + [("c", f"c{i}", None, f"t{i % 2}", "g0", "c0") for i in range(5)]
    df = spark.createDataFrame(rows, "language string, row_id string, source_speaker string, target_speaker string, generator string, component string")
    seen = []
    run = lambda: sorted((r.language, r.row_id, r.turn, r["pass"], r.rank) for r in select.select_synthetic(df, ["language"], "row_id", 6, 2, 2, "component", 3, lambda few: seen.append(few) or few).collect())
    whole = run()
    assert len(seen) == 1 and len(whole) == 16
    monkeypatch.setattr(select, "GROUP_LIMIT", 8)
    assert run() == whole
    assert [f.select("language").distinct().count() for f in seen[1:]] == [3, 1]  # language b alone is walked whole
