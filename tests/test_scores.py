"""Metrics on small cases with known answers."""

import pytest
from voicelake.operators import scores as sc

CASES = [
    ([0.1, 0.9], [0, 1], 0.0, 1.0),
    ([0.9, 0.1], [0, 1], 1.0, 0.0),
    ([0.5] * 4, [0, 1, 0, 1], 0.5, 0.5),
    ([0.95, 0.7, 0.35, 0.15], [1, 0, 1, 0], 0.5, 0.75),
    ([0.2, 0.8], [0, 0], None, None),
    ([0.85, 0.65, 0.3, 0.05], [0, 0, 1, 1], 1.0, 0.0),
]


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(i, float(s), l) for i, (scores, labels, _, _) in enumerate(CASES) for s, l in zip(scores, labels)]
    return spark.createDataFrame(rows, "case int, score double, label int").cache()


def test_eer_and_auroc(cases):
    eer = {r["case"]: r["eer"] for r in sc.eer(cases, ["case"]).collect()}
    auc = {r["case"]: r["auroc"] for r in sc.auroc(cases, ["case"]).collect()}
    for i, (_, _, want_eer, want_auc) in enumerate(CASES):
        assert eer[i] == pytest.approx(want_eer) if want_eer is not None else eer[i] is None
        assert auc[i] == pytest.approx(want_auc) if want_auc is not None else auc[i] is None


def test_both_sweeps_agree(cases):
    down = {r["case"]: r["eer"] for r in sc.eer(cases, ["case"]).collect()}
    up = {r["case"]: r["eer"] for r in sc.eer_ascending(cases, ["case"]).collect()}
    assert all(up[c] == pytest.approx(down[c]) for c in up)


def test_threshold_and_rates(cases):
    best = {r["case"]: r for r in sc.select_threshold(cases, ["case"]).collect()}
    assert best[3]["threshold"] == pytest.approx(0.7) and best[3]["far"] == 0.5 and best[3]["miss"] == 0.5
    assert 4 not in best
    rates = {r["case"]: r for r in sc.confusion_at(cases, 0.5, ["case"], absent_as_null=True).collect()}
    assert rates[4]["far"] == 0.5 and rates[4]["miss"] is None
    zero = {r["case"]: r for r in sc.error_rates(cases, 0.5, ["case"]).collect()}
    assert zero[4]["miss"] == 0.0


def test_bootstrap_of_perfect_rows_is_one_and_repeats(spark):
    rows = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.9), ("b", 0, 0.2), ("c", 1, 0.8)], "component string, label int, score double")
    first = sorted(map(tuple, sc.cluster_bootstrap(rows, "component", 50).collect()))
    assert first == sorted(map(tuple, sc.cluster_bootstrap(rows, "component", 50).collect()))
    assert [r[1:3] for r in first if r[0] == "accuracy"] == [(1.0, 1.0)]


def test_chunk_aggregate_breaks_ties_by_position(spark):
    rows = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.9), (1, 2, 0.9), (1, 3, 0.1)], "file_id long, chunk long, score double")
    got = sc.chunk_aggregate(rows, top_k=2).first()
    assert (got["max_chunk"], got["topk_chunks"], got["mean"]) == (1, "1,2", pytest.approx(0.6))


@pytest.mark.parametrize("fan_out", [256, 3])
def test_multinomial_draws_agree_with_draws_per_slot(spark, fan_out):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(f"c{i}", float(s), int(y)) for i in range(300) for s, y in zip(rng.random(1 + i % 3), rng.integers(0, 2, 3))]
    df = spark.createDataFrame(rows, "component string, score double, label int")
    drawn = sc.component_draws(df, "component", 1500, fan_out=fan_out)
    assert drawn.where("components <> 300").count() == 0 and drawn.count() == 1500
    again = sc.component_draws(df.repartition(5), "component", 20, fan_out=fan_out).collect()
    assert sorted(again) == sorted(drawn.where("draw < 20").collect()) and len({tuple(r)[2:] for r in again}) > 10
    got = {r.metric: (r.low, r.high) for r in sc.draw_intervals(drawn).collect()}
    counts = {}
    for c, s, y in rows:
        counts.setdefault(c, np.zeros(4))[(2 * y) + int(np.float32(s) >= np.float32(0.5))] += 1
    table = np.array(list(counts.values()))
    sums = np.array([table[rng.integers(0, 300, 300)].sum(axis=0) for _ in range(1500)])
    accuracy = (sums[:, 0] + sums[:, 3]) / sums.sum(axis=1)
    assert np.allclose(got["accuracy"], np.percentile(accuracy, [2.5, 97.5]), atol=0.01)


def test_no_component_has_no_draw(spark):
    assert sc.component_draws(spark.createDataFrame([], "component string, score double, label int"), "component").count() == 0
