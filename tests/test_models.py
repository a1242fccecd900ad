"""Scoring under a release, against plain numpy."""

import numpy as np

from voicelake.operators import models
from voicelake.plans import standins
from voicelake.plans.catalog import QUERIES
from voicelake.plans.stream_queries import release_rows

FOLDER = "/root/testdata/sf0.001"


def test_files_are_scored_under_the_contract(spark):
    rows = release_rows(spark, FOLDER)
    train = rows.where("part = 'train' AND usable").collect()
    contract = models.release(rows.where("part = 'train' AND usable"), "vec", "label", "language", 0.5, 4)
    assert contract.languages == ("bn", "hi", "ta")
    got = {r.file_id: r for r in models.score_files(contract, rows.where("part = 'new'"), "vec", "usable", "language").collect()}
    table = np.array([r.vec for r in train], dtype=float)
    mean, deviation = table.mean(axis=0), table.std(axis=0, ddof=1)
    fitted = contract.model.stages[-1]
    files = {}
    for r in rows.where("part = 'new'").collect():
        files.setdefault(r.file_id, []).append(r)
    assert set(got) == set(files) and not set(files) & {r.file_id for r in train}
    for file, frames in files.items():
        good = [r for r in frames if r.usable]
        row = got[file]
        assert (row.chunks, row.usable) == (len(frames), len(good))
        language = frames[0].language
        assert row.coverage == ("language_not_given" if language is None else "trained_language" if language in ("hi", "bn", "ta") else "language_not_in_training")
        if len(good) < 4:
            assert row.score is None and row.decision == "insufficient"
            continue
        margin = (np.array([r.vec for r in good], dtype=float) - mean) / deviation @ fitted.coefficients.toArray() + fitted.intercept
        score = (1 / (1 + np.exp(-margin))).mean()
        assert abs(row.score - score) < 1e-6 and row.decision == ("spoof" if score >= 0.5 else "genuine")
    assert {r.decision for r in got.values()} == {"spoof", "genuine", "insufficient"}
    assert {r.coverage for r in got.values()} == {"trained_language", "language_not_given", "language_not_in_training"}


def test_the_margin_is_kept_whole(spark):
    rows = release_rows(spark, FOLDER)
    model = models.fit(rows.where("part = 'train'"), "vec", "label")
    report = models.evaluate(models.score(model, rows.where("part = 'train'"), "vec")).first()
    assert report["auroc"] > 0.6 and report["cross_entropy"] < np.log(2)


def test_linear_baseline_against_plain_newton_steps(spark):
    from pyspark.sql import functions as F

    rows = standins.frames(spark, FOLDER).select("vec", F.col("label").cast("int"), (F.pmod(F.xxhash64("frame"), F.lit(5)) == 0).alias("held")).collect()
    x, y, held = np.array([r.vec for r in rows], dtype=float), np.array([r.label for r in rows]), np.array([r.held for r in rows])
    x = (x - x[~held].mean(axis=0)) / x[~held].std(axis=0, ddof=1)
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = 0.01 * np.diag([1.0] * (x.shape[1] - 1) + [0.0])
    w, a, b = np.zeros(x.shape[1]), x[~held], y[~held]
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T * (p * (1 - p)) @ a / len(a) + ridge, a.T @ (p - b) / len(a) + ridge @ w)
    margin = x @ w
    got = {r.part: r.asDict() for r in QUERIES["linear_baseline"](spark, FOLDER).collect()}
    assert set(got) == {"train", "held_out"}
    for part, chosen in (("train", ~held), ("held_out", held)):
        m, label = margin[chosen], y[chosen]
        loss = np.logaddexp(0, np.where(label == 1, -m, m)).mean()
        spoof, genuine = m[label == 1], m[label == 0]
        area = ((spoof[:, None] > genuine).mean() + 0.5 * (spoof[:, None] == genuine).mean())
        assert abs(got[part]["cross_entropy"] - loss) < 1e-3 and abs(got[part]["auroc"] - area) < 2e-3
        assert got[part]["tp"] + got[part]["fn"] == (label == 1).sum() and abs(got[part]["tp"] - ((m >= 0) & (label == 1)).sum()) <= 1
