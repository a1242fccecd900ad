from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from voicelake.llm import near_dedup, quality
from voicelake.session import cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The rows after each stage, written and read again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES:
        docs = cut(stage(spark, docs, SF))
        out.append(docs)
    return out


def test_order_and_columns(steps):
    assert [name for name, _ in cp.STAGES] == ["quality rules", "line dedup", "near duplicates", "source mix", "packing"]
    for docs in steps[1:-1]:
        assert docs.dtypes == steps[0].dtypes


def test_quality_keeps_what_passes(steps):
    good = quality.ledger(steps[0], keep=("doc_id",)).where(quality.passes()).select("doc_id")
    assert sorted(steps[1].select("doc_id").collect()) == sorted(good.collect())


def plain_lines(rows, least=10):
    """Texts without the lines of runs of at least `least` words that start earlier, run by run."""
    seqs = []
    for doc, text in sorted(rows):
        lines = text.split("\n")
        seqs.append((doc, lines, [i for i, x in enumerate(lines) if x.split()]))
    first = {}
    for doc, lines, at in seqs:
        for a in range(len(at)):
            for n in range(1, least + 1):
                run = tuple(lines[i] for i in at[a : a + n])
                if len(run) == n and sum(len(x.split()) for x in run) >= least:
                    first.setdefault(run, (doc, a))
    out = {}
    for doc, lines, at in seqs:
        gone = set()
        for a in range(len(at)):
            for n in range(1, least + 1):
                run = tuple(lines[i] for i in at[a : a + n])
                if first.get(run, (doc, a)) < (doc, a):
                    gone |= set(at[a : a + n])
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_lines(steps):
    want = plain_lines([(r.doc_id, r.text) for r in steps[1].collect()])
    assert {r.doc_id: r.text for r in steps[2].collect()} == want
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_one_of_each_class(steps):
    classes = near_dedup.classes(steps[2]).collect()
    assert {r.doc_id for r in steps[3].collect()} == {r.class_id for r in classes}


def test_mix_takes_the_targets(steps):
    sizes, words = Counter(), Counter()
    for r in steps[3].collect():
        sizes[r.source] += len(r.text.split())
    for r in steps[4].collect():
        words[r.source] += len(r.text.split())
    total = 1.5 * sum(sizes.values())
    weights = dict(zip(sorted(sizes), [5, 2, 1] * len(sizes)))
    target, capped = {}, set()
    while True:
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weights[s] for s in sizes if s not in capped)
        target = {s: 2 * sizes[s] if s in capped else level * weights[s] for s in sizes}
        over = {s for s in sizes if target[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    assert all(abs(words[s] - target[s]) <= 1 for s in sizes)
    uses = Counter(r.doc_id for r in steps[4].collect())
    assert max(uses.values()) <= 2


def test_packing_holds_every_row(steps):
    assert steps[5].where("piece = 0").count() == steps[4].count()
    load = steps[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert load.where("n > 2048 OR n <> m").count() == 0


def test_run_gives_the_last_stage(spark, steps):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(cp.run(spark, SF).select(columns).collect()) == sorted(steps[5].select(columns).collect())


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_odd_and_empty_tables(spark, odd, empty, name, stage):
    got = stage(spark, odd, SF)
    assert name == "packing" or got.columns == odd.columns
    assert got.count() > 0
    assert stage(spark, empty, SF).count() == 0
