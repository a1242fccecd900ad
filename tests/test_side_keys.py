"""Claims that are written alike are parsed once and count as often as they are written."""

from collections import Counter

from voicelake.operators import identity
from voicelake.plans import standins

FOLDER = "/root/testdata/sf0.001"


def test_side_keys_have_the_language_of_row_keys(spark):
    rows = standins.manifest(spark, FOLDER)
    want = {tuple(r) for r in identity.row_keys(rows).select("split", "role", "language", "kind", "node").collect()}
    assert {tuple(r) for r in identity.side_keys(rows).select("split", "role", "language", "kind", "node").collect()} == want


def test_problem_counts_are_those_of_the_rows(spark):
    rows = standins.manifest(spark, FOLDER)
    want = Counter((r.split, r.problem) for r in identity.row_problems(rows).collect())
    assert {(r.split, r.problem): r.n for r in identity.problem_counts(rows).collect()} == want and want
