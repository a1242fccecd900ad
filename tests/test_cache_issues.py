"""Issues of a cache by split: both sides meet once, and places of both sides come from one pass."""

import random
from collections import Counter

from voicelake.operators import joins
from voicelake.session import work_scope


def places(rows):
    """The rank of each key by (first position, key)."""
    first = {}
    for key, at in rows:
        first[key] = min(first.get(key, at), at)
    return {key: i for i, (at, key) in enumerate(sorted((at, key) for key, at in first.items()))}


def test_issues_of_each_part(spark):
    rng = random.Random(3)
    digest = lambda n: f"{n:064x}"
    left = [(f"k{i:02}", f"k{i:02}", rng.choice("xy"), 1, digest(i)) for i in range(60)]
    right = [(k, at if rng.random() < 0.8 else f"k{rng.randrange(60):02}z", s, n if rng.random() < 0.9 else None, d if rng.random() < 0.9 else d.upper() + "G") for k, at, s, n, d in left if rng.random() < 0.9]
    right += [("new", "new", "y", 1, digest(1)), (None, "x", "x", 1, digest(1))]
    shape = "k string, at string, split string, n int, d string"
    want = Counter()
    for s in "xy":
        l, r = ({row[0]: row for row in rows if row[2] == s} for rows in (left, right))  # noqa: E741
        both = [k for k in l if k in r]
        want[s] += len(l) + len(r) - 2 * len(both) + sum(l[k][3] != r[k][3] for k in both) + sum(l[k][4] != r[k][4] for k in both)
        a, b = (places([(k, side[k][1]) for k in both]) for side in (l, r))
        want[s] += sum(a[k] != b[k] for k in both)
    frames = [spark.createDataFrame(rows, shape).repartition(5) for rows in (left, right)]
    with work_scope(spark) as scope:
        got = {r.split: r.issues for r in joins.cache_issues(*frames, "k", ["n", "d"], "at", "split").collect()}
        assert got == want and len(scope.paths) == 2
    changed = joins.order_changes(*frames, "k", "at", ["split"]).count()
    assert changed == sum(v for v in want.values()) - joins.difference(*frames, "k", ["n", "d"]).count()
