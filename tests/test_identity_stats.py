"""Identity statistics hold what the report holds: keys, what splits share, and the mix of their windows."""

from voicelake.operators import stats


def test_identity_stats_hold_keys_overlap_and_mix(spark):
    keys = [("train", "a", "s", "s1"), ("val", "a", "s", "s1"), ("val", "a", "s", "s1"), ("test", "a", "s", "s1"), ("train", "a", "j", "j1"), ("val", "a", "j", "j1"), ("val", "b", "r", "r1")]
    windows = [("train", "a", "genuine", None), ("train", "a", "spoof", "vits"), ("train", "a", "spoof", "vits"), ("val", "b", "spoof", "xtts_v2")]
    found = stats.identity_stats(spark.createDataFrame(keys, "split string, language string, kind string, node string"),
                                 spark.createDataFrame(windows, "split string, language string, label_name string, generator string"))
    want = [("unique", s, "a", "s", 1) for s in ("train", "val", "test")] + [("unique", "train", "a", "j", 1), ("unique", "val", "a", "j", 1), ("unique", "val", "b", "r", 1)]
    want += [("sides", "3", "a", "s", 1), ("sides", "2", "a", "j", 1), ("sides", "1", "b", "r", 1)] + [("overlap", x, "a", "s1", 1) for x in ("test_train", "test_val", "train_val")]
    want += [("label", "train", "a", "genuine", 1), ("label", "train", "a", "spoof", 2), ("label", "val", "b", "spoof", 1), ("generator", "train", "a", "vits", 2), ("generator", "val", "b", "xtts_v2", 1)]
    want += [("windows", "train", None, None, 3), ("windows", "val", None, None, 1)]
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, want))
