"""The coverage audit and the coverage plan against plain Python over the whole smallest tables."""

import re
from collections import Counter, defaultdict

import pytest

from test_graph_select import picked_by_walking
from voicelake.plans import standins
from voicelake.plans.catalog import QUERIES
from voicelake.plans.graph_queries import closure_inputs

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    rows, edges, anchors = closure_inputs(spark, FOLDER)
    return [r.asDict() for r in rows.collect()], [(r.a, r.b) for r in edges.select("a", "b").collect()], {r.node for r in anchors.collect()}


def parsed(name, extension=True):
    found = re.fullmatch(r"(\d+)-(\d+)-([mf])" + (r"\.(m4a|wav|mp3|flac|ogg)" if extension else r"(\.(m4a|wav|mp3|flac|ogg))?"), (name or "").rsplit("/", 1)[-1].lower())
    return found and (str(int(found[1])), str(int(found[2])), found[3])


def nodes(row):
    """Kind and node of every identity key of a window."""
    for name in (row["source_file"],) if row["label"] == 0 else (row["source_reference"], row["target_reference"]):
        if p := parsed(name):
            record, speaker, gender = p
            yield from ((kind, f"{kind}:{row['language']}:{value}") for kind, value in (("s", speaker), ("r", f"{record}-{speaker}-{gender}"), ("j", record)))


def poisoned(edges, anchors):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    bad = {root(a) for a in anchors}
    return {x for x in list(parent) if root(x) in bad}


def test_coverage_audit(spark, inputs):
    rows, edges, anchors = inputs
    added = [r for r in rows if r["label"] == 0 and r["split"] != "test" and r["duration"] >= 4]
    benchmark = [r for r in rows if r["split"] == "test"]
    others = {"in_benchmark_exposure": benchmark, "in_v1_prior_exposure": [r for r in rows if r["preprocessing_version"] == "prep-1" and r["duration"] > 4.8],
              "shared_with_retained_split": [r for r in rows if r["label"] == 1 and r["split"] != "test"]}
    want = Counter()
    own = {key for r in added for key in nodes(r)}
    for label, side in others.items():
        seen = {node for r in side for _, node in nodes(r)}
        want.update(f"addition_{ {'s': 'speaker', 'r': 'reference', 'j': 'record'}[kind] }_{label}" for kind, node in own if node in seen)
    splits = defaultdict(set)
    for r in added:
        for kind, node in nodes(r):
            if kind == "s":
                splits[node].add(r["split"])
    want["addition_speaker_shared_across_splits"] = sum(len(s) > 1 for s in splits.values())
    hashes = {r["prepared_sha256"] for r in benchmark}
    bad = poisoned(edges, anchors)
    for r in added:
        p = parsed(r["source_file"])
        want["addition_prepared_hash_in_benchmark"] += r["prepared_sha256"] in hashes
        want["addition_revision_mismatch"] += r["revision"] != "rev-g"
        want["addition_label_or_dataset_invalid"] += r["dataset_id"] != "kathbath"
        want["addition_gender_or_identity_not_documented_male"] += not (r["gender"] == "m" and p and p[2] == "m" and p[1] == r["speaker"])
        want["addition_preprocessing_version"] += r["preprocessing_version"] != "prep-2"
    want["addition_closure_component_intersects_exposure"] = len({r["window_id"] for r in added if any(node in bad for _, node in nodes(r))})
    want["duplicate_window_id"] = sum(n > 1 for n in Counter(r["window_id"] for r in added).values())
    got = {r.check: r.n for r in QUERIES["audit_coverage"](spark, FOLDER).collect()}
    assert got == +want and len(got) >= 8


def unusable(row):
    p = parsed(row["fname"], extension=False)
    if not p:
        return "fname_unparseable"
    if p != (row["record_id"], row["speaker"], row["gender"]):
        return "identity_conflict_with_fname"
    if (row["upstream_speaker"] or "").strip() not in ("", "None") and row["upstream_speaker"] != row["speaker"]:
        return "upstream_speaker_conflict"
    return "recording_too_short" if row["duration"] < 3 else None


def test_coverage_plan(spark, inputs):
    anchors = inputs[2]
    rows = [r.asDict() for r in standins.inventory(spark, FOLDER).where("gender = 'm'").collect()]
    sizes, outcome, usable = Counter(), {}, []
    for r in rows:
        sizes[r["language"], r["shard"], r["row_group"]] += r["bytes"]
        keys = {f"s:{r['language']}:{r['speaker']}", f"j:{r['language']}:{r['record_id']}", f"r:{r['language']}:{r['record_id']}-{r['speaker']}-m"}
        outcome[r["row_key"]] = unusable(r) or ("excluded_prior_exposure" if keys & anchors else None)
        if outcome[r["row_key"]] is None:
            usable.append(r)
    material = Counter((r["language"], r["speaker"]) for r in usable)
    order, split = {}, {}
    for language in {x for x, _ in material}:
        speakers = sorted((s for x, s in material if x == language), key=lambda s: (-material[language, s], int(s)))
        dev = 1 if len(speakers) <= 3 else 2
        split.update({(language, s): "dev" if i < dev else "train" for i, s in enumerate(speakers[: dev + 4])})
        order[language] = speakers[dev : dev + 4] + speakers[:dev]
    chosen = [(r["language"], r["speaker"], r["row_key"], r["shard"], r["row_group"], float(r["duration"])) for r in usable if (r["language"], r["speaker"]) in split]
    for language, speaker, _, key in picked_by_walking(chosen, sizes, order, 2):
        outcome[key] = f"planned_{split[language, speaker]}"
    want = Counter((r["language"], outcome[r["row_key"]] or "not_needed") for r in rows)
    got = {(r.language, r.disposition): r.n for r in QUERIES["coverage_plan"](spark, FOLDER).collect()}
    assert got == want and {"planned_dev", "planned_train", "excluded_prior_exposure"} <= {d for _, d in got}


def test_coverage_plan_judges_its_rows_once(spark):
    """What is counted at the end is the table of judged rows, not the inventory judged anew."""
    assert not [f for f in QUERIES["coverage_plan"](spark, FOLDER).inputFiles() if "lineitem" in f]


def test_a_split_of_a_cache_with_moved_rows_is_not_ready(spark):
    ready = {r.part: r.ready for r in QUERIES["audit_cache"](spark, FOLDER).collect()}
    assert ready == {"train": False, "val": True, "test": False, "features": False}
