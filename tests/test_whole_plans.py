"""The coverage plan is trimmed to its budget and signed."""

from collections import Counter

from voicelake.plans import audit_queries


def test_coverage_plan_is_trimmed_and_signed(spark, monkeypatch):
    run = lambda: {(r.language, r.disposition): (r.n, r.plan_digest) for r in audit_queries.coverage_plan(spark, "/root/testdata/sf0.001").collect()}
    whole = run()
    monkeypatch.setattr(audit_queries, "BUDGET", 0)
    trimmed = run()
    total = lambda rows, *names: Counter({x: n for (x, d), (n, _) in rows.items() if d in names})
    assert total(trimmed, "trimmed_global_budget_cap") == total(whole, "planned_train") and not total(trimmed, "planned_train") and not total(whole, "trimmed_global_budget_cap")
    assert {k: v[0] for k, v in trimmed.items() if "train" not in k[1] and "trimmed" not in k[1]} == {k: v[0] for k, v in whole.items() if "train" not in k[1]}
    digests = [{x: d for (x, _), (_, d) in rows.items()} for rows in (whole, trimmed)]
    assert all(len(d) == 64 and d != digests[1][x] for x, d in digests[0].items())
