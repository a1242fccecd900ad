"""Operators on odd and empty tables, and against plain versions."""

import math
import random
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from voicelake.llm import language, licenses, line_dedup, mixing, quality, toxicity

SF = "/root/testdata/sf0.01"


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 4 == 2


def test_quality_rows_and_ablations(odd, empty):
    rows = quality.ledger(odd, keep=("doc_id",))
    assert rows.count() == odd.count() and quality.ledger(empty, keep=("doc_id",)).count() == 0
    assert {r.fail_bits & 1 for r in rows.where("n_words = 0").collect()} == {1}
    failed = Counter()
    alone = Counter()
    for r in rows.collect():
        names = [n for i, n in enumerate(quality.RULES) if r.fail_bits >> i & 1]
        failed.update(names)
        alone.update(names if len(names) == 1 else [])
    got = {r.rule: (r.failed, r.failed_alone) for r in quality.ablations(rows).collect()}
    assert got == {n: (failed[n], alone[n]) for n in got} and set(failed) <= set(got)
    assert quality.keep_good(odd).columns == odd.columns and quality.keep_good(empty).count() == 0


def test_mixing_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and mixing.mix(empty).count() == 0
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(taken[s] == math.floor(target[s] + 1e-9) for s in target)
    again = mixing.mix(odd.repartition(3)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_lines_of_odd_rows(odd, empty):
    got = line_dedup.dedup_lines(odd, report=False)
    assert got.columns == odd.columns and got.count() == odd.count() and line_dedup.dedup_lines(empty).count() == 0
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[5] == "" and len(texts[4]) > 0 and texts[2] is None and texts[6] == "\n\n \t\n"


def test_licenses(make, odd, empty):
    text = "Some words here. Released under the MIT  License.\nMore words, licensed under the Apache License Version 2.0 they say; all rights were reserved."
    got = licenses.scan(make([(1, text, "a", "en"), (2, "This work is licensed under the GNU General Public License, version 2.", "a", "en"), (3, "a license to fish", "a", "en")])).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.license, r.exact) for r in got] == [(1, "MIT", True), (1, "Apache-2.0", True), (2, "GPL-2.0", True)]
    assert text[got[0].start : got[0].start + got[0].length] == "Released under the MIT  License"
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0


def test_licenses_against_searching_the_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = Counter((r.doc_id, r.license) for r in licenses.scan(docs).where("exact").collect())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        words = " " + " ".join(licenses.words(r.text)) + " "
        for name, template in licenses.TEMPLATES.items():
            want[(r.doc_id, name)] += words.count(" " + " ".join(licenses.words(template)) + " ")
    assert got == +want and got


def test_licenses_in_other_wordings(make):
    texts = [Path(licenses.__file__).with_name("license_texts") / f"{n}.txt" for n in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0")]
    gnu = "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    cases = [
        ("The MIT License (MIT)", "MIT"), ("Licensed under the terms of the Apache License, Version 2.0", "Apache-2.0"), ("// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\nint x;", "GPL-2.0-only WITH Classpath-exception-2.0"),
        ("Licensed under Apache-2.0", "Apache-2.0"), ("Licensed under AGPLv3", "AGPL-3.0"), ("available under the Apache-2.0 license", "Apache-2.0"), ("License: MIT", "MIT"), ("license = \"MPL-2.0\"", "MPL-2.0"), ("This software is MIT licensed", "MIT"),
        ("GNU Tool is free software; you can redistribute it and/or modify " + gnu.format(3), "GPL-3.0"), ("Foo is free software: you can redistribute it and/or modify " + gnu.format(2), "GPL-2.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"), ("Creative Commons Attribution 3.0 Unported License", "CC-BY-3.0"),
        *[("Copyright (c) 2020 Some One\n\n" + p.read_text() + "\nmore text of the page behind it", p.name[:-4]) for p in texts],
        ("Copyright 2020\n" + texts[0].read_text().replace("SOFTWARE", "PROGRAM").replace("sublicense, ", ""), "MIT"),
    ]
    got = {i: [] for i in range(len(cases))}
    for r in licenses.scan(make([(i, t, "a", "en") for i, (t, _) in enumerate(cases)])).collect():
        got[r.doc_id].append(r.license)
    assert got == {i: [name] for i, (_, name) in enumerate(cases)}
    other = ["lab under the MIT dome", "a creative work by the commons", "either version 3 of the story", "Permission is hereby granted to enter.", "They granted a license to MIT.",
             "See the license. MIT is a school", "MIT licensed the patent to a firm", "students under MIT supervision", "wir gehen mit der Lizenz"]
    assert licenses.scan(make([(i, t, "a", "en") for i, t in enumerate(other)])).count() == 0


def test_denied_licenses_are_none(make):
    texts = ["Not licensed under the MIT License.", "This is no longer licensed under the GPLv3.", "It isn't released under the MIT License.", "This is not MIT licensed.", "It is not. Licensed under the MIT License."]
    got = licenses.scan(make([(i, t, "a", "en") for i, t in enumerate(texts)])).collect()
    assert [(r.doc_id, r.license) for r in got] == [(4, "MIT")]


def test_licenses_win_by_compression():
    search = licenses.Scan(licenses.known())
    block = "files are licensed under the gnu lesser general public license v3 since then"
    ranks = search.ranking(block)
    assert len(search.templates) > 200 and [s for s, _ in ranks] == sorted((s for s, _ in ranks), reverse=True)
    alone = len(zstandard.ZstdCompressor(level=licenses.LEVEL, write_content_size=False).compress(block.encode()))
    for saved, i in ranks[:20]:
        words = zstandard.ZstdCompressionDict(" ".join(search.templates[i].words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        assert saved == alone - len(zstandard.ZstdCompressor(level=licenses.LEVEL, write_content_size=False, dict_data=words).compress(block.encode()))
    # whole texts that hold these words save as much, but their wording is not confirmed
    every = block.split()
    confirmed = [(saved, search.templates[i].license) for saved, i in ranks if search.confirmed(search.templates[i], every, 0, len(every))]
    assert ranks[0][0] >= confirmed[0][0] and {name for _, name in confirmed} == {"LGPL-3.0"}
    ((_, _, name, saved, missing, added),) = search.notices(block)
    assert (name, missing, added) == ("LGPL-3.0", [], []) and saved == confirmed[0][0]


def test_licenses_of_very_long_texts():
    search = licenses.Scan(licenses.known())
    folder = Path(licenses.__file__).with_name("license_texts")
    mit, gpl = (folder / "MIT.txt").read_text(), (folder / "GPL-3.0.txt").read_text()
    for text, want in (
        (mit * 80, Counter(MIT=80)), (gpl + mit * 3 + gpl, Counter({"GPL-3.0": 2, "MIT": 3})), ("Licensed under the Apache License, Version 2.0. " * 11_500, Counter({"Apache-2.0": 11_500})),
        ("Licensed under terms of the Apache License, Version 2.0, in part. " * 5_000, Counter({"Apache-2.0": 5_000})), ((mit.split("\n\n")[-1] + " ") * 800, Counter()),
    ):
        start = time.process_time()
        assert Counter(name for _, _, name, *_ in search.notices(text)) == want
        assert time.process_time() - start < 20  # a few seconds; minutes if it were not linear


def test_codewords_are_far_apart():
    for n in range(2, 12):
        code = language.codewords(n)
        distance = (code[:, None] != code[None]).sum(axis=2)[~np.eye(n, dtype=bool)].min()
        assert distance >= (1 if n == 2 else 2 ** (n - 2) if n <= 6 else 4)


def test_language_of_held_out_texts(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs)
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == held(r.doc_id) for r in got)
    kept = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in kept) >= 0.97 * len(kept)
    rows = language.identify(odd, model).collect()
    assert len(rows) == odd.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 6, 9))
    nothing = language.learn(empty)
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0
    one = language.learn(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in language.identify(docs, one).collect()} == {"en"}


def test_language_ignores_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit("xx")).otherwise(F.col("lang")))
    assert (language.learn(docs).weights == language.learn(changed).weights).all()


def test_clauses():
    scan = toxicity.Scanner(toxicity.Grammar({"fool": 4.0, "rott*": 2.0}))
    said = {t: scan.document(t) for t in (
        "A fool came.", "You fool.", "You are a fool.", "not a fool.", "You are not really a fool.", "You have no shame, fool.", "You are no fool.", "She said fool.", "The paper said fool.",
        "He told me that you are a fool.", "He said hello, you fool.", 'He said: "you fool" and left.', "The fool saw them there, a long way off from you.", "I will not kill you.", "I will kill you.", "kill time")}
    bare, aimed, not_aimed = 4 * toxicity.BARE, 4 * toxicity.AIMED, 4 * toxicity.AIMED * toxicity.NEGATED
    assert said["A fool came."] == bare and said["The fool saw them there, a long way off from you."] == aimed
    assert said["You fool."] == said["You are a fool."] == said["You have no shame, fool."] == said["He said hello, you fool."] == aimed
    assert said["You are not really a fool."] == said["You are no fool."] == not_aimed and said["not a fool."] == bare * toxicity.NEGATED
    assert said["The paper said fool."] == bare * toxicity.REPORTED < said["She said fool."] == said["He told me that you are a fool."] == said['He said: "you fool" and left.'] == aimed * toxicity.REPORTED
    assert said["I will kill you."] == toxicity.THREAT_WEIGHT > said["I will not kill you."] > 0 == said["kill time"]
    assert scan.document("rottener; foolish") == 2 * toxicity.BARE and scan.document("He will kill him.") > 0
    assert scan.document("A fool. A fool!") == 2 * bare and scan.document(None) == 0


def every_path(layers, symbols, strengths):
    """Weights of all paths, layer after layer, without composing anything."""
    readings = [(symbols, (1.0,) * len(symbols))]
    for layer in layers:
        written = []
        for line, factors in readings:
            walks = [(layer.start, "", ())]
            for symbol in line:
                walks = [(new, out + w, fs + (f,)) for state, out, fs in walks for w, f, new in layer.arcs.get((state, symbol), ())]
            written += [(out, tuple(a * b for a, b in zip(factors, fs))) for state, out, fs in walks if state in layer.finals]
        readings = written
    return [sum(f * s for f, s in zip(factors, strengths)) for _, factors in readings]


def test_composed_grammar_equals_a_plain_path_search():
    rng = random.Random(5)
    layers, machine = toxicity.cascade(), toxicity.machine()
    for _ in range(1500):
        symbols = "".join(rng.choices(toxicity.WORDS + toxicity.MARKS, [3, 2, 3, 1, 1, 1, 6, 1, 1], k=rng.randint(0, 9)))
        strengths = [rng.randint(1, 9) if s in "IH" else 0 for s in symbols]
        paths = every_path(layers, symbols, strengths)
        assert len(paths) == 1 and abs(machine.best(symbols, strengths) - paths[0]) < 1e-9, symbols


def test_toxicity_of_held_out_texts(spark, odd, empty):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    grammar = toxicity.learn(docs, labels)
    got = toxicity.score(docs, grammar).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.3) for r in got)
    kept = [r for r in got if r.held_out]
    right = sum(r.toxic == r.predicted for r in kept) / len(kept)
    assert right >= 0.95
    caught = sum(r.toxic and r.predicted for r in kept)
    # some labels are noise: texts without any insult that are marked toxic
    assert caught >= 0.8 * sum(r.toxic for r in kept) and caught >= 0.95 * sum(r.predicted for r in kept)
    assert all(r.total == 0 for r in kept if r.toxic and not r.predicted)
    assert sum(r.predicted for r in kept if r.toxic == 0) <= 0.01 * len(kept)
    rows = toxicity.score(odd, grammar).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, grammar).count() == 0
    assert toxicity.learn(docs, labels.limit(0)).insults == {} == toxicity.learn(empty, labels).insults


@pytest.mark.parametrize("key", ["op1_line_dedup", "op2_mixing", "op5_quality_rules"])
def test_queries_match_sql(spark, key):
    from voicelake.llm.queries import ORACLES, QUERIES

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES[key](spark, SF)
    result = con.execute(ORACLES[key])
    names = [d[0] for d in result.description]
    want = result.fetchall()
    order = [names.index(c) for c in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want)
