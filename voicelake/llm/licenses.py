"""License notices by conditional compression.

Templates are short notices, the headers of source files, and whole license texts. A candidate block of words is
compressed with zstandard, once alone and once with each template as a raw dictionary. The templates are ranked by the
bytes they save; going down the ranking, the first one whose wording is confirmed wins: the block is aligned with it, and
which of its words are missing, which words stand between them, and whether a word that tells licenses apart (a name, a
version) is among them decide.

A place is no candidate only if no template can be confirmed there. A short notice needs all its telling words, so its
first one is looked up. A long one may differ in a quarter of its words, each of which breaks two word pairs at most, so
about half of its pairs stand within five quarters of its length, and three quarters of its words, counted with repeats.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache, cached_property, lru_cache
from itertools import combinations
from pathlib import Path

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicelake.llm.common import whole

# Short notices of common licenses.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This work is subject to the terms of the Mozilla Public License, version 2.0.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "All-Rights-Reserved": "All rights reserved.",
}
#: Words of short templates that do not tell licenses apart.
COMMON = frozenset(
    "licensed license licence under the this work is released version into to of terms subject public general a an are code file software project program"
    " available distributed international unported v".split()
)
#: Words of long templates that do; so does a number behind one of `VERSION`.
NAMES = frozenset("gnu lesser library affero apache mit mozilla bsd cc0 creative commons noncommercial sharealike noderivatives".split())
VERSION = ("version", "v")
#: Templates with more words are long.
SHORT = 16
#: A notice right behind one of these words, in the same sentence and at most `BEFORE` words away, is denied.
DENIALS = frozenset("not no never nor neither cannot without isn aren wasn weren".split())
BEFORE = 3
#: Blocks whose ranking a task remembers.
REMEMBERED = 4_096
# Licenses by the codes that stand for them.
CODES: dict[str, str] = {
    "MIT": "MIT", "ISC": "ISC", "Apache-2.0": "Apache-2.0", "Apache 2.0": "Apache-2.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "MPL-2.0": "MPL-2.0", "MPL 2.0": "MPL-2.0",
    "GPL-2.0": "GPL-2.0", "GPL-3.0": "GPL-3.0", "GPLv2": "GPL-2.0", "GPLv3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3.0", "LGPLv2.1": "LGPL-2.1", "LGPLv3": "LGPL-3.0",
    "AGPL-3.0": "AGPL-3.0", "AGPLv3": "AGPL-3.0", "CC0-1.0": "CC0-1.0", "Unlicense": "Unlicense", "0BSD": "0BSD",
}
#: Wordings of a code that hold only word for word.
STRICT = ("Licensed under {}.", "Released under {}.", "License: {}", "is {} licensed")
#: Level of all compression.
LEVEL = 3
SENTENCE = re.compile(r"[.!?;:]|\n\s*\n")
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
ID = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
SPDX = re.compile(rf"SPDX-License-Identifier:[ \t]*(\(*{ID}\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*{ID}\)*)*)", re.IGNORECASE)


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def _gnu(name: str, version: str, what: str = "program") -> str:
    return (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version."
    )


@cache
def known() -> tuple[tuple[str, str], ...]:
    """(license, wording) of all templates: `TEMPLATES`, other short notices, file headers, and the texts in license_texts."""
    found = list(TEMPLATES.items())
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        found.append((path.name[:-4], path.read_text(encoding="utf-8")))
    found += [
        ("MIT", "The MIT License (MIT)."), ("MIT", "Licensed under the MIT License."), ("Apache-2.0", "Licensed under the terms of the Apache License, Version 2.0."),
        ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("Apache-2.0", "Licensed under the Apache 2.0 License."), ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
        ("ISC", "Released under the ISC License."), ("CC0-1.0", "Licensed under CC0 1.0."), ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
        ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
            License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
            "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ]
    for kind, name, short, versions in (
        ("GPL", "GNU General Public License", "GPL", ("2", "3")), ("LGPL", "GNU Lesser General Public License", "LGPL", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", "AGPL", ("3",)),
    ):
        for version in versions:
            license = f"{kind}-{version if '.' in version else version + '.0'}"
            tail = f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
            found += [(license, _gnu(name, version)), (license, f"{_gnu(name, version)} {tail}"), (license, f"{name}, version {version}."), (license, f"Licensed under the {name} v{version}."),
                      (license, f"Licensed under the {short}v{version} license."), (license, f"Licensed under the GNU {short} version {version}."), (license, f"Licensed under the {short} version {version}.")]
    parts = {"NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
    for chosen in [c for n in range(3) for c in combinations(parts, n) if c != ("ND", "SA")]:
        for version in ("4.0", "3.0", "2.5", "2.0"):
            license = "-".join(["CC", "BY", *chosen, version])
            codes, full = "-".join(["BY", *chosen]), ["Attribution", *[parts[c] for c in chosen]]
            found += [(license, f"Licensed under CC {codes} {version}."), (license, f"Licensed under CC-{codes}-{version}.")]
            for name in ("-".join(full), " ".join(full)):
                found += [(license, f"This work is licensed under a Creative Commons {name} {version} International License."), (license, f"Creative Commons {name} {version} License.")]
    for code, license in CODES.items():
        found += [(license, form.format(code)) for form in (*STRICT, "under the {} license")]
    return tuple(dict.fromkeys(found))


class Template:
    """Words of a template, and what a block must have to pass."""

    def __init__(self, license: str, text: str) -> None:
        self.license, self.words = license, [_same(w) for w in words(text)]
        self.size = len(self.words)
        self.long = self.size > SHORT
        self.strict = not self.long and text in {form.format(code) for code in CODES for form in STRICT}
        self.tagged = self.strict and self.words[0] == "license"
        self.telling = {w for w in self.words if w not in COMMON} or set(self.words)
        self.seed = next(i for i, w in enumerate(self.words) if w in self.telling)
        self.margin = self.size // 4 if self.long else 0 if self.strict else max(2, self.size // 2)
        self.needed_words = self.telling | ({"license"} & set(self.words)) | (set(self.words) if self.strict else set())
        self.counts = Counter(self.words)
        self.pairs = set(zip(self.words, self.words[1:]))
        self.needed = self.size - 1 - 2 * self.margin
        known = zstandard.ZstdCompressionDict(" ".join(self.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        self.given = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=known)

    def passes(self, missing: list[str], added: list[str], numbers: set[str]) -> bool:
        if len(missing) + len(added) > self.margin:
            return False
        if self.long:
            return not any(w in NAMES or w in numbers for w in missing + added)
        return "license" not in missing and all(w in COMMON for w in missing + added)

    def can_pass(self, block: Counter) -> bool:
        return (self.counts - block).total() <= self.margin


def _same(word: str) -> str:
    return "license" if word == "licence" else word


def difference(template: list[str], block: list[str]) -> tuple[int, int, list[str], list[str]]:
    """(first word, words, missing, added) of the best alignment of a template in a block."""
    pieces = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    while len(pieces) > 1 and pieces[1].b - pieces[0].b - pieces[0].size > pieces[0].size:
        pieces.pop(0)  # stray words before the notice
    while len(pieces) > 1 and pieces[-1].b - pieces[-2].b - pieces[-2].size > pieces[-1].size:
        pieces.pop()
    if not pieces:
        return 0, 0, template, []
    begin, end = pieces[0].b, pieces[-1].b + pieces[-1].size
    used = {i for m in pieces for i in range(m.b, m.b + m.size)}
    seen = {i for m in pieces for i in range(m.a, m.a + m.size)}
    missing = [w for i, w in enumerate(template) if i not in seen]
    return begin, end - begin, missing, [block[i] for i in range(begin, end) if i not in used]


class Spans:
    """Disjoint spans that are taken."""

    def __init__(self) -> None:
        self.begins: list[int] = []
        self.ends: dict[int, int] = {}

    def take(self, a: int, b: int) -> bool:
        """Take a span if it meets none that is taken."""
        i = bisect_left(self.begins, a)
        if (i < len(self.begins) and self.begins[i] < b) or self.behind(a) > a:
            return False
        insort(self.begins, a)
        self.ends[a] = b
        return True

    def behind(self, a: int) -> int:
        """End of the last span that begins at `a` or before it, else 0."""
        i = bisect_left(self.begins, a + 1)
        return self.ends[self.begins[i - 1]] if i else 0


class Words:
    """Words of a text; their places are found only when they are asked for."""

    def __init__(self, text: str) -> None:
        self.text, self.every = text, [_same(w) for w in words(text)]

    @cached_property
    def spans(self) -> list[tuple[int, int]]:
        return [(m.start(), m.end()) for m in WORD.finditer(self.text)]

    @cached_property
    def gaps(self) -> list[str]:
        return [self.text[b:a] for (_, b), (a, _) in zip(self.spans, self.spans[1:])]

    @cached_property
    def tagged(self) -> set[int]:
        """Places of "license" with a colon or an equals sign behind it."""
        return {j for j, gap in enumerate(self.gaps) if self.every[j] == "license" and (":" in gap or "=" in gap)}

    @cached_property
    def denied(self) -> set[int]:
        """Places right behind a denial in the same sentence."""
        here = [j for j, w in enumerate(self.every) if w in DENIALS]
        return {k for j in here for k in range(j + 1, j + 2 + BEFORE) if not any(SENTENCE.search(g) for g in self.gaps[j:k])}


Notice = tuple[int, int, str, int, list[str], list[str]]


class Scan:
    """Templates and their compressors; one per task."""

    def __init__(self, templates: tuple[tuple[str, str], ...]) -> None:
        self.templates = [Template(*t) for t in templates]
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.seeds: dict[str, list[int]] = {}
        self.long = sorted((i for i, t in enumerate(self.templates) if t.long), key=lambda i: -self.templates[i].size)
        for i, t in enumerate(self.templates):
            if not t.long:
                self.seeds.setdefault(t.words[t.seed], []).append(i)
        self.ranked = lru_cache(REMEMBERED)(self.ranking)

    def ranking(self, block: str) -> list[tuple[int, int]]:
        """(bytes saved, template) of every template that saves bytes of a block as its dictionary, most first."""
        data = block.encode()
        alone = len(self.alone.compress(data))
        saved = [(alone - len(t.given.compress(data)), i) for i, t in enumerate(self.templates)]
        return sorted((s for s in saved if s[0] > 0), key=lambda s: (-s[0], s[1]))

    def confirmed(self, t: Template, every: list[str], first: int, last: int) -> tuple[int, int, list[str], list[str]] | None:
        """(first word, word behind, missing, added) if these words hold the template."""
        block = every[first:last]
        begin, size, missing, added = difference(t.words, block)
        numbers = {b for a, b in [*zip(t.words, t.words[1:]), *zip(block, block[1:])] if a in VERSION and b[0].isdigit()}
        if not size or not t.passes(missing, added, numbers):
            return None
        return begin + first, begin + first + size, missing, added

    def winner(self, every: list[str], first: int, last: int, able: dict[int, tuple[int, int]]) -> Notice | None:
        """The notice of a block: the license of the first template of the ranking that is confirmed, in its nearest wording.

        `able` has the words to look at for each template that can be confirmed in the block.
        """
        best = None
        for saved, i in self.ranked(" ".join(every[first:last])):
            t = self.templates[i]
            if i not in able or (best and best[2] != t.license):
                continue
            if one := self.confirmed(t, every, *able[i]):
                begin, end, missing, added = one
                if best is None or len(missing) + len(added) < len(best[4]) + len(best[5]):
                    best = begin, end, t.license, saved, missing, added
        return best

    def long_notices(self, every: list[str], taken: Spans) -> list[Notice]:
        """Notices of the long templates, longest first; words of a notice are not looked at again."""
        found, held = [], set(every)
        near = [i for i in self.long if len(every) >= (t := self.templates[i]).size - t.margin and len(t.counts.keys() & held) >= len(t.counts) - t.margin]
        for i in near:
            t = self.templates[i]
            hits = [j for j, pair in enumerate(zip(every, every[1:])) if pair in t.pairs and taken.behind(j) <= j]
            reach, after = t.size + t.margin, 0
            for a, b in zip(hits, hits[t.needed - 1 :]):
                if a < after or b - a >= reach:
                    continue
                first, last = max(a - t.margin, after, taken.behind(a), 0), a + t.margin + reach
                counts = Counter(every[first:last])
                one = None
                if t.can_pass(counts):
                    able = {k: (first, last) for k in near if self.templates[k].can_pass(counts)}
                    one = self.winner(every, first, min(last, len(every)), able)
                after = a + max(1, t.margin)
                if one and taken.take(one[0], one[1]):
                    found.append(one)
                    after = max(after, one[1])
        return found

    def short_notices(self, here: Words, taken: Spans) -> list[Notice]:
        """Notices of the short templates; where they overlap, the one that saves most stays."""
        found, behind, every = [], 0, here.every
        for j, word in enumerate(every):
            if word not in self.seeds or j < behind or taken.behind(j) > j:
                continue
            able = {}
            for i in self.seeds[word]:
                t = self.templates[i]
                first, last = max(j - t.seed - t.margin, behind, 0), j - t.seed + t.size + t.margin
                block = every[first:last]
                if t.needed_words.issubset(block) and t.can_pass(Counter(block)) and (not t.tagged or j - t.seed in here.tagged):
                    able[i] = first, last
            if able:
                one = self.winner(every, min(a for a, _ in able.values()), min(max(b for _, b in able.values()), len(every)), able)
                if one:
                    found.append(one)
                    behind = one[1] if not one[4] and not one[5] else behind
        found.sort(key=lambda x: (-x[3], len(x[4]) + len(x[5]), x[0], x[2]))
        return [x for x in found if taken.take(x[0], x[1]) and x[0] not in here.denied]

    def notices(self, text: str) -> list[Notice]:
        """(start, end, license, bytes saved, missing words, added words) of each notice; places are characters."""
        tags = [(m.start(), m.end(1), " ".join(m[1].split())) for m in SPDX.finditer(text)]
        here = Words(text)
        places = Spans()
        found = []
        for a, b, name in tags:
            if places.take(a, b):
                data = text[a:b].encode()
                known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                with_itself = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=known)
                found.append((a, b, name, len(self.alone.compress(data)) - len(with_itself.compress(data)), [], []))
        taken = Spans()
        for begin, end, *rest in [*self.long_notices(here.every, taken), *self.short_notices(here, taken)]:
            a, b = here.spans[begin][0], here.spans[end - 1][1]
            if places.take(a, b):
                found.append((a, b, *rest))
        return sorted(found)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, license, saved, missing, added, exact), one row per notice in a whole text.

    `exact` is no difference of wording at all (case and punctuation aside). Documents without a notice have no row, so
    null and empty texts have none; repeated rows repeat their rows; a null id stays null. An SPDX line gives its whole
    expression as the license. Notices of a document do not overlap. A long notice goes before short ones, and of two
    short ones the one that saves more bytes stays, then the one with fewer differences, then the earlier one; templates
    that save the same at one place keep their order, and of the wordings of a license the nearest one is told. A notice that the
    words before it deny ("not licensed under ...") is none. The time grows with the length of a text, however often it
    repeats a notice: words of a notice are not looked at again. Other columns are not read.
    """
    chosen = tuple(templates.items()) if templates else known()
    kind = docs.schema[id].dataType.simpleString()
    texts = docs.select(F.col(id).alias("doc_id"), whole(F.col(text)).alias("__t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Scan(chosen)
        for batch in batches:
            rows = [(i, a, b - a, name, saved, missing, added, not missing and not added) for i, t in zip(batch["doc_id"], batch["__t"]) for a, b, name, saved, missing, added in search.notices(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "license", "saved", "missing", "added", "exact"])

    return texts.mapInPandas(run, f"doc_id {kind}, start long, length long, license string, saved long, missing array<string>, added array<string>, exact boolean")
