"""The licence scan against a brute-force one, whole licences told apart, and odd rows."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from prosemill.llm import licenses
from prosemill.llm import textops as T

ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TEXT = {label: text for label, text, _ in sorted(licenses.TEMPLATES, key=lambda t: len(t[1]))}


def words(text):
    return ALNUM.findall((text or "").translate(LOWER))


def brute(text, rules):
    """Every part of every template at every place of the text; then every run of parts."""
    w, found = words(text), set()
    for label, template, keys in licenses.TEMPLATES:
        total, placed = len(words(template)), []
        for number, line in enumerate(template.split("\n")):
            own = words(line)
            for b in range(-len(own) + 1, len(w)):
                low, high = max(b, 0), min(b + len(own), len(w))
                same = sum(w[i] == own[i - b] for i in range(low, high))
                if same / len(own) >= rules.min_share:
                    placed.append((low, high, number, same))
        placed.sort()

        def best_run(j):
            """The parts of the best run that ends with part j, the earliest of equal ones."""
            a, _, number, _ = placed[j]
            runs = [best_run(i) for i in range(j) if placed[i][2] < number and 0 <= a - placed[i][1] <= rules.max_gap]
            return [*max(runs, key=lambda run: sum(placed[i][3] for i in run), default=[]), j]

        runs = [best_run(j) for j in range(len(placed))]
        for run in runs:
            low, high, score = placed[run[0]][0], placed[run[-1]][1], sum(placed[i][3] for i in run) / total
            if any(run == other[:-1] for other in runs):
                continue
            if score >= rules.min_share and all(any(w[i : i + len(k.split())] == k.split() for i in range(low, high - len(k.split()) + 1)) for k in keys):
                found.add((label, low, high, score))
    return found


def scan(items, df=None):
    scanner = licenses.Scanner()
    t = T.texts(pa.array(items, pa.string()))
    if df is None:
        w, _, hit, word = scanner.read(t)
        pairs = np.unique(w.row()[hit] * len(scanner.vocabulary) + word)
        df = np.bincount(pairs % len(scanner.vocabulary), minlength=len(scanner.vocabulary))
    scanner.weigh(df, len(items))
    return scanner.scan(t)


def test_scan_equals_brute_force():
    rng = random.Random(4)
    vocabulary = [w for _, text, _ in licenses.TEMPLATES for w in words(text)] + [f"f{k}" for k in range(300)]
    items = [None, "", "x"]
    for _ in range(40):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            notice = words(rng.choice(licenses.TEMPLATES)[1])
            for _ in range(rng.choice([0, 0, 1, len(notice) // 8])):
                notice[rng.randrange(len(notice))] = "changed"
            at = rng.randrange(len(own) + 1)
            own[at:at] = notice[: rng.choice([len(notice), len(notice), int(0.8 * len(notice))])]
        items.append(" ".join(own))
    rules = licenses.ScanRules()
    for text, got in zip(items, scan(items), strict=True):
        assert set(got["matches"]) == brute(text, rules), text


@pytest.mark.parametrize("label", sorted(TEXT))
def test_each_licence_has_its_own_label(label):
    filler = " ".join(f"word{k}" for k in range(50))
    got = scan([f"{filler}\n{TEXT[label]}\n{filler}", filler, "of the and to in a software"])
    labels = {m[0] for m in got[0]["matches"]}
    assert labels == {label}
    assert not got[1]["matches"] and not got[2]["matches"]


def test_versions_are_told_apart():
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    bullets = TEXT["bsd-3-clause"].replace("Redistributions of", "* Redistributions of").replace("Redistributions in", "2) b. Redistributions in").replace("Neither", "3. Neither")
    items = [bullets, TEXT["bsd-2-clause"].replace("COPYRIGHT HOLDER", "REGENTS"), TEXT["bsd-3-clause"].replace("copyright holder", "University of California, Berkeley").replace("COPYRIGHT HOLDERS", "REGENTS"), gpl.format("General Public License", "2"), gpl.format("General Public License", "3"), gpl.format("Lesser General Public License", "2.1"), gpl.format("Lesser General Public License", "3"), gpl.format("Affero General Public License", "3"), TEXT["bsd-2-clause"].replace("COPYRIGHT HOLDER", "FREEBSD PROJECT")]
    assert [{m[0] for m in x["matches"]} for x in scan(items)] == [{"bsd-3-clause"}, {"bsd-2-clause"}, {"bsd-3-clause"}, {"gpl-2.0"}, {"gpl-3.0"}, {"lgpl-2.1"}, {"lgpl-3.0"}, {"agpl-3.0"}, {"bsd-2-clause"}]


def test_odd_rows(spark):
    rows = [(1, "MIT License"), (1, "MIT License"), (None, TEXT["isc"]), (2, None), (3, ""), (4, "x " * 400_000 + TEXT["mit"])]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], "doc_id bigint, text string, labels string, n_words string")
    got = sorted(((r.doc_id, r.n_base, r.base_labels, r.labels, r.score) for r in licenses.scan_licenses(df).collect()), key=str)
    assert got == sorted([(1, 1, "mit", "mit", 0.0), (1, 1, "mit", "mit", 0.0), (None, 0, "", "isc", 1.0), (2, 0, "", "", 0.0), (3, 0, "", "", 0.0), (4, 0, "", "mit", 1.0)], key=str)
    assert licenses.scan_licenses(df.limit(0)).count() == 0
