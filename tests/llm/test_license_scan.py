import random
import re

from tabwright.llm import license_scan as ls

from tests.llm import samples

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    base = sorted((k, label) for phrase, label in ls.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
    spread = "".join(f" {w} " for w in words)
    found = []
    if any(w.replace(" ", "  ") in spread for w in ls.GENERAL):
        for k, r in enumerate(ls.RULES):
            if r.keyword in spread:
                found += [(spread[: m.start()].count(" ") // 2, m[0].count(" ") // 2, r.priority, k, r.label) for m in re.finditer(r.pattern, spread)]
    kept = [
        d for d in found
        if not any(e != d and e[0] <= d[0] and e[0] + e[1] >= d[0] + d[1] and (e[2] > d[2] or (e[2] == d[2] and (e[1] > d[1] or e[3] < d[3]))) for e in found)
    ]
    labels = {b[1] for b in base}
    top = max([d[2] for d in kept] + [ls.NAME if base else 0])
    places = [b[0] for b in base]
    return (
        len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {d[4] for d in kept})),
        ls.SCORES.get(top, 0.0), len(kept),
    )


TEXTS = [
    "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "SPDX-License-Identifier: GPL-3.0-or-later",
    "This work is licensed under the GNU General Public License, version 3.", "licensed under the GNU Lesser General Public License v2.1 or later",
    "MIT License MIT license mit-license", "// SPDX-License-Identifier: Apache-2.0 OR MIT", "https://creativecommons.org/licenses/by-sa/4.0/", "Copyright (c) 2019 2020 by A. All rights reserved.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "BSD 3-Clause License; see the 2-clause BSD license", "ich gehe mit der Lizenz", "mit license" * 3,
    "released into the public domain (Unlicense)", "general public license general public license apache license",
]


def test_against_brute_force(spark):
    rng = random.Random(3)
    pool = " ".join(TEXTS).split() + ["the", "license", "mit", "2", "version", "under", "spdx", "identifier", "public"]
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100 + k, " ".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for k in range(200)]
    rows += [(400, " ".join(TEXTS) * 40)]
    got = {r.doc_id: tuple(r)[1:] for r in ls.scan(samples.corpus(spark, rows)).collect()}
    assert got == {k: brute(t) for k, t in rows}


def test_labels(spark):
    got = {r.doc_id: r.labels for r in ls.scan(samples.corpus(spark, list(enumerate(TEXTS)))).collect()}
    assert [got[k] for k in range(6)] == ["apache", "cc-by-nc", "mit", "gpl", "gpl", "gpl,lgpl"]
    assert got[8] == "cc-by-sa" and got[9] == "copyright,proprietary" and got[12] == "" and "unlicense" in got[14]


def test_every_rule_holds_its_keyword_and_a_word_on_either_side():
    assert len(ls.RULES) >= 200 and len({r.name for r in ls.RULES}) == len(ls.RULES)
    for r in ls.RULES:
        re.compile(r.pattern)
        assert r.pattern.startswith(" (?:") and r.pattern.endswith(") ")


def test_spans(spark):
    row = ls.detect(samples.corpus(spark, [(1, "x y Licensed under the Apache License, Version 2.0. z")])).first()
    assert [(d.label, d.rule, d.first_word, d.last_word) for d in row.found] == [("apache", "apache-notice", 2, 9)]
    assert [(b.start, b.label) for b in row.base] == [(5, "apache")]


def test_odd_rows_and_empty_tables(spark):
    rows = ls.scan(samples.odd(spark)).collect()
    assert sorted(str((r.doc_id, *tuple(r)[1:])) for r in rows) == sorted(str((r[0], *brute(r[1]))) for r in samples.odd_rows())
    assert ls.scan(samples.empty(spark)).count() == 0


def spoken(tree):
    """Texts of a parsed pattern that between them take every branch; repeats at their least and once more."""
    out = {""}
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            more = {chr(value)}
        elif name == "IN":
            more = {chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0])}
        elif name == "SUBPATTERN":
            more = spoken(value[3])
        elif name == "BRANCH":
            more = set().union(*map(spoken, value[1]))
        else:
            assert name == "MAX_REPEAT"
            inner = sorted(spoken(value[2]))
            more = {x * max(value[0], 1) for x in inner} | ({""} if not value[0] else set())
        # Every text of either side is there at least once.
        a, b = sorted(out), sorted(more)
        out = {a[k % len(a)] + b[k % len(b)] for k in range(max(len(a), len(b)))} | {x + b[0] for x in a} | {a[0] + x for x in b}
    return out


def test_no_gate_drops_a_match(spark):
    """A sample text for each alternative of each rule passes both gates, and the scan finds what a scan without gates finds."""
    texts = set()
    for r in ls.RULES:
        for t in spoken(re._parser.parse(r.pattern)):
            assert re.search(r.pattern, t) and r.keyword in t and any(w in t for w in r.keywords), (r.name, t)
            assert any(w.replace(" ", "  ") in t for w in ls.GENERAL), (r.name, t)
        # Each alternative of a name by itself.
        texts |= {t.strip() for t in sorted(spoken(re._parser.parse(r.pattern)), key=lambda t: (len(t), t))[:2]}
    plain = ["Photo: CC BY-SA 4.0", "data: CC0", "covered under the GPL", "distributed subject to the MIT", "Open Database License", "Open Data Commons Open Database License",
             "Massachusetts Institute of Technology License", "Neither the name of X nor the names of its contributors may be used to endorse or promote"]
    rows = list(enumerate(plain + sorted(texts)[::4]))
    got = {r.doc_id: {(d.rule, d.first_word, d.last_word) for d in r.found} for r in ls.detect(samples.corpus(spark, rows).repartition(8)).collect()}
    for k, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        spread = "".join(f" {w} " for w in words)
        found = [(spread[: m.start()].count(" ") // 2, m[0].count(" ") // 2, r.priority, n) for n, r in enumerate(ls.RULES) for m in re.finditer(r.pattern, spread)]
        kept = {d for d in found if not any(e != d and e[0] <= d[0] and e[0] + e[1] >= d[0] + d[1] and (e[2] > d[2] or (e[2] == d[2] and (e[1] > d[1] or e[3] < d[3]))) for e in found)}
        assert got[k] == {(ls.RULES[n].name, a, a + size - 1) for a, size, _, n in kept}, t
    assert all(got[k] for k in range(len(plain)))
