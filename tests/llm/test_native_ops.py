"""Mixing, decontamination and the license scan against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tablepact.llm import decontaminate, license_scan, mixing, native_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- mixing -----------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, limit=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        full = [s for s in open_ if w[s] * level >= limit * sizes[s]]
        if not full:
            return target | {s: w[s] * level for s in open_}
        for s in full:
            target[s] = limit * sizes[s]
            left -= target[s]
            open_.discard(s)


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i, f"w{i} " * (1 + i * 7 % 41), ["a", "b", "c", "é", None, "z"][i * i % 6], "kept") for i in range(1500)]
    rows += [(5000 + i, "same words here " * 3, "hot", "kept") for i in range(700)]
    rows += [(9000, None, "a", "kept"), (9001, " \t ", "empty", "kept"), (9002, "x " * 3000, "b", "kept"), (9003, "r r", "c", "kept"), (9003, "r r", "c", "kept")]
    # Columns of the input with the names that the operator uses itself.
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, lang string, size int, part int")


def test_mixing(spark, mixed):
    got = mixing.mix(mixed).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    assert len(got) == mixed.count()
    for r in got:
        assert r["size"] == len(SPACED.findall(r["text"] or "")) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] and 0 <= r["copies"] <= 2 and r["part"] == 2
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = plain_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-6)
    for s, t in want.items():
        longest = max(r["size"] for r in got if r["source"] == s)
        assert abs(taken[s] - t) <= longest, s
    again = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.mix(mixed.repartition(7)).collect() if r["doc_id"] != 9003}
    assert again == {(r["doc_id"], r["source"]): r["copies"] for r in got if r["doc_id"] != 9003}


def test_mixing_rates_are_tilted(spark, mixed):
    """Within a source below its limit, log rates are in proportion to sizes."""
    import math

    rates = {(r["source"], r["size"]): r["rate"] for r in mixing.mix(mixed).collect() if 0 < r["rate"] < 2}
    by = defaultdict(set)
    for (s, size), rate in rates.items():
        by[s].add(round(math.log(rate) / size, 9))
    assert by and all(len(v) == 1 for v in by.values())


def test_mixing_nothing(spark, mixed):
    assert mixing.mix(mixed.limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix(mixed.filter("doc_id >= 9000 AND doc_id <= 9001")).collect()] == [0, 0]


# -- decontamination --------------------------------------------------------------------------


def plain_contamination(docs, items, window=10):
    wanted = defaultdict(set)
    for item, text in items:
        w = WORD.findall(lowered(text))
        k = min(len(w), window)
        for i in range(len(w) - k + 1 if w else 0):
            wanted[tuple(w[i : i + k])].add(item)
    lengths = {len(k) for k in wanted}
    out = []
    for doc, text in docs:
        w = WORD.findall(lowered(text))
        hit, found = set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wanted:
                    hit.update(range(i, i + k))
                    found |= wanted[tuple(w[i : i + k])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


BENCH = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (3, "Word"), (4, "a b c"), (5, None), (6, "..."), (7, "SHORT, item!"), (20, "the " * 15), (21, "straße ÉTÉ zwölf drei vier fünf sechs sieben acht neun zehn elf")]
DOCS = [
    (1, "x one two three four five six seven eight nine ten y"), (2, "one two three four five six seven eight nine"), (3, "a short item; a b c a b c. word"), (4, None), (5, ""), (6, "!!"),
    (7, "the " * 40), (8, "Straße ÉTÉ zwölf drei vier fünf sechs sieben acht neun zehn"), (9, "straße ÉTÉ-zwölf drei vier fünf sechs sieben acht neun zehn"), (10, "clean text without any of it"), (11, "a short item"), (11, "a short item"), (11, "nothing here"),
    (12, "two three four five six seven eight nine ten eleven " + "pad " * 5000 + "one two three four five six seven eight nine ten eleven twelve"),
]


def test_decontamination(spark):
    docs = spark.createDataFrame([(*d, 0, "k") for d in DOCS], "doc_id long, text string, pos int, key string")
    items = spark.createDataFrame([(*b, 0) for b in BENCH], "item_id long, text string, len int")
    want = plain_contamination(DOCS, BENCH)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for options in ({}, {"broadcast_bytes": 400}):  # the prefixes whole, and in blocks
        got = decontaminate.contamination(docs, items, **options).select(*names).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    none = decontaminate.contamination(docs, items.limit(0)).collect()
    assert len(none) == len(DOCS) and not any(r.contaminated for r in none) and {r.n_words for r in none} == {len(WORD.findall(lowered(t))) for _, t in DOCS}


def test_prefixes_are_the_rarest_shingles(spark):
    """Of a window's shingles, the one that fewest windows have."""
    windows = spark.createDataFrame([("a b c d", 4), ("b c d e", 4), ("c d e f", 4), ("a b", 2)], "key string, len int")
    got = {r.key: (r.k, r.offset) for r in decontaminate._prefixes(windows, 3).collect()}
    assert got["a b c d"] == (3, 0) and got["c d e f"] == (3, 1) and got["a b"] == (2, 0) and got["b c d e"][0] == 3


@settings(deadline=None, max_examples=25)
@given(st.lists(st.text(alphabet=st.sampled_from("aZ09 .-_é😀\x00\x7f\x80\n"), max_size=25) | st.none(), min_size=1, max_size=6))
def test_native_words_equal_regular_expressions(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", native_words.words(F.col("t")).alias("w"), native_words.count_words(F.col("t")).alias("n")).collect()
    for r in rows:
        assert r.w == WORD.findall(lowered(texts[r.i])) and r.n == len(r.w)


# -- licenses ---------------------------------------------------------------------------------

LICENSED = [
    (1, "Released under the MIT License. mit license; MIT-license"), (2, "Licensed under the Apache License, Version 2.0"), (3, None), (4, ""), (5, "emit license mit licenses"),
    (6, "GNU General Public License v3 or GNU Lesser General Public License"), (7, "CC BY-NC 4.0 and CC-BY-SA"), (8, "SPDX-License-Identifier: BSD-3-Clause"), (9, "mit der Lizenz"), (10, "x mit license"), (10, "x mit license"),
    (11, "mit license " * 3000), (12, "All rights reserved."), (13, "MIT\nLicense and Apache\tLicense"),
]


def test_license_base_columns(spark):
    docs = spark.createDataFrame([(*d, "x", 1) for d in LICENSED], "doc_id long, text string, label string, start int")
    got = sorted(license_scan.scan(docs).collect(), key=lambda r: r.doc_id)
    for r, (doc, text) in zip(got, LICENSED, strict=True):
        w = WORD.findall(lowered(text))
        at = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (doc, len(w), len(at), min(at, default=(None,))[0], max(at, default=(None,))[0], ",".join(sorted({x for _, x in at})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in got}
    assert labels[2] == "apache" and labels[6] == "gpl,lgpl" and labels[7] == "cc-by-nc,cc-by-sa" and labels[8] == "bsd-3" and labels[9] == "" and labels[12] == "proprietary"
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_license_suppression(spark):
    """A match within one of the same or a better priority is suppressed, as a comparison of all pairs says."""
    docs = spark.createDataFrame(LICENSED[:10], "doc_id long, text string")
    by = defaultdict(list)
    for r in license_scan.detections(docs, license_scan.default_rules()).collect():
        by[r.doc_id].append(r)
    assert by
    for rows in by.values():
        for r in rows:
            over = any(
                o is not r and o.start <= r.start and o.end >= r.end and o.priority <= r.priority and ((o.start, o.end) != (r.start, r.end) or (o.priority, o.rule) < (r.priority, r.rule))
                for o in rows
            )
            assert r.suppressed == over, r


def test_rules_are_gated(spark):
    rules = license_scan.default_rules()
    assert len(rules) > 300 and Counter(r.base for r in rules)[True] == len(license_scan.BASE)
    for r in rules:
        assert r.gate in r.pattern.replace("\\b", " ").replace("[sz]", "z"), r


def said(pattern):
    """Every text that a pattern without unbounded repeats matches, look-arounds aside."""
    from re import _parser

    def parts(nodes):
        out = [""]
        for kind, arg in nodes:
            kind = str(kind)
            if kind == "LITERAL":
                here = [chr(arg)]
            elif kind == "IN":
                here = [chr(c) for k, a in arg for c in (range(a[0], a[1] + 1) if str(k) == "RANGE" else [a])]
            elif kind == "BRANCH":
                here = [x for branch in arg[1] for x in parts(branch)]
            elif kind == "SUBPATTERN":
                here = parts(arg[3])
            elif kind == "MAX_REPEAT":
                assert tuple(arg[:2]) == (0, 1)
                here = ["", *parts(arg[2])]
            else:
                assert kind in ("ASSERT_NOT", "AT"), kind
                continue
            out = [a + b for a in out for b in here]
        return out

    return parts(_parser.parse(pattern))


def test_every_alternative_has_a_gate():
    rules = license_scan.default_rules()
    notices = {r.pattern: r.gates for r in rules if (r.priority, r.confidence) == license_scan.NOTICE}
    assert len(notices) > 40
    bare = {r.pattern: r.gates for r in rules if r.priority >= 3} | notices
    for pattern, gates in bare.items():
        for text in said(pattern):
            assert not set(gates).isdisjoint(text.split()), (pattern, text)
    for r in rules:  # the other forms are put around a bare one, or have a gate of their own
        assert r.pattern in bare or r.gates == ("spdx",) and r.pattern.startswith("spdx ") or any(p in r.pattern and r.gates == g for p, g in bare.items()), r


def test_notices_and_addresses(spark):
    texts = {
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published": "gpl",
        "https://www.apache.org/licenses/LICENSE-2.0": "apache", "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa", "Unauthorised copying of this file is prohibited": "proprietary",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl", "See the LICENSE file for details.": "reference", "we see the details": "",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_names_with_other_gates(spark):
    texts = {"Licensed under the LGPLv3": "lgpl", "AGPLv3": "agpl", "a Zero-Clause BSD license": "0bsd", "Q Public License": "qpl", "GPLv1 only": "gpl", "gpl, GPLv2 and GPLv3": "gpl"}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert [got[i].labels for i in range(len(texts))] == list(texts.values())
    assert got[0].score == 0.95 and got[5].n_detections == 3


def test_mixing_says_when_it_does_not_converge(spark, mixed):
    from tablepact.llm.store import Scratch

    cells = spark.createDataFrame([("a", 3, 10), ("a", 500, 4), ("b", 2, 5)], "source string, size long, m long")
    goals = spark.createDataFrame([("a", 2030, 1000.0), ("b", 10, 20.0)], "source string, source_size long, target double")
    with pytest.raises(RuntimeError, match="converge"):
        mixing.solve(cells, goals, 2.0, Scratch(spark, "t"), steps=1)
    (r,) = mixing.solve(cells, goals, 2.0, Scratch(spark, "t")).collect()  # b is at its limit and needs no dual
    import math

    assert r.source == "a" and sum(m * s * min(2, math.exp(r.b * s / r.scale)) for s, m in ((3, 10), (500, 4))) == pytest.approx(1000, rel=1e-8)
