"""Operators 6 and 8 against brute force and held-out labels, and their edge cases."""

import random
import re
import unicodedata
import zlib

import pytest

from florilege.llm import crossparse, licenses

SCHEMA = "doc_id long, text string, lang string, labels string, score int"


def plain_phrases(sample, text):
    """A letter that the sample does not have starts a phrase, and what follows may be its rest. No lanes."""
    n = i = 0
    while i < len(text):
        i += text[i] not in sample
        k = 0
        while i + k < len(text) and text[i : i + k + 1] in sample:
            k += 1
        i += k
        n += 1
    # an empty phrase stands before a stranger at the start
    return n + (text[:1] not in sample)


@pytest.mark.parametrize("lane", [crossparse.LANE, 1, 7, 64])
def test_phrases_are_greedy_longest_matches(monkeypatch, lane):
    monkeypatch.setattr(crossparse, "LANE", lane)
    rng = random.Random(4)
    draw = lambda n: crossparse.spoken("".join(rng.choices("abcé ", (4, 3, 2, 1, 2), k=n)))
    samples = {"x": draw(3000), "y": draw(500)}
    texts = ["", "a", draw(40), draw(2000), draw(512), draw(513), samples["x"], samples["x"][700:2900] + draw(300) + samples["y"]]
    counts, letters = crossparse.CrossParser(samples).phrases([crossparse.spoken(t) for t in texts])
    for i, t in enumerate(texts):
        t = crossparse.spoken(t)
        assert letters[i] == len(t)
        assert counts[i].tolist() == [plain_phrases(samples[k], t) if t else 0 for k in ("x", "y")]


@pytest.mark.parametrize("lane", [crossparse.LANE, 5])
def test_letters_of_many_scripts(monkeypatch, lane):
    monkeypatch.setattr(crossparse, "LANE", lane)
    rng = random.Random(9)
    scripts = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
    words = {k: ["".join(rng.choices(v, k=4)) for _ in range(200)] for k, v in scripts.items()}
    for k, first in (("han1", 0x4E00), ("han2", 0x6E00)):
        words[k] = ["".join(rng.choices([chr(first + i) for i in range(1500)], k=4)) for _ in range(800)]
    draw = lambda k, n: crossparse.spoken(" ".join(rng.choices(words[k], k=n)))
    samples = {k: draw(k, 300 if k == "greek" else 1500) for k in words}
    texts = [draw(k, 30) for k in words for _ in range(4)] + [draw("han1", 300), draw("han1", 9) + draw("greek", 9)[1:], draw("cyrillic", 600) + draw("han2", 400)[1:] + draw("latin", 300)[1:], crossparse.spoken("ภาษา ไทย")]
    parser = crossparse.CrossParser(samples)
    counts, _ = parser.phrases(texts)
    for i, t in enumerate(texts):
        assert counts[i].tolist() == [plain_phrases(samples[k], t) for k in parser.langs]
    assert parser.predict(texts[:20])[0] == [k for k in words for _ in range(4)]


def test_identify(spark):
    rng = random.Random(1)
    stems = {"aa": "the and ing tion er", "bb": "der und ung lich sch"}
    rows = []
    for i in range(200):
        lang = rng.choice(["aa", "bb"])
        rows.append((i, " ".join("".join(rng.choices(stems[lang].split(), k=rng.randrange(1, 4))) for _ in range(30)), lang, "q", 1))
    odd = [(1000, None, "aa", "q", 1), (1001, "", None, "q", 1), (1002, "123 !!", "bb", "q", 1), (None, "the and", None, "q", 1), (1003, "the " * 200000, None, "q", 1), (1003, "und", "bb", "q", 1)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    got = crossparse.identify(df).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: lang for i, _, lang, _, _ in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert [(r.lang_pred, r.score) for r in got if r.doc_id in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got)
    # labels of held-out rows and of the row itself do not matter
    blind = df.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(doc_id AS string)) % 3 <> 1 THEN lang END AS lang", "labels", "score")
    assert sorted(map(str, crossparse.identify(blind).collect())) == sorted(map(str, got))
    assert crossparse.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.lang_pred for r in crossparse.identify(df.selectExpr("doc_id", "text", "cast(null AS string) AS lang")).collect()} == {"und"}


def test_held_out_accuracy_on_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    df = spark.read.parquet(path)
    got = crossparse.identify(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


@pytest.mark.parametrize(
    "text, labels",
    [
        ("x. Released under the MIT License. y", "mit,mit-notice"),
        (MIT, "mit-text"),
        (MIT.replace("free of charge", "free of all charge"), ""),
        (MIT.replace("permission\nnotice", "permission notice (including the next paragraph)"), "mit-text"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-notice"),
        ("Licensed under the Apache License, Version 2.0.", "apache-2,apache-2-notice"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc,cc-by-nc-notice"),
        ("license commit apache versions", ""),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3-header"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl-2-header"),
        ("To the extent possible under law, A. Writer has waived all copyright and related or neighboring rights to This Work.", "cc0-notice"),
    ],
)
def test_templates(text, labels):
    assert licenses.scan_text(text)[5] == labels


def test_license_scan(spark):
    rng = random.Random(8)
    words = "under the mit license apache version 2 cc by nc é ß x1".split()
    texts = [None, "", "...", MIT] + ["".join(rng.choice(words) + rng.choice([" ", "-", ". ", "\n"]) for _ in range(rng.randrange(1, 400))) for _ in range(60)] + ["cc by nc " * 40000]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, t, "l", "x", 1) for i, t in enumerate(texts)], SCHEMA)).collect()}
    for i, t in enumerate(texts):
        low = "".join(c.lower() if c < "\x80" else c for c in t or "")
        tokens = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = sorted(k for p, _ in licenses.PHRASES for k in range(len(tokens)) if tokens[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(tokens), len(at), at[0] if at else None, at[-1] if at else None)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def as_pattern(template):
    """The template as a regular expression over words that end in a blank each."""
    out = ""
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
        out += {"[[": "(?:", "]]": ")?"}.get(token) or (rf"(?:\S+ ){{0,{token[2:-2]}}}" if token[0] == "{" else re.escape(token) + " ")
    return re.compile("(?<= )" + out)


def test_automata_against_regular_expressions():
    """Every template, whole, with regions left out or filled, and with a word of its own changed, dropped or doubled."""
    rng = random.Random(12)
    extra = (("t1", "a [[b [[c]] d]] {{2}} e"), ("t2", "a a b"), ("t3", "{{3}} x y [[z]]"), ("t4", "a [[b]] [[b]] b c"))
    templates = (*licenses.TEMPLATES, *extra)
    patterns = [(label, as_pattern(t)) for label, t in templates]
    cases = []
    for _, t in templates:
        for _ in range(12):
            filled = re.sub(r"\{\{(\d+)\}\}", lambda m: " ".join(rng.choices("abcxyz", k=rng.randrange(0, int(m[1]) + 2))), t)
            while "[[" in filled:
                filled = re.sub(r"\[\[([^\[\]]*)\]\]", lambda m: rng.choice([m[1], ""]), filled)
            words = filled.split()
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[words[k]], [words[k]], [], ["other"], [words[k]] * 2])
            cases.append(" ".join(["before", *words, "after"]))
    cases += [" ".join(rng.choices("abcdexyz", k=rng.randrange(0, 14))) for _ in range(3000)]
    found = 0
    for text in cases:
        want = {label for label, p in patterns if p.search(f" {text} ")}
        base = {label for p, label in licenses.PHRASES if f" {p} " in f" {text} "}
        assert set(filter(None, licenses.scan_text(text, templates)[5].split(","))) == want | base, text
        found += bool(want)
    assert found > 500


def test_licenses_of_null_and_repeated_doc_ids(spark):
    rows = [(None, "under the MIT license"), (7, "x"), (7, "cc by nc"), (None, None)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=[("own", "x [[y]]")]).collect()
    assert sorted((str(r.doc_id), r.n_words, r.labels) for r in got) == [("7", 1, "own"), ("7", 3, "cc-by-nc"), ("None", 0, ""), ("None", 4, "mit")]


FULL = {label: t for label, t in licenses.TEMPLATES if label.endswith("-text")}


def test_a_license_cut_short_is_not_the_license():
    """Every `-text` template is the whole mandatory wording: without its last words it is refused."""
    ends = {"mit-text": "software", "bsd-2-text": "damage", "bsd-3-text": "damage", "isc-text": "software", "boost-1-text": "software", "unlicense-text": "software", "zlib-text": "distribution", "wtfpl-text": "to"}
    assert set(FULL) == set(ends)
    for label, template in FULL.items():
        words = re.sub(r"\{\{\d+\}\}", "", template).replace("[[", "").replace("]]", "").split()
        assert words[-1] == ends[label] and label in licenses.scan_text(" ".join(words))[5].split(",")
        for cut in (len(words) - 1, len(words) // 2, 20):
            assert label not in licenses.scan_text(" ".join(words[:cut]) + " flour and eggs")[5].split(",")


@pytest.mark.parametrize("text", ["½ ② ²", "Ⅷ 12 _ ٣", "★ 🙂 ́", "1st"])
def test_letters_are_of_category_l(text):
    letters = "".join(c for c in text if unicodedata.category(c)[0] == "L")
    assert crossparse.spoken(text).replace(" ", "") == letters
