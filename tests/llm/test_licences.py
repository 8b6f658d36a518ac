import random
import re

import numpy as np
import pyarrow as pa

from rulemesh.llm import licences as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_base(text):
    words = WORD.findall(lowered(text))
    places, labels = [], set()
    for phrase, label in L.PHRASES:
        p = phrase.split()
        hits = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


ODD = [
    "", None, "   ", "MIT", "under the MIT license", "Under-the MIT\nLICENSE under the mit license",
    "apache license, version 2.0 cc by-nc CC_BY_NC", "x" * 100_000, "under the mit " * 3000 + "license",
    "é under the mit license ñ", "under the mit licenseé", "cc by nc " * 2000,
]


def test_automaton_finds_all_stretches_that_cannot_be_prolonged():
    rng = random.Random(1)
    for _ in range(60):
        texts = [[rng.randrange(4) for _ in range(rng.randrange(1, 14))] for _ in range(3)]
        probe = [rng.randrange(4) for _ in range(25)]
        for shortest in (1, 3):
            want = []
            for e in range(1, len(probe) + 1):
                for k, t in enumerate(texts):
                    for p in range(1, len(t) + 1):
                        length = next((l for l in range(min(e, p)) if probe[e - l - 1] != t[p - l - 1]), min(e, p))
                        if length >= shortest and (e == len(probe) or p == len(t) or probe[e] != t[p]):
                            want.append((e, length, k, p))
            assert sorted(L.Automaton(texts).matches(probe, shortest)) == sorted(want)


def test_counts_of_the_table_and_of_odd_texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {r.doc_id: plain_base(r.text) for r in rows}
    got = L.op3_suffix_automaton_licences(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == want
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    odd = spark.createDataFrame([(i, t, 0.1) for i, t in enumerate(ODD)], "doc_id long, text string, score double")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.scan(odd).collect()}
    assert got == {i: plain_base(t) for i, t in enumerate(ODD)}
    assert L.scan(odd.limit(0)).count() == 0


def labels(text):
    found = L.Scanner().scan(pa.array([text], pa.large_string()))
    return found["labels"][0], float(found["score"][0])


def template(label, n=0):
    return [text for x, _, text in L.TEMPLATES if x == label][n]


def test_labels_of_the_method():
    assert labels("Prose before. This work is licensed under the GNU General Public License, version 3. After.") == ("gpl-3", 1.0)
    mit = template("mit", 2)
    assert labels("Foo bar " + mit + " baz")[0] == "mit"
    words = mit.split()
    changed = words[:20] + ["ACME", "Inc"] + words[20:50] + ["(sic)"] + words[50:]
    assert labels(" ".join(changed))[0] == "mit"
    assert labels(" ".join(words[:20]))[0] == ""
    assert labels("the of and to in a is that for it as with")[0] == ""
    assert labels(" ".join(reversed(words)))[0] == ""


def test_deciding_words_and_rivals():
    assert labels("Licensed under the Apache License, Version 1.1") == ("", 0.0)
    assert labels("We released under the MIT label a record") == ("", 0.0)
    assert labels("This work is licensed under the GNU General Public License, version 2.")[0] == "gpl-2"
    assert labels("This work is licensed under the GNU General Public License.")[0] == "gpl"
    assert labels("This work is licensed under the GNU General Public License, version 4.")[0] == "gpl"
    assert labels("the GNU General Public License is a text")[0] == ""
    for name in ("cc-by-nc", "cc-by", "cc-by-sa", "cc-by-nd", "gpl-3", "gpl-2", "lgpl-3", "lgpl-2.1", "agpl-3", "bsd-2", "bsd-3", "mpl-2", "isc", "zlib", "bsl-1", "unlicense", "cc0"):
        n = sum(x == name for x, _, _ in L.TEMPLATES)
        for k in range(n):
            assert labels("Some prose. " + template(name, k) + " More prose.")[0] == name, (name, k)
    both = "A " + template("isc") + " and then, elsewhere, " + template("mit", 2) + " " + template("mit", 3)
    assert labels(both)[0] == "isc,mit"


def test_spans_are_where_the_templates_stand(spark):
    text = "one two three " + template("mit") + " x y " + template("unlicense")
    words = WORD.findall(lowered(text))
    row = L.scan(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(s.first, s.label, s.share) for s in row[0].spans] == [(3, "mit", 1.0), (10, "unlicense", 1.0)] and row[1].spans == []
    assert words[row[0].spans[1].first : row[0].spans[1].end] == [w.decode() for w in L.words_of(template("unlicense"))]


def brute_cover(text, number):
    """Longest stretches of the template in the text, one after another: words of it that they have."""
    words, want = L.words_of(text), L.words_of(L.TEMPLATES[number][2])
    import difflib

    return sum(m.size for m in difflib.SequenceMatcher(None, words, want, autojunk=False).get_matching_blocks() if m.size >= L.SHORTEST) / len(want)


def test_labels_of_the_table_equal_a_plain_scan(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in L.op3_suffix_automaton_licences(spark, sf_dir).collect():
        spaced = " ".join(WORD.findall(lowered(texts[r.doc_id])))
        able = {x for n, (x, key, _) in enumerate(L.TEMPLATES) if f" {key} " in f" {spaced} " and brute_cover(texts[r.doc_id], n) >= L.COVER}
        got = set(filter(None, r.labels.split(",")))
        assert got <= able | set(filter(None, r.base_labels.split(","))) and bool(able) <= bool(got)


def test_chain_covers_no_more_than_the_template():
    scanner = L.Scanner([("x", "a b", "a b c d e f g h")], [], 2, 5, 0.5)
    number = {w: i for i, w in enumerate("abcdefgh")}
    for text, covered in (("abcdefgh", 8), ("abcd-efgh", 8), ("abc---fgh", 6), ("abcabcabc", 3), ("abcd--------efgh", 4), ("abcdcdefgh", 8), ("efghabcd", 4)):
        symbols = np.array([number.get(c, -1) for c in text])
        assert scanner.spans(symbols)[0].covered == covered, text
    assert scanner.spans(np.array([number[c] for c in "cdefgh"])) == []


NEW = [
    ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa"), ("licensed under CC BY-NC-ND 4.0.", "cc-by-nc-nd"),
    ("This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa"),
    ("This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "cc-by-nc-nd"),
    ("// SPDX-License-Identifier: MIT", "mit"), ("# SPDX-License-Identifier: Apache-2.0", "apache-2"), ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3"),
    ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", "cc-by-nc-sa"), ("SPDX-License-Identifier: LGPL-2.1-only", "lgpl-2.1"),
    ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "gpl-3"), ("GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991", "gpl-2"),
    ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "lgpl-2.1"), ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "agpl-3"),
    (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License.", "gpl-2",
    ),
    ("the Mozilla Public License Version 2.0 applies", "mpl-2"), ("Licensed under the Artistic License 2.0", "artistic-2"),
    ("SPDX-License-Identifier: Something-1.0", None), ("the general public has a licence, version 3, of June", None), ("cc by the way 4 of them", None),
]


def test_restricted_creative_commons_tags_and_titles(spark):
    docs = spark.createDataFrame([(n, f"Some words before. {t} And some after it.") for n, (t, _) in enumerate(NEW)], "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) - {""} if r.labels else set() for r in L.scan(docs).collect()}
    for n, (text, label) in enumerate(NEW):
        base = {x for phrase, x in L.PHRASES if f" {phrase} " in f" {' '.join(w.decode() for w in L.words_of(text))} "}
        assert got[n] - base == ({label} - base if label else set()), text


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    rows = [(None, NEW[4][0], "x", 1), (1, NEW[4][0], "y", 2), (1, NEW[4][0], "y", 2), (2, None, None, None), (3, "", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, n_words int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.labels) for r in L.scan(docs).collect())
    assert got == [(False, 1, "mit"), (False, 1, "mit"), (False, 2, ""), (False, 3, ""), (True, 0, "mit")]
