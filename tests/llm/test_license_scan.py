import random
import re

from tidewater.llm import license_scan
from tidewater.llm.common import ship
from tidewater.llm.license_scan import BASE, TEMPLATES, best_spans, in_order, scan, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for x, label in BASE for p in [x.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


TEXTS = [
    None, "", "The MIT", "license", "A MIT  License, an Apache-License!", "GNU General Public\nLicense gnu general public license cc by cc by", "été MIT licensé mit license",
    "x " * 5000 + "Released under the MIT License.", "Released under the MIT License. " * 300, "same apache license", "same apache license",
    "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met:",
    "Redistribution and use in source and binary forms of trees", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
]


def test_as_brute_force(spark):
    ship(spark)
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(TEXTS)], "doc_id long, text string, labels string, spans int")
    got = {r.doc_id: r for r in scan(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[11].labels == "bsd" and got[11].base_labels == "" and got[12].labels == "" and got[13].labels == "mpl"
    assert got[8].n_base == 300 and got[0].score == 0


def test_repeated_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (1, "nothing here"), (None, "Licensed under CC BY 4.0"), (None, None)], "doc_id long, text string")
    ship(spark)
    got = sorted((str(r.doc_id), r.labels) for r in scan(docs).collect())
    assert got == [("1", ""), ("1", "mit"), ("None", ""), ("None", "cc-by")]
    assert scan(docs.limit(0)).count() == 0


def test_words_in_order_as_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([bytes([rng.choice(b"abcd")]) for _ in range(rng.randint(1, 70))] for _ in range(2))
        table = [[0] * (len(b) + 1)]
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(table[-1][j] + 1 if x == y else max(row[j], table[-1][j + 1]))
            table.append(row)
        assert in_order(a, b) == table[-1][-1]


def test_every_template_is_found_alone_and_changed(spark):
    ship(spark)
    rng = random.Random(2)
    noise = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    rows = []
    for label, text in TEMPLATES:
        words = [w.decode() for w in words_of(text)]
        changed = [x for i, w in enumerate(words) for x in ([w, "put"] if len(words) > 12 and i % 25 == 24 else [] if len(words) > 12 and i % 17 == 11 else [w])]
        rows += [(label, noise(300) + "\n" + text.upper() + "\n" + noise(300)), (label, " ".join(changed)), ("", noise(50) + " " + " ".join(words[: len(words) // 2]))]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in scan(docs).collect()}
    for i, (label, text) in enumerate(rows):
        if i % 3 == 2 and len(words_of(TEMPLATES[i // 3][1])) > 24:
            continue  # half of a whole text holds shorter notices
        assert label in got[i].labels.split(","), (label, text, got[i])
        if label and i % 3 == 0:
            assert set(got[i].labels.split(",")) <= {label, *got[i].base_labels.split(",")}, (label, got[i])


def test_neighbours_repeats_and_rows_without_id(spark, monkeypatch):
    ship(spark)
    gap = " ".join(f"between{i}" for i in range(40))
    lesser = "This program is free software: under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"
    texts = [
        f"Released under the MIT License {gap} All rights reserved", "Licensed under CC BY 4.0", "Licensed under CC BY-NC 4.0", lesser,
        "all the rights are not ours to have been reserved", "Released under the MIT License. " * 3000, " ".join(w for x in words_of("Released under the MIT License") for w in (x.decode(), gap)),
    ]
    docs = spark.createDataFrame([(None, t) for t in texts] * 2, "doc_id long, text string")
    want = sorted(["all-rights-reserved,mit", "cc-by", "cc-by,cc-by-nc", "lgpl", "", "mit", ""] * 2)
    assert sorted(r.labels for r in scan(docs).collect()) == want
    assert max(len(r.spans) for r in scan(docs).collect()) == 3000
    monkeypatch.setattr(license_scan, "BROADCAST_ROWS", -1)
    assert sorted(r.labels for r in scan(docs).collect()) == want


def test_best_spans():
    span = lambda label, first, last, words, cover: {"label": label, "first": first, "last": last, "words": words, "cover": cover}
    a, b, c, d = span("a", 0, 10, 10, 1.0), span("b", 2, 8, 5, 1.0), span("c", 9, 20, 8, 0.9), span("d", 30, 40, 4, 0.8)
    assert best_spans([b, c, d, a]) == [a, d] and best_spans([]) == [] and best_spans([c, d]) == [c, d]
