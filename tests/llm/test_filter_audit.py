import math
import re
from itertools import permutations

import duckdb

from tidewater.llm.filter_audit import LETTERS, audit, edges, path_counts
from tidewater.llm.queries import ORACLES, QUERIES

NAMES = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(docs, labels):
    """Apply every order to every document."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = []
    for i, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t))
        fails += "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and i > first[t])
        rows.append((part or "", set(fails), i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine, total, told = [r for r in rows if r[0] == part], dict.fromkeys(LETTERS, 0), []
        for order in permutations(LETTERS):
            left = mine
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                told.append((part, "".join(order), k + 1, len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out += [(*t, total[t[1][t[2] - 1]]) for t in told]
    return sorted(out)


def test_paths_are_factorials():
    for n in range(6):
        forward, backward = path_counts(n)
        for s in range(1 << n):
            k = s.bit_count()
            assert forward[s] == math.factorial(k) and backward[s] == math.factorial(n - k)


def test_shapley_sums_to_all_removed(spark):
    fails = spark.createDataFrame([("p", m, m * m + 1, m, 1) for m in range(8)], "part string, mask int, n long, good long, toxic long")
    got = edges(fails, 3).selectExpr("sum(orders * removed) as s").first().s
    assert got == 6 * sum(m * m + 1 for m in range(1, 8))


def test_rows_against_every_order(spark):
    long = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \n", "short Text", long, long + " #", ("a " * 60).strip(), "A" * 300 + long, "ÄÖ " * 50, long + "é" * 5000, "B B " * 40 + "$"]
    docs = [(i if i % 7 else None, texts[i % len(texts)], (None, "", "x", "y")[i % 4]) for i in range(90)]
    docs += [(5, long, "x"), (5, long, "z"), (5, "other", "x"), (40, long, "x"), (-3, "", None)] + [(1000 + i, long, "y") for i in range(300)] + [(None, long, "y")] * 50
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 90, 2)] + [(5, None, 1), (5, 1, 0), (None, 1, 1), (1100, 1, 1), (4000, 1, 1), (40, 7, 1)]
    frame = spark.createDataFrame([(*d, "n", 3) for d in docs], "doc_id long, text string, source string, part string, mask int").repartition(3)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit(frame, told)
    assert got.columns == list(NAMES) and sorted(tuple(r) for r in got.collect()) == brute(docs, labels)
    assert audit(frame.limit(0), told).count() == 0
    assert sorted(tuple(r)[:7] for r in audit(frame, told.limit(0)).collect()) == [r[:7] for r in brute(docs, labels)]


def test_table_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = sorted(con.execute(f"select {', '.join(NAMES)} from ({ORACLES['op13_filter_audit']})").fetchall())
    got = sorted(tuple(r) for r in QUERIES["op13_filter_audit"](spark, sf).select(*NAMES).collect())
    assert got == want and len(got) % 600 == 0 and got
