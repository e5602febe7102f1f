"""Terms near words: distances against all pairs, and filings written for one rule each."""

import random
import re
from datetime import date

from pyspark.sql import functions as F

from tidewater.operators import proximity as near
from tidewater.plans import catalog  # first, as the others add to it
from tidewater.plans import catalog_filings as filings


def docs(spark, *texts, **more):
    names = ["doc_id long", "text string", *(f"{k} {v[0]}" for k, v in more.items())]
    return spark.createDataFrame([(i, t, *(v[1] for v in more.values())) for i, t in enumerate(texts)], ", ".join(names))


def by_doc(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_places_and_distances_against_all_pairs(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["$1.00 ", "red ", "x", "blue", " ", "$2.50", "é", "\n\t", "reds "]) for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", "$3.00"]
    frame = docs(spark, *texts).repartition(3)
    found = near.located(frame, {"amount": r"\$(\d\.\d+)", "word": r"\breds?\b"}).withColumn("near", near.beside("word", 9, 5)).withColumn("other", near.distance_to_other()).collect()
    for i, t in enumerate(texts):
        flat = " ".join((t or "").split())
        words = [(m.start(), m.end()) for m in re.finditer(r"\breds?\b", flat)]
        want = []
        amounts = list(re.finditer(r"\$(\d\.\d+)", flat))
        for m in amounts:
            others = [abs(x.start() - m.start()) for x in amounts if x is not m]
            want.append((m.start(), m.end(), m[1], any(a >= m.start() - 9 and b <= m.end() + 5 for a, b in words), min(others, default=None)))
        assert sorted((r.start, r.end, r.value, r.near, r.other) for r in found if r.doc_id == i and r.kind == "amount") == want


def test_ratio_windows(spark):
    gap = "x" * 130 + " "
    t = [
        "A 1-for-10 reverse split.", "A reverse split between 1-for-2 and 1-for-9.", "reverse split range of 1-for-2 to 1-for-9. " + gap * 2 + "We chose a one-for-twenty-four reverse split.",
        "1-for-10 odds" + gap * 3, "reverse split: up to " + "y" * 100 + " 1-for-5", "reverse split: up to " + "y" * 160 + " 1-for-5", "reverse 1-for-4 " + gap + "reverse 1-for-6 " + gap + "reverse 1-for-6",
        "reverse 1-for-1, then none", "reverse 1-for-4 " + "z" * 40 + " up to", "reverse 1-for-4 " + "z" * 30 + " up to", None, "reverse 1-for-3 " + "w" * 120 + " 1-for-8 reverse",
    ]
    assert by_doc(near.chosen_ratios(docs(spark, *t)), "ratio", "is_range") == {
        0: (10, False), 1: (None, True), 2: (24, False), 4: (None, True), 5: (5, False), 6: (6, False), 8: (4, False), 9: (None, True), 11: (3, False),
    }


def test_redemption_amounts(spark):
    far = "z" * 270 + " "
    t = [
        "You may redeem for $10.08 per share. " + far + "You redeem $10.00 per share and again redeem $10.00 per share.", "redeem at $10.00 per share", "warrant exercise redeem $11.50 per share", "redeem " + far + "$10.05 per share",
        "redeem at $15.00 per share", "The current redemption amount of approximately $10.31. " + far + "redeem $10.20 per share " + far + "redeem $10.20 per share", None, "The per-share price at which shares will be redeemed from trust is $10.44. " + far + "redeem $10.09 per share",
    ]
    assert by_doc(near.redemption_amounts(docs(spark, *t)), "stated_amount") == {0: 10.08, 1: 10.0, 5: 10.31, 7: 10.44}


def test_updates_are_dated_after_filing(spark):
    filed = date(2020, 5, 1)
    t = [
        "The meeting was postponed to May 20, 2020, then adjourned until June 3, 2020.", "The meeting was postponed to April 20, 2020.", "The meeting was postponed to December 20, 2020.", "The deadline was extended to July 9, 2020. It had been extended to June 9, 2020.",
        "The company will dissolve and liquidate. Shares will be redeemed on or about May 9, 2020.", "Holders redeemed 1,000,000 shares in the redemption for $10,250,000.", "What was redeemed will be approximately $10.10 per share", "The redemption price was $10.11 per share.", "",
    ]
    got = by_doc(near.event_updates(docs(spark, *t, filed=("date", filed))), "postponed_to", "extended_to", "liquidation", "liquidation_date", "per_share")
    assert got[0][0] == date(2020, 6, 3) and got[1][0] is None and got[2][0] is None and got[3][1] == date(2020, 7, 9)
    assert got[4][2:4] == (True, date(2020, 5, 9)) and got[5][4] == 10.25 and got[7][4] == 10.11 and got[7][2] is False


def test_offers(spark):
    filed = date(2020, 5, 1)
    t = [
        "Offer to purchase common shares. It expires on , 2020, or June 2, 2020. Odd lots: fewer than 100 shares. Odd lots have priority.", "Offer to purchase its notes. Expiration: April 1, 2020, extended; it expires June 9, 2020.", "An offer without dates. Odd lots have priority.",
        "Offer to purchase shares held by holders of 99 or fewer shares", "June 2, 2020 is the day. " + "q" * 300,
    ]
    got = by_doc(near.offer_details(docs(spark, *t, filed=("date", filed))), "expires", "odd_lot", "odd_lot_priority", "odd_lot_only", "security")
    assert got[0] == (date(2020, 6, 2), 100, True, False, "common") and got[1] == (date(2020, 6, 9), None, False, False, "notes")
    assert got[2][1:3] == (None, False) and got[3][3] is True and got[4][0] is None


def test_fraction_votes(spark):
    up, cash = "Fractional shares will be rounded up.", "Cash is paid for a fraction."
    t = [up, cash, f"{up} {up} {cash}", f"{up} {cash}", "Fractional shares of holders of record are rounded up. " + up, "A fraction is rounded to the nearest whole share, one half rounded up.", "Options on fractional shares are rounded up.", "Fractional holders are cashed-out. " + up, None, "No one is paid for a fraction of holders of record. Instead, each fraction is rounded up.", "Fractional shares are paid in cash or rounded up."]
    assert by_doc(near.fraction_treatment(docs(spark, *t)), "treatment") == dict(enumerate(["ROUNDUP_HOLDER", "CASH", "ROUNDUP_HOLDER", "UNKNOWN", "ROUNDUP_PARTICIPANT", "UNKNOWN", "UNKNOWN", "CASH", "UNKNOWN", "ROUNDUP_PARTICIPANT", "UNKNOWN"]))


def test_days(spark):
    d = spark.createDataFrame([("March 5 , 2021",), ("FEBRUARY  30, 2021",), ("june 1,2021",)], "v string")
    assert [r[0] for r in d.select(near.day(F.col("v"))).collect()] == [date(2021, 3, 5), None, date(2021, 6, 1)]


def test_filings_are_dealt_out_and_matches_sorted_twice(spark):
    """One file of orders is more texts than a task should read; all that is asked of a match's neighbours shares two sorts."""
    sf = "/root/testdata/sf0.001"
    assert filings.filings(spark, sf, "x").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    for query in map(catalog.QUERIES.get, ("k_offer_details", "k_event_updates", "k_redemption_amounts")):
        plan = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        # of `start`, in two directions; event updates read the amounts by a pass of their own
        assert plan.count("Window [last(") <= (4 if query is filings.k_event_updates else 2)


#: Pieces of texts that begin, fill or break patterns; some of other scripts that case folding takes for letters, or that are digits.
PIECES = [
    "January 5, 2021", "may 31 , 2020", "On or about", "as of ", "on ", "Tuesday, ", "$10.20", "$ 9.5", "$1,000,000 million", "per share", "per-ſhare", "for each", "expired", "EXPIRATION", "odd lots", "odd‑lot", "odd - lot tender offer", "fewer than 100 shares", "less than one hundred (100) whole units",
    "priority", "before proration", "not be subject to proration", "held by holders of 99 or fewer", "notes", "bonds", "options", "warrants", "preferred", "units", "rights", "common", "ordinary", "stocK", "offer to purchase", "1-for-7", "one for twenty-one", "١-for-3", "1-for-٣", "reverse", "consolidated", "combination", "ırange", "range",
    "no less than", "not more than", "up to", "at least", "as low as", "postponed to", "adjourned", "extended the date until", "approved the extension", "will not complete an initial business combination", "redeem all outstanding", "dissolve and liquidate", "wind-up", "was redeemed on", "effective ",
    "per-share redemption price", "redeemed", "redemption payment", "right to redeem", "would be", "expected", "exercise", "strike", "earnout", "trust account", "٢٣,5 shares tendered", "1,000 of the shares redeemed for $9,000", "current redemption amount of approximately ", "conversion right", "Kept", ". ", "“", " ", "  ", "\n", ", ", "x",
]


def patterns_of(spark, monkeypatch, *operators):
    """The patterns that operators look for."""
    told, plain = {}, near.located

    def heard(docs, patterns, *args, **kw):
        told.update(patterns)
        return plain(docs, patterns, *args, **kw)

    with monkeypatch.context() as m:
        m.setattr(near, "located", heard)
        for operator in operators:
            operator(docs(spark, "x", filed=("date", date(2020, 5, 1)), form=("string", "DEF 14A")))
            yield operator.__name__, dict(told)
            told.clear()


def found_by_beginnings(spark, monkeypatch, *operators):
    rng = random.Random(3)
    texts = [rng.choice(["", " "]).join(rng.choice(PIECES) for _ in range(rng.randint(1, 14))) for _ in range(400)] + [None, "", "o", "$1"]
    frame = docs(spark, *texts).repartition(3)
    for name, patterns in patterns_of(spark, monkeypatch, *operators):
        assert any(isinstance(p, tuple) for p in patterns.values())
        want = []
        for kind, p in patterns.items():
            for i, t in enumerate(texts):
                flat = " ".join((t or "").split())
                want += [(i, kind, m.start(), m.end(), next((g for g in m.groups() if g), m[0])) for m in re.finditer(p if isinstance(p, str) else p[0], flat, re.IGNORECASE)]
        got = [(r.doc_id, r.kind, r.start, r.end, r.value) for r in near.located(frame, patterns).collect()]
        assert sorted(got) == sorted(want), name


def test_beginnings_miss_no_match_of_offers(spark, monkeypatch):
    found_by_beginnings(spark, monkeypatch, near.offer_details)


def test_neighbours_are_told_where_texts_are_read(spark):
    """Against all pairs; texts that are told apart neither by their identifier nor by their words are read one by one."""
    rng = random.Random(2)
    texts = ["".join(rng.choice(["$1.00 ", "red ", "x", "blue", " ", "$2.50", "é", "\n\t", "red and very long "]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    patterns = {"amount": (r"\$(\d\.\d+)", "$#"), "word": (r"\bred(?: and very long)?\b", "red")}
    found = near.located(frame, patterns, near={"near": ("word", 9, 5)}, apart="other", kinds=["amount"]).collect()
    want = []
    for i, t in rows:
        flat = " ".join(t.split())
        words, amounts = ([m.span() for m in re.finditer(patterns[k][0], flat)] for k in ("word", "amount"))
        want += [(i, a, b, any(x >= a - 9 and y <= b + 5 for x, y in words), min((abs(x - a) for x, _ in amounts if x != a), default=None)) for a, b in amounts]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.start, r.end, r.near, r.other) for r in found), key=key) == sorted(want, key=key)


def shuffles(df):
    """What a plan shuffles and sorts, before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {what: len(re.findall(rf"(?m)^[^\w]*{what}\b", plan)) for what in ("Exchange", "Window", "Sort", "SortMergeJoin", "MapInArrow")}


def test_offers_are_read_without_sorts(spark):
    got = shuffles(catalog.QUERIES["k_offer_details"](spark, "/root/testdata/sf0.001"))
    assert got == {"Exchange": 2, "Window": 0, "Sort": 0, "SortMergeJoin": 0, "MapInArrow": 1}  # orders dealt out, and a row for each document and task


def test_beginnings_miss_no_match_of_ratios(spark, monkeypatch):
    found_by_beginnings(spark, monkeypatch, near.chosen_ratios)


def test_ratios_are_read_without_windows_or_joins(spark):
    got = shuffles(catalog.QUERIES["k_chosen_ratios"](spark, "/root/testdata/sf0.001"))
    assert (got["Window"], got["SortMergeJoin"], got["MapInArrow"]) == (0, 0, 1)


def test_a_filing_listed_twice_is_no_range(spark):
    """Its copies are read one by one: a ratio is no neighbour of its own copy."""
    frame = docs(spark, "A 1-for-10 reverse split.", "A 1-for-4 reverse split, then 1-for-5.")
    assert by_doc(near.chosen_ratios(frame.unionByName(frame)), "ratio", "is_range") == {0: (10, False), 1: (None, True)}


def test_beginnings_miss_no_match_of_filings(spark, monkeypatch):
    found_by_beginnings(spark, monkeypatch, near.event_updates, near.redemption_amounts, near.prospectus_terms, near.meeting_terms)


def test_updates_are_read_once(spark):
    """One reading of the texts finds what is told of events and the stated amounts; nothing is joined to it."""
    got = shuffles(catalog.QUERIES["k_event_updates"](spark, "/root/testdata/sf0.001"))
    assert (got["MapInArrow"], got["Window"], got["SortMergeJoin"]) == (1, 0, 0)


def test_updates_of_documents_with_some_words_only(spark):
    """Words beside which nothing stands make a document an update; words of stated amounts alone do not."""
    t = ["It is expected.", "A trust account.", "The per share price in trust is $10.31.", "It is expected. The per share price in trust is $10.31.", "Shares of all redeemed at $10.20 per share, $10.30 per share and then $10.30 per share."]
    got = by_doc(near.event_updates(docs(spark, *t, filed=("date", date(2020, 5, 1)))), "liquidation", "per_share")
    assert got == {0: (False, None), 3: (False, 10.31), 4: (False, 10.2)}
    frame = docs(spark, "They redeem $10.20 per share", "They redeem $10.30 per share; $10.30 per share.").withColumn("doc_id", F.lit(7))
    assert by_doc(near.redemption_amounts(frame), "stated_amount") == {7: 10.3}


def test_offers_of_documents_with_some_words_only(spark):
    got = by_doc(near.offer_details(docs(spark, "It expires.", "Odd lots.", "Offer to purchase", "Nothing.", filed=("date", date(2020, 5, 1)))), "odd_lot_priority", "odd_lot_only", "security")
    assert got == dict.fromkeys(range(3), (False, False, "other"))


def test_days_are_the_same_read_in_python(spark):
    t = ["on March 5, 2021", "on FEBRUARY 30, 2021", "on june 1,2021", "on May 09 , 1997", "on July 0, 2020", "on auguſt 3, 2020", "on June ٣, 2020", "on February 29, 2020", "on January 1, 0001"]
    found = near.located(docs(spark, *t), {"on": (f"on {near.DATE}", "on ")}, days=["on"])
    rows = found.select("doc_id", "day", near.day(F.col("value")).alias("want")).collect()
    assert len(rows) == len(t) and all(r.day == r.want for r in rows)
    assert sum(r.day is None for r in rows) == 3
