"""Hand-computed answers, planted defects and round trips of operators that SQL does not cover."""

import hashlib
import json
import math
import statistics
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.functions import scalar
from tidewater.operators import aggregates, features, inference, joins, outcomes, pit, quality, signals, text, windows
from tidewater.sources import readers
from tidewater.streaming import jobs

D0 = date(2024, 1, 1)


def bars_of(spark, closes, symbol="A", **columns):
    rows = [(symbol, D0 + timedelta(i), float(c), float(c) + 1, float(c) - 1, float(c), float(c), 100 + i) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, readers.BARS)


def test_normal_functions(spark):
    p = [1e-6, 0.01, 0.2, 0.5, 0.9, 0.999]
    n = statistics.NormalDist()
    rows = spark.createDataFrame([(x, n.inv_cdf(x)) for x in p], "p double, z double").select("p", "z", scalar.normal_quantile(F.col("p")).alias("q"), scalar.normal_cdf(F.col("z")).alias("c")).collect()
    for r in rows:
        assert r.q == pytest.approx(r.z, abs=1e-7) and r.c == pytest.approx(r.p, abs=2e-7)


def test_small_functions(spark):
    df = spark.createDataFrame([("one", "20240229", 3.0, None), ("Twenty-One", "Mar 1, 2024", 1.0, 2.0), ("17", "x", 2.0, 5.0)], "w string, d string, a double, b double")
    got = df.select(scalar.number_word(F.col("w")).alias("n"), scalar.parse_date(F.col("d"), "yyyyMMdd", "MMM d, yyyy").alias("d"), scalar.poisoned(F.greatest, F.col("a"), F.col("b")).alias("g")).collect()
    assert [tuple(r) for r in got] == [(1, date(2024, 2, 29), None), (21, date(2024, 3, 1), 2.0), (17, None, 5.0)]
    q = spark.createDataFrame([(date(2024, 2, 1),), (date(2017, 9, 5),)], "d date").select(scalar.quarter_label(F.col("d")).alias("q"), scalar.previous_quarter(F.col("d")).alias("p"), scalar.settlement_days(F.col("d")).alias("s")).collect()
    assert [tuple(r) for r in q] == [("2024Q1", "2023Q4", 2), ("2017Q3", "2017Q2", 2)]
    assert spark.range(1).select(scalar.html_text(F.lit("<style>p{}</style><p>a&amp;b</p><script>x</script><b>c</b>")).alias("t")).first().t == "a&b\nc"


def test_recursive_means_as_pandas(spark):
    rng = np.random.default_rng(1)
    closes = 100 + np.cumsum(rng.normal(size=260))
    got = signals.recursive_means(bars_of(spark, closes)).orderBy("dt").toPandas()
    s = pd.Series(closes)
    y, out = None, []
    for x in closes:
        y = x if y is None else y + (2 / 13) * (x - y)
        out.append(y)
    assert got["ema_12"].iloc[50:].to_numpy() == pytest.approx(np.array(out)[50:])
    assert got["ema_12"].iloc[:11].isna().all() and got["rsi_14"].dropna().between(0, 100).all() and len(s) == len(got)


def test_first_touch_ties_and_gaps(spark):
    bars = bars_of(spark, [100.0] * 14 + [100.0, 90.0, 130.0])
    got = {r.dt: r for r in outcomes.first_touch(bars, horizon=3).collect()}
    first = got[D0 + timedelta(13)]  # atr 2: stop 96, target 106; the third bar gaps to 90
    assert (first.outcome, first.days) == ("stop", 2) and first.gross == pytest.approx(90 / 100 - 1)
    both = spark.createDataFrame([("A", D0 + timedelta(i), 100.0, 101.0, 99.0, 100.0, 100.0, 1) for i in range(14)] + [("A", D0 + timedelta(14), 100.0, 150.0, 50.0, 100.0, 100.0, 1)], readers.BARS)
    row = {r.dt: r for r in outcomes.first_touch(both).collect()}[D0 + timedelta(13)]
    assert row.outcome == "stop" and row.gross == pytest.approx(-0.04)


def test_planted_leaks_are_found(spark):
    bars = bars_of(spark, range(50, 90))
    cut = F.lit(D0 + timedelta(30)).cast("date")
    leak = lambda d: d.withColumn("f", F.lead("close").over(features.by_symbol()))
    clean = lambda d: d.withColumn("f", F.lag("close").over(features.by_symbol()))
    assert pit.truncation_audit(leak, bars, cut, "dt", ["symbol", "dt"], ["f"]).count() == 1
    assert pit.truncation_audit(clean, bars, cut, "dt", ["symbol", "dt"], ["f"]).count() == 0
    assert pit.basis_audit(lambda d: d.withColumn("f", F.col("adj_close")), bars, ["symbol", "dt"], ["f"]).count() == 40
    assert pit.forward_columns(features.forward_labels(bars)) == ["fwd_1", "fwd_5", "fwd_21"]
    trades = bars.select("dt", "close")
    mean = lambda d: d.crossJoin(d.agg(F.avg("close").alias("weight")))
    assert pit.causal_weights(trades, mean, [D0 + timedelta(20)], "dt", ["dt"]).count() == 21
    assert pit.causal_weights(trades, lambda d: d.withColumn("weight", F.lit(1.0)), [D0 + timedelta(20)], "dt", ["dt"]).count() == 0


def test_hash_chain_tampering(spark):
    rows, prev = [], "0" * 64
    for i in range(20):
        payload = json.dumps({"n": i})
        h = hashlib.sha256((prev + payload).encode()).hexdigest()
        rows.append([i, payload, prev, h])
        prev = h
    check = lambda r: quality.first_broken_link(spark.createDataFrame(r, "line int, payload string, prev_hash string, entry_hash string"), "line", F.col("payload")).first().first_broken
    assert check(rows) is None
    edited = [list(r) for r in rows]
    edited[7][1] = json.dumps({"n": 99})
    assert check(edited) == 7 and check(rows[:4] + rows[5:]) == 5


def test_known_timeline_and_ttm(spark):
    f = spark.createDataFrame([("X", 1, None, 10, False), ("X", 2, "C", None, True), ("X", 3, None, 12, False), ("X", 4, None, None, True)], "issuer string, usable int, cls string, ratio int, cancel boolean").withColumn("effective", F.lit(None).cast("date"))
    got = pit.known_timeline(f, ["issuer"], ["usable"]).orderBy("usable").collect()
    assert [(r.known_cls, r.known_ratio, r.announced, r.cancelled) for r in got] == [(None, 10, None, False), ("C", 10, 2, True), ("C", 12, 2, True), ("C", 12, 2, True)]
    q = [("A", date(2023, 1 + 3 * i, 1), date(2023, 3 + 3 * i, 28), date(2023, 4, 20) + timedelta(92 * i), float(10 + i)) for i in range(4)]
    filings = spark.createDataFrame([*q, ("A", date(2022, 1, 1), date(2022, 12, 31), date(2023, 2, 1), 99.0), (*q[0][:3], date(2023, 12, 1), 20.0)], "symbol string, period_start date, period_end date, filed date, val double")
    asof = spark.createDataFrame([("A", date(2023, 3, 1)), ("A", date(2023, 8, 1)), ("A", date(2024, 3, 1))], "symbol string, as_of date")
    assert {r.as_of: r.ttm for r in pit.ttm(filings, asof).collect()} == {date(2023, 3, 1): 99.0, date(2023, 8, 1): None, date(2024, 3, 1): 20.0 + 11 + 12 + 13}


def test_joins(spark):
    a = spark.createDataFrame([("Acme Holdings Inc", "ACME Corp."), ("Beta Oil", "Gamma Gas"), ("North Star Trust", "Star Shipping")], "a string, b string")
    assert [r.s for r in a.select(joins.same_issuer(F.col("a"), F.col("b")).alias("s")).collect()] == [True, False, True]
    df = spark.createDataFrame([(1, "x", None), (2, "y", "t2"), (3, "z", "t9")], "id int, cusip string, ticker string")
    by_cusip = spark.createDataFrame([("x", 10), ("y", 20), ("y", 21)], "cusip string, permno int")
    by_ticker = spark.createDataFrame([("t2", 22), ("t2", 22)], "ticker string, permno int")
    got = joins.cascade_link(df, [(by_cusip, ["cusip"], "permno"), (by_ticker, ["ticker"], "permno")], "permno")
    assert {r.id: r.permno for r in got.collect()} == {1: 10, 2: 22, 3: None}
    m = joins.overrides(df, spark.createDataFrame([(3, "w", None)], "id int, cusip string, ticker string"), ["id"], ["cusip", "ticker"])
    assert {(r.id, r.cusip, r.ticker) for r in m.collect()} == {(1, "x", None), (2, "y", "t2"), (3, "w", "t9")}


def test_asof_rules(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5), (None, 5), ("a", None)], "k string, t int")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 3, 2.0), ("a", 3, 7.0), ("a", None, 9.0)], "k string, u int, v double")
    for exact, want in ((True, 1.0), (False, 7.0)):
        got = {(r.k, r.t): r.v for r in joins.asof(left, right, ["k"], "t", "u", ["v"], exact).collect()}
        assert got == {("a", 1): None, ("a", 5): want, ("b", 5): None, (None, 5): None, ("a", None): None}


def test_inference_properties(spark):
    rng = np.random.default_rng(5)
    block = np.repeat(rng.normal(size=60), 20)
    df = spark.createDataFrame([(i // 20, float(v), "g") for i, v in enumerate(block)], "c int, v double, g string")
    wide = inference.clustered_mean(df, "v", ["c"], ["g"]).first().se
    assert wide > 2.5 * block.std(ddof=1) / math.sqrt(len(block))
    x = rng.normal(size=800)
    s = spark.createDataFrame([(i, float(a), float(0.001 + 0.5 * a + b)) for i, (a, b) in enumerate(zip(x, rng.normal(0, 0.001, 800), strict=True))], "t int, f double, y double")
    out = inference.factor_alpha(s, "y", ["f"], "t")
    assert out["alpha"] == pytest.approx(0.252, abs=0.05) and out["f"] == pytest.approx(0.5, abs=0.01)
    plain = inference.newey_west(s.withColumn("g", F.lit(1)), "y", "t", ["g"], 0).first()
    y = np.array([r.y for r in s.orderBy("t").collect()])
    assert plain.t == pytest.approx(y.mean() / (y.std() / math.sqrt(len(y))), rel=1e-9)
    b = inference.stationary_bootstrap(s, ["y"], "t", reps=200).toPandas()["y"]
    assert len(b) == 200 and b.mean() == pytest.approx(y.mean(), abs=0.1)
    p = inference.iid_bootstrap_p(spark.createDataFrame([("n", i, float(v)) for i, v in enumerate(rng.normal(0, 1, 300))] + [("s", i, float(v)) for i, v in enumerate(rng.normal(1, 1, 300))], "g string, i int, v double"), "v", ["g"], ["i"], 300)
    got = {r.g: r.p for r in p.collect()}
    assert got["s"] == 0 and got["n"] > 0.01


def test_quality(spark):
    raw = spark.createDataFrame([("A", "2024-01-02", 1.0, 2.0, 0.5, 1.5, None, None, 1), ("A", "2024-01-02", 1.0, 2.0, 0.5, 1.6, 1.6, 5, 2), ("A", "2024-01-03", 0.0, 2.0, 0.5, 1.5, 1.5, 5, 1)], "Symbol string, Dt string, Open double, High double, Low double, Close double, `Adj Close` double, Volume long, Run int")
    assert [(r.close, r.adj_close, r.volume) for r in quality.normalize_bars(raw, "run").collect()] == [(1.6, 1.6, 5)]
    old = spark.createDataFrame([("k", 1, 1.0, "a"), ("k", 2, 2.0, "b")], "k string, seq int, x double, y string")
    new = spark.createDataFrame([("k", 3, 2.0, "b"), ("k", 4, 2.0, "c"), ("m", 1, None, None)], "k string, seq int, x double, y string")
    assert sorted(r.seq for r in quality.changed_rows(old, new, ["k"], ["x", "y"], "seq").collect()) == [1, 4]
    assert aggregates.dominant(spark.createDataFrame([(1, "H"), (1, "P"), (1, "P"), (2, "A"), (2, "B")], "d int, k string"), ["d"], "k", {"H": "P"}).orderBy("d").collect()[0].k == "P"
    w = windows.top_k(spark.createDataFrame([("a", 1), ("a", 3), ("a", 2)], "g string, v int"), ["g"], [F.desc("v")], 2)
    assert sorted(r.v for r in w.collect()) == [2, 3]


def test_text(spark):
    docs = spark.createDataFrame([(1, "The Board of Acme Inc. approved a one-for-twenty split. The split has been abandoned. It may be terminated.")], "doc_id int, text string")
    s = text.sentences(docs)
    assert [r.sentence for r in s.orderBy("n").collect()] == ["The Board of Acme Inc. approved a one-for-twenty split.", "The split has been abandoned.", "It may be terminated."]
    assert text.ratios(s, "doc_id").first().ratio == 20 and text.cancellations(s, "doc_id").first().sentence_n == 1
    terms = text.offer_terms(spark.createDataFrame([(1, "to purchase up to 1,500,000 shares at a price of $12.50 per share; holders of fewer than 100 shares; symbol \"ACME\"")], "doc_id int, text string")).first()
    assert (terms.price, terms.quantity, terms.odd_lot, terms.ticker) == (12.5, 1_500_000, 100, "ACME")
    box = spark.createDataFrame([("f", "<DOCUMENT><TYPE>EX-1\n<TEXT>Offer to purchase, long text</TEXT></DOCUMENT><DOCUMENT><TYPE>GRAPHIC\n<TEXT>x</TEXT></DOCUMENT>")], "id string, text string")
    p = text.parts(box)
    assert [r.type for r in p.collect()] == ["EX-1"] and text.main_part(p, "(?i)offer to purchase", "(?i)letter of").count() == 1
    wiki = spark.createDataFrame([(1, "{{NyseSymbol|BRK.B}} {{NasdaqSymbol|AAPL}} {{NyseSymbol|BRK.B}} == Recent changes == {{NyseSymbol|OLD}}")], "id int, text string")
    assert sorted(r.symbol for r in text.constituents(wiki, "id", "text").collect()) == ["AAPL", "BRK-B"]


def test_constituents_of_all_templates_and_bare_cells(spark):
    six = "{{NYSE|A}} {{NyseSymbol|BRK-B}} {{Nasdaq|C}} {{NasdaqSymbol|BF.B}} {{BATS|E}} {{NYSEAmerican|F}}"
    many = " ".join(f"{{{{NYSE|{a}{b}}}}}" for a in "ABCDEFGHIJKLMNOPQRST" for b in "ABCDEFGHIJKLMNOPQRSTUVWX")
    pages = spark.createDataFrame([(1, six), (2, "|-\n| GOOD\n|Some name\n|BRK.B \n{{NYSE|A}}"), (3, many + "\n| BARE\n")], "id int, text string")
    got = {}
    for r in text.constituents(pages, "id", "text").collect():
        got.setdefault((r.id, r.plausible), set()).add(r.symbol)
    assert got[(1, False)] == {"A", "BRK-B", "C", "BF-B", "E", "F"} and got[(2, False)] == {"A", "GOOD", "BRK-B"}
    assert len(got) == 3 and len(got[(3, True)]) == 480 and "BARE" not in got[(3, True)]


def test_readers(spark, tmp_path):
    (tmp_path / "b.csv").write_text("symbol,dt,open,high,low,close,adj_close,volume\nA,2024-01-02,1,2,0.5,1.5,1.5,10\n")
    assert readers.bars_csv(spark, f"{tmp_path}/b.csv").first().volume == 10
    m = spark.createDataFrame([("2023-12",), ("2024-01",), ("2024-02",)], "month string")
    assert readers.bounded(m, "month", "2024-02-15").count() == 2
    with pytest.raises(PermissionError):
        readers.sealed(m, "month", "2024-01-01", "2024-02-01")
    (tmp_path / "t.tsv").write_text("accession\tcode\tshares\na1\tP\t5\na1\tP\tx\na2\tG\t7\n")
    t = readers.tsv(spark, f"{tmp_path}/t.tsv", "accession string, code string, shares int")
    got = readers.insider_trades(spark.createDataFrame([("a1", "4"), ("a2", "4")], "accession string, form string"), t, spark.createDataFrame([("a1", "zoe"), ("a1", "ann")], "accession string, owner string"))
    assert [(r.accession, r.owner) for r in got.collect()] == [("a1", "ann")]
    fact = {"end": "2023-12-31", "val": 5.0, "accn": "n1", "form": "10-K", "filed": "2024-02-01"}
    doc = json.dumps({"facts": {"us-gaap": {"Assets": {"units": {"USD": [fact, {**fact, "form": "8-K"}], "EUR": [fact]}}}, "ifrs-full": {"Assets": {"units": {"USD": [fact, fact]}}}}})
    f = readers.json_facts(spark.createDataFrame([("A", doc)], "key string, json string"), ["Assets"], ["us-gaap", "ifrs-full"])
    assert [(r.unit, r.val, r.form) for r in f.collect()] == [("USD", 5.0, "10-K")]
    assert readers.filing_balance(f, ["Trust", "Assets"]).first().balance == 5.0
    (tmp_path / "form.idx").write_text("Form Type   Company Name   CIK   Date Filed  File Name\nSC TO-I     ACME CORP              123456      2024-01-05  edgar/data/1.txt\n10-K        X     9   2024-01-05  y\n")
    i = readers.form_index(spark, f"{tmp_path}/form.idx", ["SC TO-I"]).first()
    assert (i.company, i.cik, i.filed, i.path) == ("ACME CORP", "123456", date(2024, 1, 5), "edgar/data/1.txt")
    lines = spark.createDataFrame(list(enumerate(["text", "", ",Mkt,RF", "20240102, 1.5, 0.02", "20240103, -1, 0.02", "", ",Mkt,RF", "2024, 9, 9"])), "n int, value string")
    assert [r.Mkt for r in readers.first_block(lines, ["Mkt", "RF"]).orderBy("dt").collect()] == [0.015, -0.01]
    readers.materialize(bars_of(spark, range(10)), f"{tmp_path}/out")
    assert readers.bounded_parquet(spark, f"{tmp_path}/out", ["symbol", "dt"], max_date="2024-01-03").count() == 3
    for kind in ("csv", "json"):
        readers.materialize(bars_of(spark, range(10)), f"{tmp_path}/{kind}", kind=kind)
        back = readers.many_files(spark, f"{tmp_path}/{kind}/year=*/*", "symbol string, dt date, open double", kind)
        assert back.count() == 10 and back.where("symbol is null or file = ''").count() == 0


def test_streams(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 9, i), "A", 10.0 + i, 1) for i in range(50)]
    src = f"{tmp_path}/src"
    spark.createDataFrame(rows, "ts timestamp, symbol string, price double, quantity int").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, symbol string, price double, quantity int").parquet(src)
    for _ in range(2):
        jobs.scoring_stream(stream, lambda d: d.select("symbol", "ts", (F.col("price") > 20).alias("up")), f"{tmp_path}/scores", f"{tmp_path}/c{_}", ["symbol", "ts"], "ts").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/scores").count() == 50
    changes = spark.readStream.schema("ts timestamp, symbol string, price double, quantity int").parquet(src)
    for _ in range(2):
        jobs.change_stream(changes, f"{tmp_path}/changes", f"{tmp_path}/d{_}", ["symbol"], ["price"], "ts").awaitTermination()
    # each price differs from the one before it; rows that come again change nothing
    assert sorted(r.price for r in spark.read.parquet(f"{tmp_path}/changes").collect()) == [10.0 + i for i in range(50)]
    old = spark.createDataFrame([("A", 3, 1.0)], "k string, at int, v double")
    new = spark.createDataFrame([("A", 2, 9.0), ("A", 4, 1.0), ("A", 5, 2.0), ("A", 6, 2.0), ("A", 7, 1.0), ("B", 1, None), ("B", 2, None)], "k string, at int, v double")
    assert sorted((r.k, r.at) for r in quality.changes(old, new, ["k"], ["v"], "at").collect()) == [("A", 5), ("A", 7), ("B", 1)]
    assert jobs.hourly_bars(spark.read.parquet(src)).first().volume == 50
    out = jobs.hourly_bars(stream).writeStream.format("memory").queryName("bars_mem").outputMode("append").option("checkpointLocation", f"{tmp_path}/m").trigger(availableNow=True).start()
    out.awaitTermination()
    p = spark.createDataFrame([("A", datetime(2024, 1, 1), 0.6), ("A", datetime(2024, 1, 2), 0.7)], "symbol string, ts timestamp, probability double")
    y = spark.createDataFrame([("A", datetime(2024, 1, 3), datetime(2024, 1, 1), 1)], "symbol string, known_ts timestamp, for_ts timestamp, outcome int")
    assert {r.ts.day: r.outcome for r in jobs.resolved(p, y).collect()} == {1: 1, 2: None}


def test_events(spark):
    from tidewater.operators import events

    q = spark.createDataFrame([(10.0, 10.2), (5.0, 10.0), (0.0, 1.0)], "b double, a double").select(*(x.alias(n) for x, n in zip(events.valid_quote(F.col("b"), F.col("a")), "ba", strict=True)))
    assert [tuple(r) for r in q.collect()] == [(10.0, 10.2), (None, None), (None, None)]
    assert events.expected_max_normal(2) == pytest.approx(1 / math.sqrt(math.pi), abs=1e-6) and events.expected_max_normal(1) == 0
    ideas = spark.createDataFrame([(3.0, k, 100.0, 100.0, 2.0) for k in (6400, 64, 1, 0, None)], "prior_t double, tried int, n_prior double, n_new double, needed_t double")
    g = events.gate(ideas).collect()
    shrunk = {r.tried: r.shrunk_t for r in g}
    assert len(g) == 5 and shrunk[1] == shrunk[0] == shrunk[None] == 3.0 and shrunk[64] == pytest.approx(3 - 2.3437, abs=1e-3) and shrunk[6400] == 0.0
    assert events.expected_max_normal(10**6) == pytest.approx(4.8636, abs=1e-3)
    f = spark.createDataFrame([("d", 1, "2024-02-01", None, None, False), ("d", 2, "2024-03-01", None, 0.5, False), ("d", 3, None, 9.0, 0.4, True)], "deal string, at int, extended_to string, final_price double, proration double, terminated boolean")
    c = events.consolidated(f, "deal", "at").first()
    assert (c.extended_to, c.extensions, c.final_price, c.proration, c.terminated_on) == ("2024-03-01", 2, 9.0, 0.5, 3)
    m = events.mentions(spark.createDataFrame([(1, "Acme Rockets Inc."), (2, "Beta")], "entity int, name string"), spark.createDataFrame([(7, "The ACME Rockets, Inc. offer"), (8, "acme only"), (9, "alphabeta")], "doc_id int, text string"))
    assert [tuple(r) for r in m.collect()] == [(1, 7)]
    bars = bars_of(spark, [10.0, 11.0, 12.0, 13.0])
    deals = spark.createDataFrame([("x", "A", D0, D0 + timedelta(9), 15.0, None), ("y", "A", D0, D0 + timedelta(9), None, D0 + timedelta(1))], "deal string, symbol string, filed date, expires date, final_price double, terminated_on date")
    got = {(r.deal, r.fee): r.profit for r in events.tender_payoff(deals, features.calendar(bars), bars, 10, (0.0, 20.0)).collect()}
    assert got == {("x", 0.0): 40.0, ("x", 20.0): 20.0, ("y", 0.0): 10.0, ("y", 20.0): -10.0}
    panel = spark.createDataFrame([("A", D0 + timedelta(2), 9.9, D0 + timedelta(367))], "symbol string, dt date, price double, deadline date")
    rates = spark.createDataFrame([(D0 + timedelta(i), 0.01) for i in range(5)], "dt date, rate double")
    v = events.redemption_value(panel, spark.createDataFrame([("A", D0, 10.0)], "symbol string, filed date, per_share double"), rates).first()
    assert v.value == pytest.approx(10 * 1.01**2) and v.to_deadline == pytest.approx(v.value / 9.9 - 1)


def test_filing_dates_and_short_interest(spark):
    from tidewater.operators import events

    cal = spark.createDataFrame([(date(2024, 3, d), d) for d in (1, 4, 5)], "dt date, day_index int")
    docs = spark.createDataFrame([(1, "The split becomes effective on March 1, 2024 after the close of trading."), (2, "will begin trading on March 4, 2024"), (3, "nothing")], "doc_id int, text string")
    got = {r.doc_id: (r.stated, r.effective) for r in text.effective_dates(docs, cal).collect()}
    assert got == {1: (date(2024, 3, 1), date(2024, 3, 4)), 2: (date(2024, 3, 4), date(2024, 3, 4))}
    panel = spark.createDataFrame([("A", date(2024, 3, 5), 10.0)], "symbol string, dt date, adv_shares double")
    r = events.short_interest_signals(panel, spark.createDataFrame([("A", date(2024, 2, 1), 100.0), ("A", date(2024, 3, 1), 210.0)], "symbol string, tradeable_from date, short double")).first()
    assert r.short_level == -1.0 and r.short_change == pytest.approx(-1.1) and r.days_to_cover == -21.0
    keys = spark.createDataFrame([("A", 100, 2.0)], "symbol string, day_index int, adv double")
    t = spark.createDataFrame([("A", 50, 400.0, 40.0), ("A", 5, 9.0, 9.0)], "symbol string, day_index int, bought double, sold double")
    assert events.insider_signal(keys, t).first().net_buying == 2.0


def test_structural_exits_as_bar_by_bar(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(12):
        p = 100.0
        for b in range(7):
            o = p + rng.normal(0, 0.5)
            c = o + rng.normal(0, 1)
            rows.append(("A", D0 + timedelta(s), b, float(o), float(max(o, c) + abs(rng.normal(0, 0.6))), float(min(o, c) - abs(rng.normal(0, 0.6))), float(c), int(rng.integers(1, 9))))
            p = c
    bars = spark.createDataFrame(rows, "symbol string, session date, bar int, open double, high double, low double, close double, volume long")
    units = bars.select("symbol", "session").distinct().withColumn("unit", F.lit(0.008))
    got = {(r.session, r.bar, r.style): (r.gross, r.kind) for r in outcomes.structural_exits(bars, units).collect()}
    assert len(got) == 12 * 6 * 4
    sessions = [[x for x in rows if x[1] == D0 + timedelta(s)] for s in range(12)]
    for s, bar in enumerate(sessions):
        before = max(x[4] for x in sessions[s - 1]) if s else None
        for i in range(6):
            e = bar[i + 1][3]
            high = max(x[4] for x in bar[: i + 1])
            vwap = sum((x[4] + x[5] + x[6]) / 3 * x[7] for x in bar[: i + 1]) / sum(x[7] for x in bar[: i + 1])
            goals = {"resistance": min([x for x in (high, before) if x is not None and x > e], default=None), "vwap": vwap if vwap > e else None, "breakeven": None, "trailing": None}
            for style, goal in goals.items():
                stop, best, out = e * (1 - 0.008), e, None
                for _, _, _, o, h, low, c, _ in bar[i + 1 :]:
                    if low <= stop:
                        out = (min(stop, o), "stop")
                    elif goal is not None and h >= goal:
                        out = (max(goal, o), "target")
                    if out:
                        break
                    best = max(best, h)
                    if style == "breakeven" and best >= e * 1.008:
                        stop = max(stop, e)
                    if style == "trailing":
                        stop = max(stop, best - e * 0.008)
                price, kind = out or (bar[-1][6], "close")
                gross, how = got[D0 + timedelta(s), i, style]
                assert gross == pytest.approx(price / e - 1) and how == kind


def test_ties_are_drawn_apart(spark):
    rows = spark.createDataFrame([("a", i, float(i % 2)) for i in range(100)], "g string, i int, v double")
    got = inference.iid_bootstrap_p(rows, "v", ["g"], ["i"], 500).first()
    # a mean of 0.5 of coin flips has an error of 0.05: no replicate strays by as much as the mean
    assert got.p == 0 and got["mean"] == 0.5
    assert inference.iid_bootstrap_p(spark.createDataFrame([("a", 1, 2.0)], "g string, i int, v double"), "v", ["g"], ["i"], 50).first().p == 0


def test_normal_targets(spark):
    from statistics import NormalDist

    from tidewater.operators import windows

    rows = [("m", i, float(v)) for i, v in enumerate([3.0, 1.0, 2.0, 2.0])] + [("m", 9, None), ("n", 1, 5.0)]
    got = {(r.p, r.i): r for r in windows.normal_targets(spark.createDataFrame(rows, "p string, i int, v double"), "v", "p").collect()}
    for i, rank in enumerate([4, 1, 2.5, 2.5]):
        assert got["m", i].target == pytest.approx(NormalDist().inv_cdf(rank / 5), abs=1e-6) and got["m", i].weight == 0.25
    assert got["m", 9].target is None and got["m", 9].weight is None and got["n", 1].target == pytest.approx(0, abs=1e-9)


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    from tidewater.sources import readers

    path, schema = f"{tmp_path}/t", "k int, v double, at int, year int"
    readers.upsert_table(spark, path, spark.createDataFrame([(1, 1.0, 1, 2020), (2, 1.0, 1, 2020), (3, 1.0, 1, 2021), (3, 9.0, 0, 2021)], schema), ["k"], "at", "year")
    files = lambda y: sorted(p.name for p in (tmp_path / "t" / f"year={y}").iterdir())
    before = files(2021)
    more = spark.createDataFrame([(1, 2.0, 1, 2020), (2, 5.0, 0, 2020), (4, 4.0, 4, 2022)], schema)
    for _ in range(2):
        readers.upsert_table(spark, path, more, ["k"], "at", "year")
        got = sorted((r.k, r.v, r.year) for r in spark.read.parquet(path).collect())
        assert got == [(1, 2.0, 2020), (2, 1.0, 2020), (3, 1.0, 2021), (4, 4.0, 2022)] and files(2021) == before
