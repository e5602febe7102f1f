"""Operators that SQL cannot say, against plain computations."""

import html
import math
import re
import statistics
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.functions import scalar
from tidewater.operators import events, inference, modelling, signals, text
from tidewater.sources import adapters

SF = "/root/testdata/sf0.001"


def panel(n=700, symbols=3, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for s in range(symbols):
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        spread = rng.uniform(0, 0.02, n)
        out.append(pd.DataFrame({"symbol": f"S{s}", "dt": [date(2020, 1, 1) + timedelta(i) for i in range(n)], "open": close * (1 + rng.normal(0, 0.005, n)), "high": close * (1 + spread), "low": close * (1 - spread), "close": close, "adj_close": close, "volume": rng.integers(1, 1000, n)}))
    return pd.concat(out, ignore_index=True)


def test_confluence(spark):
    bars = panel()
    got = {(r.symbol, r.dt): r for r in signals.confluence(spark.createDataFrame(bars)).collect()}
    fired = dict.fromkeys(("uptrend", "ema_pullback", "rsi_low", "near_support"), 0)
    for s, g in bars.groupby("symbol"):
        x, low = g["adj_close"].to_numpy(), g["low"].to_numpy()
        ema, a, gain, loss, rsi = [x[0]], 2 / 201, None, None, []
        for i in range(len(x)):
            if i:
                ema.append(a * x[i] + (1 - a) * ema[-1])
                up, down = max(x[i] - x[i - 1], 0), max(x[i - 1] - x[i], 0)
                gain, loss = (up, down) if gain is None else (gain + (up - gain) / 14, loss + (down - loss) / 14)
            rsi.append(100 - 100 / (1 + gain / loss) if i >= 14 and loss else math.nan)
        for i, day in enumerate(g["dt"]):
            e = ema[i] if i >= 199 else math.nan
            sma = x[i - 49 : i + 1].mean() if i >= 49 else math.nan
            support = low[i - 60 : i - 5].min() if i >= 60 else math.nan
            want = {"uptrend": i >= 219 and e > ema[i - 20] and sma > e, "ema_pullback": i >= 199 and low[i] <= 1.01 * e and e <= x[i], "rsi_low": rsi[i] < 30, "near_support": abs(x[i] / support - 1) <= 0.03}
            r = got[s, day].asDict()
            assert {k: r[k] for k in want} == {k: bool(v) for k, v in want.items()}, (s, i)
            for k, v in want.items():
                fired[k] += bool(v)
            names = list(want)
            assert all(r[f"{p}_and_{q}"] == bool(want[p] and want[q]) for n, p in enumerate(names) for q in names[n + 1 :])
    assert min(fired.values()) > 5


def test_effective_number_and_combined_signals(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    x[:, 1] += 2 * x[:, 0]
    eig = np.linalg.eigvalsh(np.corrcoef(x.T))
    got = inference.effective_signals(spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))).repartition(5), list("abc")).first()
    assert got.effective == pytest.approx(eig.sum() ** 2 / (eig**2).sum(), rel=1e-9)

    days, names = 60, [f"S{i}" for i in range(8)]
    df = pd.DataFrame([(d, s, *rng.normal(size=2), rng.normal()) for d in range(days) for s in names], columns=["dt", "symbol", "z1", "z2", "ret"])
    df.loc[rng.random(len(df)) < 0.1, "z2"] = np.nan
    got = {(r.dt, r.symbol): r for r in events.combine_signals(spark.createDataFrame(df).replace(float("nan"), None), ["z1", "z2"], "ret", "dt", "symbol", hold=2, least=10).collect()}
    legs = {z: df.dropna(subset=[z]).groupby("dt").apply(lambda g, z=z: (g[z] * g["ret"]).sum() / g[z].abs().sum(), include_groups=False) for z in ("z1", "z2")}
    for r in df.itertuples():
        z = {"z1": r.z1, "z2": None if math.isnan(r.z2) else r.z2}
        known = {k: v for k, v in z.items() if v is not None}
        weight = {k: 1 / legs[k].iloc[: r.dt - 2].std(ddof=1) for k in z if r.dt - 2 >= 10}
        used = {k: v for k, v in known.items() if k in weight}
        want = sum(v * weight[k] for k, v in used.items()) / sum(weight[k] for k in used) if used else None
        assert got[r.dt, r.symbol].equal == pytest.approx(sum(known.values()) / len(known)) and got[r.dt, r.symbol].inverse_vol == (want if want is None else pytest.approx(want))


def test_leaderboard(spark):
    rows = [(0.1, 500, -0.3, 4.0, 20), (0.05, 900, 0.1, 3.0, 1), (-0.02, 300, 0.0, 3.0, 7)]
    normal = statistics.NormalDist()
    for r in inference.leaderboard(spark.createDataFrame(rows, "sharpe double, n int, skew double, kurt double, trials int")).collect():
        se = math.sqrt((1 - r.skew * r.sharpe + (r.kurt - 1) / 4 * r.sharpe**2) / (r.n - 1))
        g = 0.5772156649015329
        best = se * ((1 - g) * normal.inv_cdf(1 - 1 / r.trials) + g * normal.inv_cdf(1 - 1 / (r.trials * math.e))) if r.trials > 1 else 0.0
        assert r.expected_best == pytest.approx(best, rel=1e-6) and r.psr == pytest.approx(normal.cdf(r.sharpe / se), abs=1e-6) and r.dsr == pytest.approx(normal.cdf((r.sharpe - best) / se), abs=1e-6)


def test_sentences_of_the_documents(spark):
    """Cut by a plain walk over each text: behind a stop and blanks before a capital, but not behind an abbreviation."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, "Acme Inc. Sells No. 7 to Dr. Who. It pays!  Really? yes; No"), (-2, None), (-3, " \n ")], "doc_id long, text string")
    docs = docs.unionByName(extra)
    got = {}
    for r in text.sentences(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n, r.sentence))
    short = {"Inc", "Corp", "Co", "Ltd", "No", "Nos", "Mr", "Mrs", "Ms", "Dr", "St", "U.S", "vs", "approx"}
    for r in docs.collect():
        parts, start, t = [], 0, r.text or ""
        for m in re.finditer(r"(?<=[.;!?])[ \t\n\x0b\f\r]+|\n+", t):
            if "\n" not in m[0] or (m.start() and t[m.start() - 1] in ".;!?"):
                before = t[start : m.start()]
                after = t[m.end() : m.end() + 1]
                told = re.search(r"([\w.]+)\.$", before)
                abbreviation = bool(told and any(told[1] == a or (told[1].endswith(a) and not told[1][-len(a) - 1].isalnum()) for a in short))
                if not ("\n" in m[0] and not (after.isupper())) and (abbreviation or not after.isupper()):
                    continue
                if abbreviation:
                    continue
            parts.append(t[start : m.start()].strip())
            start = m.end()
        parts.append(t[start:].strip())
        want = [p for p in parts if p]
        mine = [re.sub(r"\s+", " ", s) for _, s in sorted(got.get(r.doc_id, []))]
        assert " ".join(mine) == re.sub(r"\s+", " ", " ".join(want)).strip()
    assert [s for _, s in sorted(got[-1])] == ["Acme Inc. Sells No. 7 to Dr. Who.", "It pays!", "Really? yes;", "No"] and -2 not in got and -3 not in got


def test_page_texts_hold_the_words_of_a_plain_reader(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in text.page_texts(pages).join(pages.select("page_id", "html"), "page_id").collect():
        t = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", r.html or "")
        words = html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"(?i)</?(?:p|div|br|tr|li|h[1-6]|table|ul|ol)\b[^>]*>", "\n", t)))
        assert re.split(r"[ \t\n\x0b\f\r]+", r.text.strip()) == re.split(r"[ \t\n\x0b\f\r]+", words.strip(" \t\n\x0b\f\r"))


def test_entities(spark):
    t = ["a &amp;lt; b", "&copy;&#169;&#xA9;", "&nbsp;x&#160;y", "&unknown; & &; &#0; &#xD800; &#99999999;", "it&#8217;s &#x1F600; &eacute;", None, "", "&"]
    got = [r.x for r in spark.createDataFrame(list(enumerate(t)), "i int, t string").orderBy("i").select(scalar.unescape_html(F.col("t")).alias("x")).collect()]
    assert got == ["a &lt; b", "©©©", " x y", "&unknown; & &; &#0; &#xD800; &#99999999;", "it's 😀 é", None, "", "&"]


def test_local_dates_over_daylight_saving(spark):
    utc = [datetime(2024, 3, 10, 4, 59), datetime(2024, 3, 10, 5, 0), datetime(2024, 7, 1, 3, 59), datetime(2024, 7, 1, 4, 0), datetime(2024, 11, 4, 4, 59), datetime(2024, 11, 4, 5, 0)]
    got = spark.createDataFrame([(x,) for x in utc], "t timestamp").select(scalar.session_date(F.col("t")).alias("d")).collect()
    assert [r.d.isoformat() for r in got] == ["2024-03-09", "2024-03-10", "2024-06-30", "2024-07-01", "2024-11-03", "2024-11-04"]


def test_logistic_is_the_penalised_optimum(spark):
    rng = np.random.default_rng(6)
    n = 2000
    x = rng.normal(size=(n, 2)) * [1.0, 5.0] + [0.0, 3.0]
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * x[:, 0] - 0.1 * (x[:, 1] - 3))))).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"fold": 1, "symbol": "S", "dt": range(n), "a": x[:, 0], "b": x[:, 1], "win": y}))
    got = np.array([r.probability for r in modelling.predicted(modelling.fit(df, ["a", "b"], "win"), df, "win").orderBy("dt").collect()])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    beta = np.zeros(3)
    d = np.column_stack((np.ones(n), z))
    ridge = np.diag([0, 10.0, 10.0])  # inverse penalty 0.1 on standardised inputs, none on the intercept
    for _ in range(30):
        p = 1 / (1 + np.exp(-d @ beta))
        beta += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge, d.T @ (y - p) - ridge @ beta)
    assert np.abs(got - 1 / (1 + np.exp(-d @ beta))).max() < 2e-3


def test_session_bars_are_what_the_adapter_says(spark):
    assert adapters.session_bars(spark, SF).where("bar not between 0 and 6 or high < low").count() == 0


def test_reality_check_as_resampled_by_hand(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 3)) + [0.0, 0.02, 0.2]
    df = spark.createDataFrame(pd.DataFrame({"t": range(120), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})).repartition(4)
    reps, block, seed = 60, 8.0, 5
    best = []
    for r in range(reps):
        g = np.random.default_rng([seed, r])
        jump = g.random(120) < 1 / block
        jump[0] = True
        start = g.integers(0, 120, 120)
        at, now = [], 0
        for i in range(120):
            now = start[i] if jump[i] else (now + 1) % 120
            at.append(now)
        best.append((x[at].mean(0) - x.mean(0)).max())
    got = inference.reality_check(df, ["a", "b", "c"], "t", reps, block, seed).first().asDict()
    assert got["p"] == pytest.approx(np.mean(np.array(best) >= x.mean(0).max()), abs=1e-12) or got["p"] == pytest.approx((1 + np.sum(np.array(best) >= x.mean(0).max())) / (reps + 1), abs=1e-12)
    with pytest.raises(ValueError, match="date-level"):
        inference.PERIODS, keep = 100, inference.PERIODS
        try:
            inference.stationary_bootstrap(df, ["a"], "t")
        finally:
            inference.PERIODS = keep


def test_sentence_classes(spark):
    s = spark.createDataFrame([(1, 0, "We pay cash."), (1, 1, "This is final."), (1, 2, "Shares stay."), (1, 3, "These too."), (2, 0, "It is odd."), (2, 1, "Cash or shares.")], "doc_id int, n int, sentence string")
    got = {(r.doc_id, r.n): r.kind for r in text.classified(s, "doc_id", {"cash": "(?i)cash", "share": "(?i)share"}).collect()}
    assert got == {(1, 0): "cash", (1, 1): "cash", (1, 2): "share", (1, 3): "share", (2, 0): None, (2, 1): "cash"}
