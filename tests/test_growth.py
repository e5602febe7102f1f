"""Steps whose work must grow with the rows: what their plans must not hold, and their results beside plain ones."""

import random
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import features, modelling, outcomes, pit, signals, timelines, windows
from tidewater.operators.rolling import met, rolled
from tidewater.sources.adapters import daily_bars


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_split_entries_make_no_row_for_each_session(spark):
    days = [date(2010, 1, 4) + timedelta(i) for i in range(4000) if (date(2010, 1, 4) + timedelta(i)).weekday() < 5]
    calendar = spark.createDataFrame(list(enumerate(days)), "day_index int, dt date")
    known = spark.createDataFrame([(1, days[3], "CASH", 5, days[2000], days[3], False), (1, days[1990], "ROUNDUP_HOLDER", 5, days[2005], days[3], False), (2, days[3], "CASH", 5, days[9], days[3], True)], "event int, usable date, treatment string, ratio int, effective date, announced date, cancelled boolean")
    events = spark.createDataFrame([(1, days[2500]), (2, days[2500])], "event int, split_on date")
    got = timelines.split_entries(events, known, calendar)
    assert "explode(sequence(_a" not in optimized(got)
    # from 2017-09-05 on two days to settle, so the last trade that settles before days[2005] is three sessions ahead of it
    assert [(r.event, r.entry_on, r.treatment) for r in got.collect()] == [(1, days[2002], "ROUNDUP_HOLDER")]


def test_rolled_is_what_moving_frames_say(spark):
    """To the last bit, nulls, NaN, short histories and rows without movement included."""
    rng = random.Random(4)
    value = lambda: rng.choice([None, 1.5, 1.5, rng.random(), float("nan") if rng.random() < 0.1 else 3.0])
    rows = [(s, date(2020, 1, 1) + timedelta(i), *((2.5, 7.5) if s == "flat" else (value(), value()))) for s in ("a", "b", "flat", None) for i in range(70)] + [("one", date(2020, 1, 1), 1.0, 2.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "symbol string, dt date, x double, y double")
    got = rolled(df, {"a": ("avg", 20, 1, 0, "x"), "h": ("max", 25, 1, 1, "x"), "l": ("min", 7, 3, 0, "x"), "s": ("sd", 20, 5, 0, "x"), "b": ("beta", 30, 4, 1, "y", "x")})
    w = lambda n, last: Window.partitionBy("symbol").orderBy("dt").rowsBetween(1 - n - last, -last)
    x, y = F.col("x"), F.col("y")
    both = x.isNotNull() & y.isNotNull()
    u, v = F.when(both, x), F.when(both, y)
    spread = F.var_samp(u).over(w(30, 1))
    want = df.select(
        "*", F.avg(x).over(w(20, 0)).alias("a"), F.max(x).over(w(25, 1)).alias("h"), F.when(F.count(x).over(w(7, 0)) >= 3, F.min(x).over(w(7, 0))).alias("l"),
        F.when(F.count(x).over(w(20, 0)) >= 5, F.stddev_samp(x).over(w(20, 0))).alias("s"), F.when((F.count(u).over(w(30, 1)) >= 4) & (spread > 0), F.covar_samp(v, u).over(w(30, 1)) / spread).alias("b"),
    )
    clean = lambda d: sorted(map(str, (tuple(r) for r in d.where("not exists(array(a, h, l), z -> isnan(z))").select("symbol", "dt", "a", "h", "l").collect())))
    assert clean(got) == clean(want)
    assert {(r.symbol, r.dt, str(r.h), str(r.l)) for r in got.collect()} == {(r.symbol, r.dt, str(r.h), str(r.l)) for r in want.collect()}
    finite = lambda d: sorted(map(str, (tuple(r) for r in d.where("s is null or not isnan(s)").where("b is null or not isnan(b)").where("dt < date '2020-01-01' or symbol in ('flat', 'one')").select("symbol", "dt", "s", "b").collect())))
    assert finite(got) == finite(want)


def test_moving_columns_need_no_frame_for_each_row(spark):
    bars = daily_bars(spark, "/root/testdata/sf0.001")
    assert "-251" not in optimized(features.price_features(bars))
    df = bars.select("symbol", "dt", F.col("open").alias("ret"), F.col("close").alias("mkt"))
    assert "-252" not in optimized(windows.rolling_beta(df, "ret", "mkt"))


def test_signals_need_no_frame_for_each_row(spark):
    bars = daily_bars(spark, "/root/testdata/sf0.001")
    for df in (signals.compute(bars, ["new_52w_high", "above_sma_200"]), signals.confluence(bars)):
        assert not any(f"specifiedwindowframe(RowFrame, -{n}" in optimized(df) for n in (19, 49, 60, 199, 252))


def test_tender_trades_make_no_row_for_each_session(spark):
    days = [date(2010, 1, 4) + timedelta(i) for i in range(60)]
    calendar = spark.createDataFrame(list(enumerate(days)), "day_index int, dt date")
    deals = spark.createDataFrame([(1, "a", days[30], days[40], "completed", 9.0, days[40], None, None)], "deal int, symbol string, filed date, expires date, outcome string, final_price double, final_expires date, terminated_on date, paid_on date")
    moves = spark.createDataFrame([], "deal int, known date, expires date")
    bars = spark.createDataFrame([("a", d, float(i), 2, 1.0) for i, d in enumerate(days) if i % 3], "symbol string, dt date, close double, volume int, factor double")
    got = timelines.tender_trades(deals, moves, calendar, bars)
    assert "explode(sequence(" not in optimized(got)
    # the first session behind days[30] is 31; sessions 10 to 30 with a bar hold 14 closes, 10, 11, 13 .. 29, the two in the middle 19 and 20
    assert {(r.entry_on, r.dollar_volume) for r in got.where("variant = 'E1'").collect()} == {(days[31], 2 * 19.5)}


def test_what_rows_find_does_not_depend_on_batches(spark):
    """A symbol's facts and asks lie in several batches, and a batch holds several symbols."""
    facts = spark.createDataFrame([(s, 10 * i, float(i)) for s in ("a", "b", "d") for i in range(30)], "symbol string, at int, x double")
    asks = spark.createDataFrame([(s, t) for s in ("a", "b", "c", "d", None) for t in range(-5, 305, 3)], "symbol string, t int")

    def take(m):
        x, at = np.append(m.fact("x"), np.nan), m.find("at", m.ask("t", 0))
        return pa.RecordBatch.from_arrays([m.asks.column("symbol"), m.asks.column("t"), pa.array(x[np.where(at < m.high, at, -1)], from_pandas=True)], names=["symbol", "t", "x"])

    for size in (7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        try:
            got = {(r.symbol, r.t): r.x for r in met(asks, facts, take, "symbol string, t int, x double", order="at").collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == {(s, t): float(max(-(-t // 10), 0)) if s in ("a", "b", "d") and t <= 290 else None for s in ("a", "b", "c", "d", None) for t in range(-5, 305, 3)}


def test_moving_columns_are_the_same_in_any_batches(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(s, date(2020, 1, 1) + timedelta(i), rng.choice([None, rng.random()])) for s in ("a", "b", None) for i in range(70)], "symbol string, dt date, x double")
    wants = {"a": ("avg", 20, 2, 1, "x"), "h": ("max", 25, 1, 0, "x"), "s": ("sd", 9, 3, 0, "x")}
    assert "FlatMapGroups" not in optimized(rolled(df, wants))  # a hand-over for each symbol costs more than its means
    whole = {(r.symbol, r.dt): tuple(r) for r in rolled(df, wants).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        assert {(r.symbol, r.dt): tuple(r) for r in rolled(df, wants).collect()} == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_feature_layer_hands_over_no_symbol_by_itself(spark):
    bars = daily_bars(spark, "/root/testdata/sf0.001")
    got = pit.truncation_audit(features.price_features, bars, F.lit("1996-06-28").cast("date"), "dt", ["symbol", "dt"], ["sma_200", "atr_14", "dist_high_252"])
    assert "FlatMapGroups" not in optimized(got) and got.count() == 0


def test_permutation_importance_scores_all_tries_at_once(spark, monkeypatch):
    """The tries are those of each feature put into a repeat's order by itself, and are scored in one frame."""
    class Model:
        calls = 0

        def transform(self, df):
            Model.calls += 1
            return df.withColumn("probability", F.udf(lambda x, y: Vectors.dense([1 - (x + y / 7) / 3, (x + y / 7) / 3]), VectorUDT())("x", "y"))

    model = Model()
    monkeypatch.setattr(modelling, "fit", lambda *_: model)
    rng = random.Random(8)
    rows = spark.createDataFrame([(7, f"S{i % 9}", date(2020, 1, 1) + timedelta(i), x := rng.random(), y := rng.random(), int(x + y / 7 + rng.random() / 2 > 0.8)) for i in range(200)], "fold int, symbol string, dt date, x double, y double, label int")
    got = {r.feature: r.auc_drop for r in modelling.permutation_importance(rows, rows, ["x", "y"], "label", repeats=2, seed=3).collect()}
    assert model.calls == 1

    def area(df):
        return modelling.auc(modelling.predicted(model, df, "label"), ["fold"]).first()["auc"]

    base = area(rows)
    for i, c in enumerate(("x", "y"), 1):
        drops = [base - area(modelling.permuted(rows, c, ["fold"], ["symbol", "dt"], 4 + 2 * i + k)) for k in range(2)]
        assert abs(got[c] - sum(drops) / 2) < 1e-12


def _walk(rng, symbols, n):
    rows = []
    for s in symbols:
        c = 100.0
        for i in range(n):
            o, c = c * (1 + rng.gauss(0, 0.01)), c * (1 + rng.gauss(0, 0.02))
            rows.append((s, date(2020, 1, 1) + timedelta(i), o, max(o, c) * (1 + rng.random() / 50), min(o, c) * (1 - rng.random() / 50), c, c / 2 if i < n / 2 else c))
    return rows


def test_first_touch_of_signals_is_that_of_all_rows(spark):
    rng = random.Random(11)
    bars = spark.createDataFrame(_walk(rng, ("a", "b", "c"), 120), "symbol string, dt date, open double, high double, low double, close double, adj_close double")
    signals_ = bars.where("pmod(xxhash64(symbol, dt), 3) = 0").select("symbol", "dt").unionByName(spark.createDataFrame([("a", date(2031, 1, 1)), ("z", date(2020, 2, 1))], "symbol string, dt date"))
    got = outcomes.first_touch(bars, horizon=20, signals=signals_)
    assert "explode(sequence(" not in optimized(got)
    rounded = lambda df: sorted((r.symbol, r.dt, r.entry, r.outcome, r.days, round(r.gross, 12)) for r in df.collect())
    want = rounded(outcomes.first_touch(bars, horizon=20).join(signals_, ["symbol", "dt"], "left_semi"))
    assert rounded(got) == want and {w[3] for w in want} == {"stop", "target", "timeout", "open"}


def test_calendar_time_makes_no_row_for_each_session(spark):
    rng = random.Random(12)
    rows = [r for r in _walk(rng, ("a", "b", "c"), 90) if rng.random() < 0.8]
    rows = [(*r[:2], None if rng.random() < 0.1 else r[2], *r[3:]) for r in rows]
    bars = spark.createDataFrame(rows, "symbol string, dt date, open double, high double, low double, close double, adj_close double")
    days = sorted({r[1] for r in rows})
    calendar = spark.createDataFrame(list(enumerate(days)), "day_index int, dt date")
    events = [(s, days[i]) for s in ("a", "b", "z") for i in range(0, len(days), 7)]
    got = outcomes.calendar_time(spark.createDataFrame(events, "symbol string, day0 date"), bars, calendar, 2, 13, 0.01)
    assert "explode(sequence(" not in optimized(got)
    held = {}
    for s, day0 in events:
        d0 = days.index(day0)
        mine = [(i, r) for i, r in enumerate(r for r in rows if r[0] == s)]
        covered = [(i, r) for i, r in mine if d0 + 2 <= days.index(r[1]) <= d0 + 13]
        for k, (i, r) in enumerate(covered):
            before = mine[i - 1][1][6] if i else None
            ret = (None if r[2] is None else r[5] / r[2] - 1) if k == 0 else (r[6] / before - 1 if before else 0.0)
            held.setdefault(r[1], []).append(None if ret is None else ret - 0.01 * ((k == 0) + (k == len(covered) - 1)))
    known = {d: [x for x in xs if x is not None] for d, xs in held.items()}
    want = {d: (round(sum(known[d]) / len(known[d]), 12) if known[d] else None, len(xs)) for d, xs in held.items()}
    assert {r.dt: (None if r.ret is None else round(r.ret, 12), r.positions) for r in got.collect()} == want


def test_folds_are_read_off_one_panel(spark, monkeypatch):
    """The logistic query writes its panel once, narrow, and no table with a row for each fold; bars are shuffled once for features and labels."""
    from tidewater.plans import catalog_more

    class Enough(Exception):
        pass

    tables, plain = {}, catalog_more.written

    def kept(df, name):
        tables[name] = df
        return plain(df, name)

    def fitted(*args, **kw):
        raise Enough

    monkeypatch.setattr(catalog_more, "written", kept)
    monkeypatch.setattr(modelling, "fit_predict", fitted)
    try:
        catalog_more.m_logistic_walk_forward(spark, "/root/testdata/sf0.001")
    except Enough:
        pass
    assert list(tables) == ["usable"] and tables["usable"].columns == ["symbol", "dt", "mom_21", "vol_20", "atr_pct", "dist_sma_20", "win_5", "fwd_5"]
    plan = tables["usable"]._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan


def test_labels_kept_beside_features_are_those_of_a_join(spark):
    bars = daily_bars(spark, "/root/testdata/sf0.001")
    labels = ["fwd_5", "win_5"]
    want = features.price_features(bars).join(features.forward_labels(bars).select("symbol", "dt", *labels), ["symbol", "dt"])
    got = features.price_features(features.forward_labels(bars, keep=[c for c in bars.columns if c not in ("symbol", "dt")]), labels)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 100


def test_fits_by_fold_are_those_of_split_rows(spark):
    rng = random.Random(5)
    days = [date(2020, 1, 1) + timedelta(i) for i in range(60)]
    rows = [(f"S{k}", d, x := rng.gauss(0, 1), rng.gauss(0, 1), int(x + rng.gauss(0, 1) > 0) if rng.random() > 0.05 else None) for k in range(8) for d in days]
    panel = spark.createDataFrame(rows, "symbol string, dt date, x double, fwd double, win int")
    # the last fold has no rows
    folds = spark.createDataFrame([(1, days[0], days[29], days[33], days[44]), (2, days[10], days[44], days[45], days[59]), (3, date(2030, 1, 1), date(2030, 2, 1), date(2030, 3, 1), date(2030, 4, 1))], "fold int, train_start date, train_end date, test_start date, test_end date")
    got = {(r.fold, r.symbol, r.dt): r for r in modelling.fit_predict(panel, folds, ["x"], "win", more=["fwd"]).collect()}
    mine = modelling.split(panel, folds)
    want = {}
    for fold in (1, 2):
        model = modelling.fit(mine.where(f"fold = {fold} and role = 'train'"), ["x"], "win")
        want |= {(r.fold, r.symbol, r.dt): r for r in modelling.predicted(model, mine.where(f"fold = {fold} and role = 'test'"), "win", ["fwd"]).collect()}
    assert got.keys() == want.keys() and len(got) == 8 * 27
    assert all(got[k].label == r.label and got[k].fwd == r.fwd and abs(got[k].probability - r.probability) < 1e-9 for k, r in want.items())
