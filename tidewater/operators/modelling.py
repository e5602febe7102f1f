"""Walk-forward folds, models on the panel, evaluation and permutation importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .ordered import counted, numbered, running


def walk_forward(calendar: DataFrame, train_years: int = 4, purge: int = 21, least: int = 200) -> DataFrame:
    """fold, train_start, train_end, test_start, test_end: train_years of training, one year of test, a step of a year; the training
    ends `purge` sessions and one before the test. A year is used if it and its training years have `least` dates each at the start. Calendars are small."""
    years = calendar.groupBy("year").agg(F.min("dt").alias("first"), F.max("dt").alias("last"), F.min("day_index").alias("at"), F.count(F.lit(1)).alias("n"))
    first_year = years.where(F.col("n") > least).agg(F.min("year").alias("y0"))
    test = years.crossJoin(F.broadcast(first_year)).where(F.col("year") >= F.col("y0") + train_years)
    start = years.select((F.col("year") + train_years).alias("year"), F.col("first").alias("train_start"))
    ends = calendar.select((F.col("day_index") + purge + 1).alias("at"), F.col("dt").alias("train_end"))
    folds = test.join(start, "year").join(ends, "at")
    return folds.select(F.row_number().over(Window.orderBy("year")).alias("fold"), "train_start", "train_end", F.col("first").alias("test_start"), F.col("last").alias("test_end"))


def split(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Panel rows with each fold and role (train or test) they have in it."""
    role = F.when(F.col("dt").between(F.col("train_start"), F.col("train_end")), "train").when(F.col("dt").between(F.col("test_start"), F.col("test_end")), "test")
    return panel.join(F.broadcast(folds), F.col("dt").between(F.col("train_start"), F.col("test_end"))).withColumn("role", role).where("role is not null")


def leaking_folds(folds: DataFrame, calendar: DataFrame, horizon: int) -> DataFrame:
    """Folds whose last training label resolves on or after the test's first day."""
    days = calendar.select("dt", "day_index")
    a = folds.join(days.select(F.col("dt").alias("train_end"), F.col("day_index").alias("i")), "train_end").join(days.select(F.col("dt").alias("test_start"), F.col("day_index").alias("j")), "test_start")
    return a.where(F.col("i") + horizon >= F.col("j")).select("fold", "train_end", "test_start")


def baselines(df: DataFrame, momentum: str) -> DataFrame:
    return df.withColumn("always_long", F.lit(0.51)).withColumn("momentum_rule", F.when(F.col(momentum) > 0, 0.60).otherwise(0.40))


#: Boosted trees: rounds at most, step, depth, rows of a leaf; early stopping on a share of the training rows.
TREES = {"maxIter": 300, "stepSize": 0.05, "maxDepth": 4, "minInstancesPerNode": 200}
VALIDATION = 0.15


def fit(train: DataFrame, features: list[str], label: str, kind: str = "logistic", seed: int = 1, trees: dict | None = None):
    """The fitted pipeline: medians for missing values, then a logistic model (inverse penalty 0.1 over the rows, standardised inputs) or boosted
    trees, which stop when a validation share of the rows, taken by a hash of symbol and day, no longer gains. Every stage reads `train` again, so it should
    be written; for a logistic model no other copy of it is kept, as MLlib keeps one."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    train = train.where(F.col(label).isNotNull()).select("symbol", "dt", *features, F.col(label).cast("double").alias(label))
    if kind != "logistic":
        train.persist()
    filled = [f"{c}_filled" for c in features]
    prepare = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw")]
    if kind == "logistic":
        model = [StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol=label, regParam=1 / (0.1 * max(1, train.count())), maxIter=50)]
    else:
        marked = train.withColumn("_validates", F.pmod(F.xxhash64("symbol", "dt", F.lit(seed)), F.lit(1000)) < VALIDATION * 1000)
        model = [VectorAssembler(inputCols=["raw"], outputCol="features"), GBTClassifier(labelCol=label, seed=seed, validationIndicatorCol="_validates", **(TREES | (trees or {})))]
    fitted = Pipeline(stages=prepare + model).fit(train if kind == "logistic" else marked)
    train.unpersist()
    return fitted


def predicted(fitted, test: DataFrame, label: str, more: list[str] | None = None) -> DataFrame:
    """fold, symbol, dt (and `more`), label, probability."""
    from pyspark.ml.functions import vector_to_array

    rows = test.withColumn("_validates", F.lit(False))
    return fitted.transform(rows).select("fold", "symbol", "dt", *(more or ()), F.col(label).cast("double").alias("label"), vector_to_array("probability")[1].alias("probability"))


def fit_predict(
    panel: DataFrame, folds: DataFrame, features: list[str], label: str, kind: str = "logistic", seed: int = 1, trees: dict | None = None, more: list[str] | None = None
) -> DataFrame:
    """Per fold: fit on train rows, score test rows; fold, symbol, dt (and `more`), label, probability. Folds are few; each fit is distributed, and
    reads its days off `panel`, which should be written: a row lies in several folds, but no table holds it once for each of them."""
    out = None
    # folds that any row lies in
    for f in sorted(split(panel.select("dt").distinct(), folds).select(*folds.columns).distinct().collect(), key=lambda r: r["fold"]):
        days = {role: F.col("dt").between(F.lit(f[f"{role}_start"]), F.lit(f[f"{role}_end"])) for role in ("train", "test")}
        test = panel.where(days["test"] & ~days["train"]).withColumn("fold", F.lit(f["fold"]))
        scored = predicted(fit(panel.where(days["train"]), features, label, kind, seed + f["fold"], trees), test, label, more)
        out = scored if out is None else out.unionByName(scored)
    return out


def auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """Area under the curve: wins of positive over negative rows, ties half, from running counts over the distinct scores in pieces: no task has all
    of a group, however many scores differ."""
    known = scored.where("label is not null and probability is not null")
    # a row a distinct score, read several times below: the rows behind it are scored once
    per = written(known.groupBy(*by, "probability").agg(F.sum("label").alias("_p"), F.sum(1 - F.col("label")).alias("_q")), "scores")
    ranked = running(per, by, "probability", ["_q"])
    g = ranked.withColumn("_u", F.col("_p") * (F.col("_q_before") + F.col("_q") / 2)).groupBy(*by).agg(F.sum("_u").alias("_u"), F.sum("_p").alias("_p"), F.sum("_q").alias("_q"))
    return g.select(*by, F.when((F.col("_p") > 0) & (F.col("_q") > 0), F.col("_u") / (F.col("_p") * F.col("_q"))).alias("auc"))


def evaluate(scored: DataFrame, outcome: str, by: list[str], horizon: int = 5) -> DataFrame:
    """What a model is worth, by `by`. Of all rows: n, auc, brier, accuracy and its lift over the majority, base_rate. Of the tenth with the
    highest probability (ties by symbol and day): mean over rows (top_naive), and, since rows of a date are one bet, over dates: dates,
    top_mean, edge_bps over all rows, share of dates up, median and most picks a date, share of the ten busiest dates, n_effective
    (dates over the horizon), and Sharpe and t of every `horizon`-th date; beside them the Sharpe of the rows taken as independent."""
    # counts, ranks and the tenth each read the rows again: they are written once
    known = written(scored.where("label is not null and probability is not null").select(*dict.fromkeys((*by, "symbol", "dt", "label", "probability", outcome))), "scored")
    part = Window.partitionBy(*by)
    right = F.avg(((F.col("probability") >= 0.5).cast("double") == F.col("label")).cast("double"))
    base = F.avg("label")
    whole = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), base.alias("base_rate"), right.alias("accuracy"), (right - F.greatest(base, 1 - base)).alias("lift"),
        F.avg(F.pow(F.col("probability") - F.col("label"), F.lit(2))).alias("brier"), F.avg(outcome).alias("_all"), F.count_distinct("dt").alias("dates_available"),
    ).join(auc(known, by), by)
    # the score at the tenth's edge comes from counts of distinct scores; only rows at that score are ranked
    per = counted(known, by, "probability")
    sizes = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_all_n"))
    per = per.join(sizes, by).withColumn("_above", F.col("_all_n") - F.col("n_before") - F.col("n")).withColumn("_size", F.greatest(F.lit(1), F.floor(0.1 * F.col("_all_n"))))
    edge = per.where(F.col("_above") < F.col("_size")).select(*by, "probability", F.least(F.col("n"), F.col("_size") - F.col("_above")).alias("_take"), F.col("n").alias("count"))
    rows = known.join(edge, [*by, "probability"])
    tied = F.row_number().over(Window.partitionBy(*by, "probability").orderBy("symbol", "dt"))
    whole_scores, cut = rows.where(F.col("_take") == F.col("count")), rows.where(F.col("_take") < F.col("count")).withColumn("_i", tied).where(F.col("_i") <= F.col("_take")).drop("_i")
    top = whole_scores.unionByName(cut)
    naive = top.groupBy(*by).agg(F.avg(outcome).alias("top_naive"), F.avg("label").alias("precision"), F.stddev_samp(outcome).alias("_sd"), F.count(F.lit(1)).alias("top_n"))
    dates = top.groupBy(*by, "dt").agg(F.avg(outcome).alias("_m"), F.count(F.lit(1)).alias("_n"))
    dates = dates.withColumn("_i", F.row_number().over(part.orderBy("dt"))).withColumn("_busy", F.row_number().over(part.orderBy(F.desc("_n"), "dt")))
    every = F.when((F.col("_i") - 1) % horizon == 0, F.col("_m"))
    d = dates.groupBy(*by).agg(
        F.count(F.lit(1)).alias("dates"), F.avg("_m").alias("top_mean"), F.avg((F.col("_m") > 0).cast("double")).alias("dates_up"), F.median("_n").alias("median_picks"), F.max("_n").alias("most_picks"),
        (F.sum(F.when(F.col("_busy") <= 10, F.col("_n"))) / F.sum("_n")).alias("concentration"), (F.count(F.lit(1)) / horizon).alias("n_effective"),
        F.avg(every).alias("_em"), F.stddev_samp(every).alias("_es"), F.count(every).alias("_en"),
    )
    out = whole.join(naive, by).join(d, by).withColumn("edge_bps", (F.col("top_mean") - F.col("_all")) * 10_000).withColumn("dates_traded", F.col("dates") / F.col("dates_available"))
    sound = (F.col("_en") > 2) & (F.col("_es") > 0)
    out = out.withColumn("sharpe", F.when(sound, F.col("_em") / F.col("_es") * (252.0 / horizon) ** 0.5)).withColumn("t", F.when(sound, F.col("_em") / F.col("_es") * F.sqrt("_en")))
    return out.withColumn("sharpe_naive", F.when(F.col("_sd") > 0, F.col("top_naive") / F.col("_sd") * (252.0 / horizon) ** 0.5)).drop("_all", "_sd", "_em", "_es", "_en")


def pooled(evaluated: DataFrame, by: list[str]) -> DataFrame:
    """Means over folds of an `evaluate` by (by, fold), with the spread of auc and top mean, and in how many folds the top tenth gained."""
    mean = ("accuracy", "lift", "top_naive", "edge_bps", "sharpe", "sharpe_naive", "t", "dates_up", "concentration")
    return evaluated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("folds"), F.avg("auc").alias("auc"), F.stddev_samp("auc").alias("auc_sd"), F.avg("top_mean").alias("top_mean"), F.stddev_samp("top_mean").alias("top_mean_sd"),
        *(F.avg(c).alias(c) for c in mean), F.sum("n_effective").alias("n_effective"), F.sum("top_n").alias("top_n"), F.count_if(F.col("top_mean") > 0).alias("folds_up"),
    )


def permutation_importance(train: DataFrame, test: DataFrame, features: list[str], label: str, kind: str = "trees", repeats: int = 3, seed: int = 1, trees: dict | None = None) -> DataFrame:
    """feature, auc_drop, auc_drop_sd: what the model's area under the curve loses on `test` when one feature is shuffled, over `repeats`."""
    fitted = fit(train, features, label, kind, seed, trees)
    names = list(dict.fromkeys(("fold", "symbol", "dt", label, *features)))
    # all tries are one frame: rows are put into their own order once, and each feature's values into those of its repeats
    own = written(numbered(test.select(*names), ["fold"], ["symbol", "dt"], 0, "_r"), "importance-rows")
    each = F.array(*(F.struct(F.lit(c).alias("feature"), F.lit(k).alias("repeat"), F.lit(seed + 1 + i * repeats + k).alias("_seed"), F.col(c).cast("double").alias("_value")) for i, c in enumerate(features, 1) for k in range(repeats)))
    values = own.select("fold", "symbol", "dt", F.explode(each).alias("_t")).select("fold", "symbol", "dt", "_t.*")
    mixed = numbered(values, ["feature", "repeat", "fold"], ["symbol", "dt"], F.col("_seed"), "_r").select("feature", "repeat", "fold", "_r", "_value")
    tried = own.join(mixed, ["fold", "_r"]).select("feature", "repeat", *(c for c in names if c not in features), *(F.when(F.col("feature") == c, F.col("_value")).otherwise(F.col(c)).alias(c) for c in features))
    plain = own.select(F.lit(None).cast("string").alias("feature"), F.lit(0).alias("repeat"), *(F.col(c).cast("double").alias(c) if c in features else F.col(c) for c in names))
    scored = predicted(fitted, plain.unionByName(tried), label, ["feature", "repeat"])
    found = auc(scored, ["feature", "repeat"])
    base = found.where("feature is null").select(F.col("auc").alias("_base"))
    drops = found.where("feature is not null").crossJoin(F.broadcast(base))
    return drops.groupBy("feature").agg(F.avg(F.col("_base") - F.col("auc")).alias("auc_drop"), F.stddev_pop(F.col("_base") - F.col("auc")).alias("auc_drop_sd"))


def permuted(df: DataFrame, column: str, by: list[str], ident: list[str], seed: int) -> DataFrame:
    """`column` shuffled inside groups (a date, say), by pairing two hashed orders; `ident` tells the rows of a group apart."""
    a = numbered(df, by, ident, 0, "_r").drop(column)
    b = numbered(df, by, ident, seed, "_r").select(*by, "_r", column)
    return a.join(b, [*by, "_r"]).drop("_r").select(*df.columns)


def fundamental_ratios(df: DataFrame, price: Column) -> DataFrame:
    """Oriented ratios of (income, equity, assets, assets_lag, cash_flow, gross_profit, shares columns in order of trust)."""
    cap = price * F.coalesce("shares_cover", "shares_balance", "shares_weighted")
    ratio = lambda a, b: F.when(b > 0, a / b)
    return df.select("*", ratio(F.col("income"), cap).alias("ep"), ratio(F.col("equity"), cap).alias("bp"), ratio(F.col("income"), F.col("equity")).alias("roe"), (-ratio(F.col("income") - F.col("cash_flow"), F.col("assets"))).alias("accruals"), (-(ratio(F.col("assets"), F.col("assets_lag")) - 1)).alias("asset_growth"), ratio(F.col("gross_profit"), F.col("assets")).alias("profitability"))
