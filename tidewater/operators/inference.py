"""Clustering-aware inference: means, alphas, information coefficients, multiple testing, bootstraps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from ..functions.scalar import normal_cdf, normal_quantile
from ..sources.shared import written
from .ordered import largest, quantiles


def clustered_mean(df: DataFrame, value: str, cluster: list[str], by: list[str]) -> DataFrame:
    """Mean over rows with the error of its cluster sums: n, clusters, mean, se, t, p (two-sided)."""
    per = df.where(F.col(value).isNotNull()).groupBy(*by, *cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    total = per.groupBy(*by).agg(F.sum("_s").alias("_ts"), F.sum("_c").alias("n"), F.count(F.lit(1)).alias("clusters"), F.sum(F.col("_s") * F.col("_s")).alias("_ss"), F.sum(F.col("_s") * F.col("_c")).alias("_sc"), F.sum(F.col("_c") * F.col("_c")).alias("_cc"))
    mean = F.col("_ts") / F.col("n")
    spread = F.col("_ss") - 2 * mean * F.col("_sc") + mean * mean * F.col("_cc")
    se = F.when(F.col("clusters") > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) * F.col("clusters") / (F.col("clusters") - 1)) / F.col("n"))
    out = total.select(*by, "n", "clusters", mean.alias("mean"), se.alias("se"))
    out = out.withColumn("t", F.when(F.col("se") > 0, F.col("mean") / F.col("se")))
    return out.withColumn("p", 2 * (1 - normal_cdf(F.abs("t"))))


def time_block(at: str, start: Column, hold: int) -> Column:
    """Number of the block of ceil(2 hold 7/5) calendar days a date lies in."""
    return F.floor(F.datediff(at, start) / math.ceil(hold * 2 * 7 / 5))


def concentration(df: DataFrame, value: str, cluster: str, by: list[str]) -> DataFrame:
    """trimmed mean (0.5 to 99.5 %) and the share of the five largest cluster sums."""
    cuts = quantiles(df, by, value, [0.005, 0.995], "_q")
    trimmed = df.join(cuts, by).where(F.col(value).between(F.col("_q")[0], F.col("_q")[1])).groupBy(*by).agg(F.avg(value).alias("trimmed_mean"))
    sums = df.groupBy(*by, cluster).agg(F.abs(F.sum(value)).alias("_a"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_a"), cluster))
    share = sums.withColumn("_n", rank).groupBy(*by).agg((F.sum(F.when(F.col("_n") <= 5, F.col("_a"))) / F.sum("_a")).alias("top5_share"))
    return trimmed.join(share, by)


def newey_west(series: DataFrame, value: str, order: str, by: list[str], lags: int | None = None) -> DataFrame:
    """n, mean, se, t of a serially correlated series (Bartlett weights); lags default to floor(4 (n / 100) ^ (2/9)), at any length.

    The values before a row come as one array from one window, as long as the group's own number of lags asks for; the window is as wide as the
    longest group needs (counted first: 33 for a million rows, 55 for ten million)."""
    w = Window.partitionBy(*by)
    rule = F.floor(4 * F.pow(F.col("_n") / 100, F.lit(2 / 9))).cast("int")
    if lags is None:
        longest = series.groupBy(*by).agg(F.count(value).alias("_n")).agg(F.max(rule)).first()[0] or 0
    else:
        longest = lags
    e = series.withColumn("_n", F.count(value).over(w)).withColumn("_e", F.col(value) - F.avg(value).over(w)).withColumn("_l", F.lit(lags) if lags is not None else rule)
    term = F.col("_e") * F.col("_e")
    if longest:
        # an array leaves nulls out, so a missing value is kept in its place as one of no weight
        before = F.collect_list(F.coalesce("_e", F.lit(0.0))).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-longest, -1))
        e = e.withColumn("_before", F.reverse(before))
        weighted = F.transform("_before", lambda x, i: F.when(i < F.col("_l"), x * 2 * (1 - (i + 1) / (F.col("_l") + 1))).otherwise(0.0))
        term = term + F.col("_e") * F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)
    g = e.withColumn("_term", term).groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.sum("_term").alias("_v"))
    return g.withColumn("se", F.sqrt(F.greatest(F.col("_v"), F.lit(0.0))) / F.col("n")).withColumn("t", F.when(F.col("se") > 0, F.col("mean") / F.col("se"))).drop("_v")


def factor_alpha(series: DataFrame, y: str, factors: list[str], order: str, lags: int = 5, per_year: int = 252) -> dict[str, float]:
    """OLS alpha with HAC error. Spark sums the k x k moment matrices, residual products included; the solve is k x k."""
    x = [F.lit(1.0), *map(F.col, factors)]
    k = len(x)
    rows = series.where(" and ".join(f"`{c}` is not null" for c in [y, *factors]))
    m = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.sum(y).alias("sy"), *(F.sum(a * b).alias(f"xx{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x)), *(F.sum(a * F.col(y)).alias(f"xy{i}") for i, a in enumerate(x))).first()
    xx, xy = np.array([[m[f"xx{i}_{j}"] for j in range(k)] for i in range(k)]), np.array([m[f"xy{i}"] for i in range(k)])
    beta = np.linalg.solve(xx, xy)
    e = F.col(y) - sum((b * c for b, c in zip(map(float, beta), x, strict=True)), F.lit(0.0))
    w = Window.orderBy(order)  # a date-level series
    u = rows.select(order, *((e * c).alias(f"u{i}") for i, c in enumerate(x)), e.alias("_e"))
    lagged = [(lag, i, j, F.lag(f"u{j}", lag).over(w) if lag else F.col(f"u{j}")) for lag in range(lags + 1) for i in range(k) for j in range(k)]
    prods = u.select("_e", *((F.col(f"u{i}") * v).alias(f"s{lag}_{i}_{j}") for lag, i, j, v in lagged))
    s = prods.agg(F.sum(F.col("_e") * F.col("_e")).alias("ee"), *(F.sum(f"s{lag}_{i}_{j}").alias(f"s{lag}_{i}_{j}") for lag, i, j, _ in lagged)).first()
    meat = np.zeros((k, k))
    for lag in range(lags + 1):
        g = np.array([[s[f"s{lag}_{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])
        meat += g if lag == 0 else (1 - lag / (lags + 1)) * (g + g.T)
    bread = np.linalg.inv(xx)
    cov = bread @ meat @ bread
    n, total = m["n"], m["yy"] - m["sy"] ** 2 / m["n"]
    resid = math.sqrt(s["ee"] / (n - k))
    return {"n": n, "alpha": beta[0] * per_year, "alpha_t": beta[0] / math.sqrt(cov[0, 0]), "ir": beta[0] / resid * math.sqrt(per_year), "r2": 1 - s["ee"] / total, **{f: float(b) for f, b in zip(factors, beta[1:], strict=True)}}


def rank_ic(df: DataFrame, score: str, outcome: str, at: str, least: int = 30) -> DataFrame:
    """Spearman correlation per date with at least `least` names."""
    from .windows import average_rank

    rows = df.where(f"`{score}` is not null and `{outcome}` is not null")
    ranked = rows.withColumn("_a", average_rank(score, [at])).withColumn("_b", average_rank(outcome, [at]))
    g = ranked.groupBy(at).agg(F.covar_pop("_a", "_b").alias("_c"), F.stddev_pop("_a").alias("_sa"), F.stddev_pop("_b").alias("_sb"), F.count(F.lit(1)).alias("names"))
    both = F.col("_sa") * F.col("_sb")
    return g.where(F.col("names") >= least).select(at, F.when(both > 0, F.col("_c") / both).alias("ic"), "names")


def sharpe(df: DataFrame, ret: str, order: str, by: list[str], every: int = 1, per_year: float = 252.0) -> DataFrame:
    """Annualised mean over deviation of every `every`-th row, and the t of its mean."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    rows = df.withColumn("_n", n).where((F.col("_n") - 1) % every == 0)
    g = rows.groupBy(*by).agg(F.count(ret).alias("n"), F.avg(ret).alias("_m"), F.stddev_samp(ret).alias("_s"))
    ratio = F.when(F.col("_s") > 0, F.col("_m") / F.col("_s"))
    return g.select(*by, "n", (ratio * math.sqrt(per_year / every)).alias("sharpe"), (ratio * F.sqrt("n")).alias("t"))


def bh_flags(df: DataFrame, p: str, by: list[str], level: float = 0.05) -> DataFrame:
    """`significant`: p at or under level times its rank over the number of tests (compared step by step); Bonferroni and BH-adjusted p."""
    known = df.where(F.col(p).isNotNull())
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = known.withColumn("_i", F.row_number().over(part.orderBy(p))).withColumn("_m", F.count(F.lit(1)).over(part))
    up = part.orderBy("_i").rowsBetween(0, Window.unboundedFollowing)
    adjusted = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_i")).over(up))
    return ranked.withColumn("significant", F.col(p) <= F.lit(level) * F.col("_i") / F.col("_m")).withColumn("bonferroni", F.least(F.lit(1.0), F.col(p) * F.col("_m"))).withColumn("bh_p", adjusted).drop("_i", "_m")


def paired_difference(a: DataFrame, b: DataFrame, at: str, value: str) -> DataFrame:
    """t of the mean difference of two per-session means."""
    x, y = (d.groupBy(at).agg(F.avg(value).alias(n)) for d, n in ((a, "_x"), (b, "_y")))
    g = x.join(y, at).select((F.col("_x") - F.col("_y")).alias("d")).agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("_s"))
    return g.select("n", "mean", (F.col("mean") / (F.col("_s") / F.sqrt("n"))).alias("t"))


def sharpe_difference(df: DataFrame, a: str, b: str) -> DataFrame:
    """z of the difference of two correlated Sharpe ratios (Memmel)."""
    g = df.agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("r"), (F.avg(a) / F.stddev_samp(a)).alias("x"), (F.avg(b) / F.stddev_samp(b)).alias("y"))
    v = (2 - 2 * F.col("r") + 0.5 * (F.col("x") ** 2 + F.col("y") ** 2 - 2 * F.col("x") * F.col("y") * F.col("r") ** 2)) / F.col("n")
    return g.select("n", F.col("x").alias("sharpe_a"), F.col("y").alias("sharpe_b"), ((F.col("x") - F.col("y")) / F.sqrt(v)).alias("z"))


def leaderboard(df: DataFrame) -> DataFrame:
    """Deflated and probabilistic Sharpe per row of (sharpe, n, skew, kurt, trials): expected best of `trials`, error, both probabilities, least track record."""
    se = F.sqrt((1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.col("sharpe") ** 2) / (F.col("n") - 1))
    euler = 0.5772156649015329
    best = (1 - euler) * normal_quantile(1 - 1 / F.col("trials")) + euler * normal_quantile(1 - 1 / (F.col("trials") * math.e))
    out = df.withColumn("sharpe_se", se).withColumn("expected_best", F.when(F.col("trials") > 1, best * F.col("sharpe_se")).otherwise(0.0))
    out = out.withColumn("psr", normal_cdf(F.col("sharpe") / F.col("sharpe_se"))).withColumn("dsr", normal_cdf((F.col("sharpe") - F.col("expected_best")) / F.col("sharpe_se")))
    z = 1.6448536269514722
    return out.withColumn("min_track_record", F.when(F.col("sharpe") > 0, 1 + (F.col("sharpe_se") ** 2) * (F.col("n") - 1) * (z / F.col("sharpe")) ** 2))


def detectable(se: Column) -> Column:
    """Smallest effect found with 80 % power at 5 %."""
    return (1.959963984540054 + 0.8416212335729143) * se


def iid_bootstrap_p(df: DataFrame, value: str, by: list[str], key: list[str], reps: int = 2000, seed: int = 7) -> DataFrame:
    """Share of centred resampled means at or above the mean, by `by`. A row takes a Poisson(1) weight in each replicate, drawn from a hash
    of its `key` (columns that tell the rows of a group apart), so equal values are drawn apart, any task draws the same, and
    replicates are summed where the rows lie: a task gives one row for each group and replicate. A replicate that draws no row is left out."""
    rows = df.where(F.col(value).isNotNull())
    mean = rows.groupBy(*by).agg(F.avg(value).alias("_m"))
    rows = rows.join(mean, by) if by else rows.crossJoin(F.broadcast(mean))
    rows = rows.select(*by, "_m", (F.col(value) - F.col("_m")).cast("double").alias("_d"), F.xxhash64(F.lit(seed), *by, *key).alias("_h"))
    edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        odd = np.arange(1, 2 * reps, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sums: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for group, part in frame.groupby([*by, "_m"], dropna=False, sort=False):
                total = sums.setdefault(group, np.zeros((2, reps)))
                for at in range(0, len(part), 256):
                    h = part["_h"].to_numpy()[at : at + 256].view(np.uint64)[:, None] ^ odd
                    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    weight = np.searchsorted(edges, (h >> np.uint64(11)) * 2.0**-53, "right").astype(float)
                    total += np.stack((part["_d"].to_numpy()[at : at + 256] @ weight, weight.sum(0)))
        for group, total in sums.items():
            yield pd.DataFrame({**dict(zip([*by, "_m"], group, strict=True)), "_rep": np.arange(reps), "_s": total[0], "_w": total[1]})

    schema = StructType([*(rows.schema[c] for c in [*by, "_m"])]).add("_rep", LongType()).add("_s", DoubleType()).add("_w", DoubleType())
    drawn = rows.mapInPandas(run, schema).groupBy(*by, "_m", "_rep").agg(F.sum("_s").alias("_s"), F.sum("_w").alias("_w")).where("_w > 0")
    reached = F.abs(F.col("_s") / F.col("_w")) >= F.abs("_m")
    return drawn.groupBy(*by, "_m").agg(F.avg(reached.cast("double")).alias("p")).select(*by, "p", F.col("_m").alias("mean"))


#: Values of a series that each task of a bootstrap may hold (64 MB).
PERIODS = 8_000_000


def stationary_bootstrap(series: DataFrame, columns: list[str], order: str, reps: int = 1000, block: float = 10.0, seed: int = 7, parts: int = 8) -> DataFrame:
    """rep, and each column's mean over a circular resample of geometric blocks, the same resample for all columns.

    `series` is date-level (one row a period): it goes to each task, which draws its own replicates from a seed per replicate. More than
    `PERIODS` values of it (rows times columns) are refused."""
    spark = series.sparkSession
    if (rows := series.count()) * len(columns) > PERIODS:
        raise ValueError(f"{rows} rows of {len(columns)} columns are no date-level series")
    values = series.orderBy(order).select(*columns).toPandas().to_numpy(float)
    shared = spark.sparkContext.broadcast(values)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = shared.value
        n = len(x)
        for frame in frames:
            out = []
            for r in frame["id"]:
                rng = np.random.default_rng([seed, int(r)])
                jump = rng.random(n) < 1 / block
                jump[:1] = True
                start = np.where(jump, rng.integers(0, max(n, 1), n), 0)
                run_start = np.maximum.accumulate(np.where(jump, np.arange(n), 0))
                at = (start[run_start] + np.arange(n) - run_start) % max(n, 1)
                out.append([r, *x[at].mean(0)])
            yield pd.DataFrame(out, columns=["rep", *columns])

    return spark.range(0, reps, 1, parts).mapInPandas(run, "rep long, " + ", ".join(f"`{c}` double" for c in columns))


def reality_check(series: DataFrame, columns: list[str], order: str, reps: int = 1000, block: float = 10.0, seed: int = 7) -> DataFrame:
    """best mean and the share of replicates whose largest centred mean reaches it."""
    n = series.count()
    means = series.agg(*(F.avg(c).alias(c) for c in columns)).first()
    best = max(means[c] for c in columns)
    draws = stationary_bootstrap(series, columns, order, reps, block, seed)
    top = F.greatest(*(F.col(f"`{c}`") - F.lit(means[c]) for c in columns)) if len(columns) > 1 else F.col(columns[0]) - F.lit(means[columns[0]])
    return draws.select(top.alias("_t")).agg(F.lit(best).alias("best_mean"), F.avg((F.col("_t") >= best).cast("double")).alias("p"), F.lit(n).alias("n"))


def residualize(df: DataFrame, y: str, factors: list[str], sector: str, at: str, least: int = 40) -> DataFrame:
    """Per date, residuals of y on factors and sector dummies (constant columns dropped); dates with fewer names get null."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ok = g[[y, *factors]].notna().all(axis=1)
        g = g.assign(residual=np.nan)
        if ok.sum() >= least:
            x = np.column_stack([g.loc[ok, factors].to_numpy(float), pd.get_dummies(g.loc[ok, sector]).to_numpy(float)])
            x = np.column_stack([np.ones(len(x)), x[:, x.std(0) > 0]])
            b, *_ = np.linalg.lstsq(x, g.loc[ok, y].to_numpy(float), rcond=None)
            g.loc[ok, "residual"] = g.loc[ok, y].to_numpy(float) - x @ b
        return g

    return df.groupBy(at).applyInPandas(run, StructType([*df.schema.fields]).add("residual", DoubleType()))


def effective_signals(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row, `effective`: (sum of eigenvalues)^2 / sum of their squares of the columns' correlation matrix (rows with a null left out).
    Each task sums products over its rows, and the sums meet as one k x k matrix."""
    k = len(columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k + 1, k + 1))
        for frame in frames:
            x = frame.dropna().to_numpy(float)
            x = np.column_stack((np.ones(len(x)), x))
            total += x.T @ x
        at = np.indices(total.shape).reshape(2, -1)
        yield pd.DataFrame({"i": at[0], "j": at[1], "s": total.ravel()})

    def eigen(frame: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((k + 1, k + 1))
        m[frame["i"], frame["j"]] = frame["s"]
        n = max(m[0, 0], 1.0)
        cov = m[1:, 1:] / n - np.outer(m[0, 1:], m[0, 1:]) / n**2
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        both = np.outer(sd, sd)
        e = np.linalg.eigvalsh(np.where(both > 1e-15, cov / np.where(both > 1e-15, both, 1), 0) * (1 - np.eye(k)) + np.eye(k))
        return pd.DataFrame({"effective": [float(e.sum() ** 2 / (e**2).sum())]})

    sums = df.select(*columns).mapInPandas(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    return sums.groupBy(F.lit(0).alias("all")).applyInPandas(lambda g: eigen(g), "effective double")


def bucket_spread(df: DataFrame, bucket: str, value: str, by: list[str]) -> DataFrame:
    """Mean of `value` in each bucket as an array from the lowest, the last less the first, and whether they only rise or only fall."""
    means = df.where(F.col(bucket).isNotNull() & F.col(value).isNotNull()).groupBy(*by, bucket).agg(F.avg(value).alias("_m"))
    g = means.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(bucket, "_m"))), lambda x: x["_m"]).alias("means"))
    steps = F.transform(F.sequence(F.lit(1), F.size("means") - 1), lambda i: F.get("means", i) - F.get("means", i - 1))
    monotone = (F.size("means") < 2) | F.forall(steps, lambda d: d >= 0) | F.forall(steps, lambda d: d <= 0)
    return g.select(*by, "means", (F.element_at("means", -1) - F.get("means", F.lit(0))).alias("spread"), monotone.alias("monotone"))


def double_sort(df: DataFrame, rows: str, columns: str, value: str, by: list[str], tie: list[str], q: int = 3) -> DataFrame:
    """Mean of `value` in each cell of two independent quantile sorts within `by`: a row for each bucket of `rows`, cell_0 .. of `columns`,
    and the first cell less the last."""
    from .features import quantile_bucket

    known = df.where(" and ".join(f"`{c}` is not null" for c in (rows, columns, value)))
    cells = known.withColumn("bucket", quantile_bucket(rows, by, q, tie)).withColumn("_b", quantile_bucket(columns, by, q, tie))
    g = cells.groupBy("bucket").agg(*(F.avg(F.when(F.col("_b") == i, F.col(value))).alias(f"cell_{i}") for i in range(q)), F.count(F.lit(1)).alias("n"))
    return g.withColumn("low_minus_high", F.col("cell_0") - F.col(f"cell_{q - 1}"))


def weighted_means(df: DataFrame, session: str, values: list[str], by: list[str]) -> DataFrame:
    """trades, sessions; of each value the mean over trades (`_tw`) and over sessions' means (`_sw`); t and one-sided p of the first value's
    session means."""
    per = df.groupBy(*by, session).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(v).alias(f"_s_{v}") for v in values))
    each = [x for v in values for x in ((F.sum(f"_s_{v}") / F.sum("_n")).alias(f"{v}_tw"), F.avg(F.col(f"_s_{v}") / F.col("_n")).alias(f"{v}_sw"))]
    sd = F.stddev_samp(F.col(f"_s_{values[0]}") / F.col("_n"))
    g = per.groupBy(*by).agg(F.sum("_n").alias("trades"), F.count(F.lit(1)).alias("sessions"), *each, sd.alias("_sd"))
    t = F.when(F.col("_sd") > 0, F.col(f"{values[0]}_sw") / (F.col("_sd") / F.sqrt("sessions")))
    return g.withColumn("t", t).withColumn("p", 1 - normal_cdf(F.col("t"))).drop("_sd")


def event_table(df: DataFrame, pnl: str, at: str, drop_top: int = 5, extra: dict[str, Column] | None = None, years: float | None = None) -> DataFrame:
    """Per slice (all, without the `drop_top` best, each year, and `extra`): events, mean, median, win_rate, p10, worst, sd, the share of the
    `drop_top` best in all gains, t clustered by month, clusters, and the sum a year (`years`: how many all rows cover; one for a year).

    A slice may hold most rows: its quantiles are counted in pieces, and its best rows are those left of the best of each piece."""
    # read for the best rows, the quantiles (three times), the sums and the clusters: written once
    rows = written(df.where(F.col(pnl).isNotNull()).select(*df.columns, F.monotonically_increasing_id().alias("_row")), "events")
    best = rows.orderBy(F.desc(pnl), "_row").limit(drop_top).select("_row", F.lit(True).alias("_best"))
    marked = rows.join(F.broadcast(best), "_row", "left").withColumn("_year", F.concat(F.lit("year_"), F.year(at).cast("string")))
    span = F.lit(years) if years is not None else None
    slices = {"all": F.lit(True), f"drop_top_{drop_top}": F.col("_best").isNull(), **(extra or {})}
    names = F.array_compact(F.array(*(F.when(hit, F.lit(n)) for n, hit in slices.items()), F.col("_year")))
    x = marked.select(F.explode(names).alias("slice"), F.col(pnl).cast("double").alias("x"), F.trunc(at, "month").alias("month"), F.year(at).alias("y"))
    top = largest(x.select("slice", "x", "month"), ["slice"], "x", drop_top).groupBy("slice").agg(F.sum("x").alias("_top"))
    cut = quantiles(x, ["slice"], "x", [0.5, 0.1], "_q").select("slice", F.col("_q")[0].alias("median"), F.col("_q")[1].alias("p10"))
    g = x.groupBy("slice").agg(
        F.count(F.lit(1)).alias("events"), F.avg("x").alias("mean"), F.avg((F.col("x") > 0).cast("double")).alias("win_rate"),
        F.min("x").alias("worst"), F.stddev_samp("x").alias("sd"), F.sum(F.when(F.col("x") > 0, F.col("x"))).alias("_gain"), F.sum("x").alias("_sum"), (F.max("y") - F.min("y") + 1).alias("_years"),
    )
    t = clustered_mean(x, "x", ["month"], ["slice"]).select("slice", "t", "clusters")
    covered = F.when(F.col("slice").startswith("year_"), 1.0).otherwise(F.col("_years") if span is None else span)
    return g.join(top, "slice").join(cut, "slice").join(t, "slice").withColumn("top_share", F.when(F.col("_gain") > 0, F.col("_top") / F.col("_gain"))).withColumn("per_year", F.col("_sum") / covered).drop("_gain", "_top", "_sum", "_years")


def nav_report(nav: DataFrame, by: list[str], day: str = "day", value: str = "nav", invested: str = "market_value", rate: str | None = None) -> DataFrame:
    """From a daily value series: months, mean monthly return over the rate (`rate`: a column of daily ones), its Newey-West t, the Sharpe
    ratio, the deepest fall below the running peak, and the mean share invested."""
    w = Window.partitionBy(*by).orderBy(day)
    df = nav.withColumn("_r", F.try_divide(F.col(value), F.lag(value).over(w)) - 1).withColumn("_f", F.try_divide(F.col(value), F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1)
    rf = F.coalesce(F.col(rate), F.lit(0.0)) if rate else F.lit(0.0)
    month = F.trunc(day, "month")
    held = df.where(F.col("_r").isNotNull()).groupBy(*by, month.alias("month")).agg((F.product(1 + F.col("_r")) - F.product(1 + rf)).alias("excess"))
    t = newey_west(held, "excess", "month", by).select(*by, F.col("n").alias("months"), F.col("mean").alias("mean_monthly_excess"), F.col("t").alias("t_nw"))
    sharpe_of = held.groupBy(*by).agg((F.avg("excess") / F.stddev_samp("excess") * math.sqrt(12)).alias("sharpe"))
    whole = df.groupBy(*by).agg(F.min("_f").alias("max_drawdown"), F.avg(F.try_divide(invested, value)).alias("capacity_used"))
    return t.join(sharpe_of, by).join(whole, by)


def break_even(gross: Column, turns: Column) -> Column:
    """Cost of one turn, each way, at which a gross return with so many turns is nothing."""
    return F.when(turns > 0, gross / (2 * turns))


def break_even_report(df: DataFrame, gross: str, cluster: list[str], price: str, by: list[str]) -> DataFrame:
    """What trades can afford to pay, in basis points of a round trip: gross mean and its clustered t, the lower end of its 95 % interval, the one certain cost (the median
    of a cent over the price), the smallest effect that would have been found, and a verdict: no gross edge (t below 1.96), below the one-cent floor, or clears the floor."""
    c = clustered_mean(df, gross, cluster, by)
    floor = df.withColumn("_f", 0.01 / F.col(price)).groupBy(*by).agg(F.median("_f").alias("_floor"))
    d = c.join(floor, by).withColumn("_low", F.col("mean") - 1.96 * F.col("se"))
    verdict = F.when(F.coalesce("t", F.lit(0.0)) < 1.96, "no gross edge").when(F.col("_low") < F.col("_floor"), "below the one-cent floor").otherwise("clears the floor")
    bp = {"gross_bp": F.col("mean"), "lower95_bp": F.col("_low"), "one_cent_floor_bp": F.col("_floor"), "mde_bp": detectable(F.col("se"))}
    return d.select(*by, F.col("t").alias("t_gross"), *((1e4 * x).alias(name) for name, x in bp.items()), verdict.alias("verdict"))


def robust_scores(trades: DataFrame, flagged: DataFrame, value: str, by: str, hold: int, at: str = "dt", entity: str = "symbol", low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Block-clustered mean and t per group three times: of all trades (raw), without the flagged entities (clean), and with all values clipped to quantiles of
    the whole (trimmed); trades, blocks, and the share of the five largest absolute values."""
    from .windows import winsorize

    # every version and share reads the trades again, the quantiles three times: they are written once
    trades = written(trades.select(*dict.fromkeys((by, entity, at, value))), "trades")
    first = trades.agg(F.min(at).alias("_first"))
    t = trades.crossJoin(F.broadcast(first)).withColumn("_block", time_block(at, F.col("_first"), hold))
    versions = {"raw": t, "clean": t.join(flagged.select(entity).distinct(), entity, "left_anti"), "trimmed": winsorize(t, value, [], low, high)}
    out = None
    for name, rows in versions.items():
        m = clustered_mean(rows, value, ["_block"], [by]).select(by, F.col("mean").alias(f"mean_{name}"), F.col("t").alias(f"t_{name}"), *([F.col("n").alias("trades")] if name == "raw" else [F.col("clusters").alias("blocks")] if name == "trimmed" else []))
        out = m if out is None else out.join(m, by, "left")
    size = t.select(by, F.abs(value).alias("_a"))
    top = largest(size, [by], "_a", 5).groupBy(by).agg(F.sum("_a").alias("_top"))
    share = size.groupBy(by).agg(F.sum("_a").alias("_all")).join(top, by)
    return out.join(share.select(by, F.when(F.col("_all") > 0, F.col("_top") / F.col("_all")).alias("top5_share")), by)


def nav_turnover(nav: DataFrame, trades: DataFrame, by: list[str], value: str = "nav", per_year: int = 252) -> DataFrame:
    """turnover_per_year: what was bought and sold (trades: qty, entry_px, exit_px, null while open) over the mean value, a year of the series."""
    level = nav.groupBy(*by).agg(F.avg(value).alias("_level"), F.count(value).alias("_days"))
    traded = trades.groupBy(*by).agg(F.sum(F.col("qty") * (F.col("entry_px") + F.coalesce("exit_px", F.lit(0.0)))).alias("_traded"))
    return level.join(traded, by).select(*by, (F.col("_traded") / F.col("_level") / (F.col("_days") / F.lit(float(per_year)))).alias("turnover_per_year"))


def nav_factors(nav: DataFrame, by: list[str], market: str, day: str = "day", value: str = "nav", rate: str | None = None, lags: int = 5, per_year: int = 252) -> DataFrame:
    """Per series: n, alpha a year and its t (Newey-West error with `lags`), beta to a market column, beta on its days below nothing, and r2, of daily returns over the
    rate. Sums and one window a series, so any number of them is one job: the alpha's error is that of the mean of e (a00 + a01 x), with a the inverse of x'x."""
    w = Window.partitionBy(*by).orderBy(day)
    y = F.try_divide(F.col(value), F.lag(value).over(w)) - 1 - (F.coalesce(F.col(rate), F.lit(0.0)) if rate else F.lit(0.0))
    d = nav.withColumn("_y", y).withColumn("_x", F.col(market).cast("double")).where("_y is not null and _x is not null")
    n, sx, sxx = F.count(F.lit(1)), F.sum("_x"), F.sum(F.col("_x") * F.col("_x"))
    down = F.col("_x") < 0
    dx, dy = F.when(down, F.col("_x")), F.when(down, F.col("_y"))
    s = d.groupBy(*by).agg(
        n.alias("n"), F.when(F.var_samp("_x") > 0, F.covar_samp("_y", "_x") / F.var_samp("_x")).alias("beta"), F.avg("_y").alias("_my"), F.avg("_x").alias("_mx"), F.when(F.var_samp(dx) > 0, F.covar_samp(dy, dx) / F.var_samp(dx)).alias("down_beta"),
        (sxx / (n * sxx - sx * sx)).alias("_a00"), (-sx / (n * sxx - sx * sx)).alias("_a01"), (F.var_pop("_y") * n).alias("_total"),
    )
    e = F.col("_y") - F.col("_alpha") - F.col("beta") * F.col("_x")
    rows = d.join(s.withColumn("_alpha", F.col("_my") - F.col("beta") * F.col("_mx")), by).withColumn("_e", e).withColumn("_u", F.col("_e") * (F.col("_a00") + F.col("_a01") * F.col("_x")))
    own = Window.partitionBy(*by).orderBy(day)
    term = F.col("_u") * F.col("_u")
    for k in range(1, lags + 1):
        term = term + 2 * (1 - k / (lags + 1)) * F.coalesce(F.col("_u") * F.lag("_u", k).over(own), F.lit(0.0))
    g = rows.withColumn("_t", term).groupBy(*by).agg(F.first("n").alias("n"), F.first("_alpha").alias("_alpha"), F.first("beta").alias("beta"), F.first("down_beta").alias("down_beta"), F.first("_total").alias("_total"), F.sum("_t").alias("_v"), F.sum(F.col("_e") * F.col("_e")).alias("_sse"))
    return g.select(*by, "n", (F.col("_alpha") * per_year).alias("alpha_annual"), F.when(F.col("_v") > 0, F.col("_alpha") / F.sqrt("_v")).alias("alpha_t"), "beta", "down_beta", F.when(F.col("_total") > 0, 1 - F.col("_sse") / F.col("_total")).alias("r2"))
