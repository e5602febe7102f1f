"""Scans with explicit schemas, bounds and pruning, and sinks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BARS = "symbol string, dt date, open double, high double, low double, close double, adj_close double, volume long"
FACTS = "map<string,map<string,struct<units:map<string,array<struct<`end`:string,val:double,accn:string,form:string,filed:string>>>>>>"


def bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot of daily bars, plain or gzipped."""
    return spark.read.schema(BARS).option("header", True).csv(path)


def bounded(df: DataFrame, date_col: str, max_date: date | str | None) -> DataFrame:
    """Rows up to `max_date`. A text column of months (YYYY-MM) keeps the months that end by then; other text is an ISO date."""
    if max_date is None:
        return df
    limit = F.lit(str(max_date)).cast("date")
    if dict(df.dtypes)[date_col] != "string":
        return df.where(F.col(date_col).cast("date") <= limit)
    whole_month = F.last_day(F.try_to_timestamp(F.concat(F.col(date_col), F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date"))
    return df.where(F.when(F.length(date_col) == 7, whole_month <= limit).otherwise(F.col(date_col).try_cast("date") <= limit))


def bounded_query(spark: SparkSession, sql: str, date_col: str, max_date: date | str | None, **views: DataFrame) -> DataFrame:
    """Any query, bounded from outside; Catalyst pushes the bound down."""
    return bounded(spark.sql(sql, **views), date_col, max_date)


def bounded_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, date_col: str = "dt", max_date: date | str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = bounded(df, date_col, max_date)
    return df.select(*columns) if columns else df


def sealed(df: DataFrame, date_col: str, seal: date | str, asked: date | str | None) -> DataFrame:
    """Refuse a request that reaches the seal; bound the rows in any case."""
    if asked is None or str(asked) >= str(seal):
        raise PermissionError(f"{asked} is not before the seal {seal}")
    return bounded(df, date_col, asked)


def bars_of_kind(bars: DataFrame, symbols: DataFrame, kind: str = "stock") -> DataFrame:
    return bars.join(symbols.where(F.col("kind") == kind).select("symbol"), "symbol", "left_semi")


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated with a header; malformed lines are dropped."""
    return spark.read.schema(schema).option("header", True).option("sep", "\t").option("mode", "DROPMALFORMED").csv(path)


def insider_trades(submissions: DataFrame, transactions: DataFrame, owners: DataFrame) -> DataFrame:
    """Form 4 purchases and sales with the first owner of each filing."""
    first = owners.groupBy("accession").agg(F.min("owner").alias("owner"))
    trades = transactions.where(F.col("code").isin("P", "S"))
    return submissions.where("form = '4'").join(trades, "accession").join(first, "accession", "left")


def json_facts(df: DataFrame, concepts: list[str], namespaces: list[str], units: tuple[str, ...] = ("USD", "shares", "USD/shares"), forms: tuple[str, ...] = ("10-K", "10-Q", "10-K/A", "10-Q/A", "20-F")) -> DataFrame:
    """key, concept, unit, period_end, filed, val, form, accn of (key, json): facts of each concept from the first namespace that has it."""
    parsed = df.select("key", F.from_json(F.col("json"), f"facts {FACTS}")["facts"].alias("facts"))
    by_ns = parsed.select("key", F.explode("facts").alias("namespace", "concepts")).where(F.col("namespace").isin(namespaces))
    rank = F.array_position(F.array(*map(F.lit, namespaces)), F.col("namespace"))
    each = by_ns.select("key", rank.alias("rank"), F.explode("concepts").alias("concept", "c")).where(F.col("concept").isin(concepts))
    best = each.withColumn("_n", F.row_number().over(Window.partitionBy("key", "concept").orderBy("rank"))).where("_n = 1")
    rows = best.select("key", "concept", F.explode("c.units").alias("unit", "records")).where(F.col("unit").isin(list(units))).select("key", "concept", "unit", F.explode("records").alias("r"))
    out = rows.select("key", "concept", "unit", F.to_date("r.end").alias("period_end"), F.to_date("r.filed").alias("filed"), "r.val", "r.form", "r.accn")
    return out.where(F.col("form").isin(list(forms)) & F.col("period_end").isNotNull() & F.col("filed").isNotNull() & F.col("val").isNotNull())


def filing_balance(facts: DataFrame, tags: list[str]) -> DataFrame:
    """One value per (key, accn): of the facts at that filing's latest period end, the first tag that has one, zeros left out."""
    last = facts.groupBy("key", "accn").agg(F.max("period_end").alias("_end"))
    at = facts.join(last, ["key", "accn"]).where((F.col("period_end") == F.col("_end")) & (F.col("val") != 0))
    return at.groupBy("key", "accn", "period_end").agg(F.coalesce(*(F.max(F.when(F.col("concept") == t, F.col("val"))) for t in tags)).alias("balance"), F.min("filed").alias("filed")).where("balance is not null")


def form_index(spark: SparkSession, path: str, forms: list[str]) -> DataFrame:
    """form, company, cik, filed, path of a fixed-width index."""
    lines = spark.read.text(path).select(F.trim(F.substring("value", 1, 12)).alias("form"), F.expr("substring(value, 13)").alias("rest")).where(F.col("form").isin(forms))
    part = lambda i: F.regexp_extract("rest", r"^\s*(.*?)\s+(\d+)\s+(\d{4}-\d{2}-\d{2}|\d{8})\s+(\S+)\s*$", i)
    return lines.select("form", part(1).alias("company"), part(2).alias("cik"), F.coalesce(F.to_date(F.try_to_timestamp(part(3), F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp(part(3), F.lit("yyyyMMdd")))).alias("filed"), part(4).alias("path")).where("cik <> ''")


def first_block(lines: DataFrame, columns: list[str], scale: float = 0.01) -> DataFrame:
    """Dated rows of the first block of (n, value): from behind the first line that begins with a comma up to the next blank line. Values are scaled."""
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # one small file
    head = F.max(F.when(F.col("value").startswith(","), 1).otherwise(0)).over(w)
    df = lines.withColumn("_in", head)
    df = df.withColumn("_end", F.max(F.when((F.col("_in") == 1) & (F.trim("value") == ""), 1).otherwise(0)).over(w)).where((F.col("_in") == 1) & (F.col("_end") == 0) & ~F.col("value").startswith(","))
    cells = F.split("value", ",")
    return df.select(F.to_date(F.try_to_timestamp(F.trim(cells[0]), F.lit("yyyyMMdd"))).alias("dt"), *((F.trim(cells[i + 1]).try_cast("double") * scale).alias(c) for i, c in enumerate(columns))).where("dt is not null")


def ledger_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with the raw line kept."""
    return spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", schema).alias("entry")).select("value", "entry.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union in which, per key, the row with the largest `order` wins (new ones on a tie)."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def materialize(df: DataFrame, path: str, date_col: str = "dt", kind: str = "parquet") -> None:
    """A table partitioned by year, sorted by symbol inside files so that symbol filters skip row groups; `kind`: parquet, csv (with a
    header) or json (one row a line)."""
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(kind)
    if "year" in (c.lower() for c in df.columns):
        raise ValueError("the table has a column named year already")
    year: Column = F.year(date_col)
    out = df.withColumn("year", year).repartition("year", "symbol").sortWithinPartitions("symbol", date_col)
    out.write.format(kind).option("header", True).mode("overwrite").partitionBy("year").save(path)


def many_files(spark: SparkSession, pattern: str, schema: str, kind: str = "csv") -> DataFrame:
    """All files that a glob names, with `file`, the name of the one a row comes from; a schema is given, so no file is read to guess it."""
    rows = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").format(kind).load(pattern)
    return rows.withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: str, partition: str) -> None:
    """Merge rows into a table partitioned by `partition` (a column of `new`), rewriting only the partitions that `new` touches.

    Per key the row with the largest `order` wins, the new one on a tie; a key stays in one partition. The touched partitions are
    read, merged and put in place of the old ones in one job (dynamic partition overwrite), which leaves the others' files as they are; run again with the same rows it
    gives the same table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    merged = new
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        touched = [r[0] for r in new.select(partition).distinct().collect()]  # partition names, not rows
        old = spark.read.schema(new.schema).parquet(path).where(F.col(partition).isin([x for x in touched if x is not None]) | (F.col(partition).isNull() if None in touched else F.lit(False)))
        merged = upsert(old, new, keys, order)
    else:
        merged = upsert(new.limit(0), new, keys, order)
    merged.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def sorted_table(df: DataFrame, path: str, order: list[str], partitions: int) -> None:
    """A table in one global order: parts by ranges of `order`, sorted inside, so that files read in the order of their names give the rows in order."""
    df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).write.parquet(path)
