"""Registered queries over files and texts that Spark writes out of the tables and reads back: scans, sinks, containers and extraction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events, features, text
from ..sources import readers
from ..sources.adapters import DAILY_SQL, daily_bars, table
from ..sources.shared import passing, shared_dir
from ..streaming import jobs
from .catalog import query, rounded
from .catalog_filings import _filler, _long_day, filings


def _path(spark, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    passing(spark, path)
    return path


@query(f"""with {DAILY_SQL} select symbol, dt, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round("close", 6) as "close", round(adj_close, 6) as adj_close, volume from bars""")
def a_bars_csv(spark, sf_dir):
    path = _path(spark, "bars-csv")
    daily_bars(spark, sf_dir).select(*(c.split()[0] for c in readers.BARS.split(", "))).write.option("header", True).option("compression", "gzip").csv(path)
    return rounded(readers.bars_csv(spark, path))


@query(f"""with {DAILY_SQL} select symbol, dt, round("close", 6) as "close" from bars where dt <= date '1996-12-31'""")
def a_bounded_parquet(spark, sf_dir):
    path = _path(spark, "bars-by-year")
    readers.materialize(daily_bars(spark, sf_dir), path)
    return rounded(readers.bounded_parquet(spark, path, ["symbol", "dt", "close"], max_date="1996-12-31"))


@query("""select o_orderkey, o_custkey, round(o_totalprice, 6) as o_totalprice, o_orderpriority, count(*) over (partition by o_orderpriority) as in_file from orders""")
def a_many_files(spark, sf_dir):
    """A file for each priority, read by one pattern; which file a row comes from is told by the rows it has."""
    path = _path(spark, "many")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    o.repartition("o_orderpriority").write.option("header", True).partitionBy("o_orderpriority").csv(path)
    rows = readers.many_files(spark, f"{path}/*/*.csv", "o_orderkey long, o_custkey long, o_totalprice double")
    of = o.select("o_orderkey", "o_orderpriority").join(rows, "o_orderkey")
    from pyspark.sql import Window

    return rounded(of.withColumn("in_file", F.count(F.lit(1)).over(Window.partitionBy("o_orderpriority"))).drop("file"))


@query("""with f as (select l_orderkey as accession, 'owner' || lpad(cast(min(l_suppkey) as varchar), 6, '0') as owner from lineitem group by 1)
select o_orderkey as accession, l_linenumber, case l_linenumber % 3 when 0 then 'P' when 1 then 'S' end as code, round(l_quantity, 6) as shares, f.owner from orders join lineitem on o_orderkey = l_orderkey left join f on f.accession = o_orderkey where o_orderkey % 4 = 0 and l_linenumber % 3 < 2""")
def a_insider_tsv(spark, sf_dir):
    path = _path(spark, "insiders")
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    o.select(F.col("o_orderkey").alias("accession"), F.when(F.col("o_orderkey") % 4 == 0, "4").otherwise("3").alias("form")).write.option("header", True).option("sep", "\t").csv(f"{path}/s")
    code = F.when(F.col("l_linenumber") % 3 == 0, "P").when(F.col("l_linenumber") % 3 == 1, "S").otherwise("G")
    li.select(F.col("l_orderkey").alias("accession"), "l_linenumber", code.alias("code"), F.col("l_quantity").alias("shares")).write.option("header", True).option("sep", "\t").csv(f"{path}/t")
    li.select(F.col("l_orderkey").alias("accession"), F.concat(F.lit("owner"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("owner")).write.option("header", True).option("sep", "\t").csv(f"{path}/o")
    s, t, w = (readers.tsv(spark, f"{path}/{n}", schema) for n, schema in (("s", "accession long, form string"), ("t", "accession long, l_linenumber int, code string, shares double"), ("o", "accession long, owner string")))
    return rounded(readers.insider_trades(s, t, w).select("accession", "l_linenumber", "code", "shares", "owner"))


def _facts(spark, sf_dir) -> DataFrame:
    """One nested document of facts a customer: an order is a fact, of one of two concepts and two namespaces."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    record = F.struct(d.cast("string").alias("end"), F.col("o_totalprice").alias("val"), k.cast("string").alias("accn"), F.when(k % 5 == 0, "8-K").otherwise("10-Q").alias("form"), F.date_add(d, 30).cast("string").alias("filed"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.when(k % 3 == 0, "ifrs-full").otherwise("us-gaap").alias("ns"), F.when(k % 2 == 0, "Assets").otherwise("Trust").alias("concept"), F.when(k % 7 == 0, "EUR").otherwise("USD").alias("unit"), record.alias("r"))
    units = o.groupBy("key", "ns", "concept", "unit").agg(F.collect_list("r").alias("rs")).groupBy("key", "ns", "concept").agg(F.map_from_entries(F.collect_list(F.struct("unit", "rs"))).alias("units"))
    concepts = units.groupBy("key", "ns").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct("units")))).alias("c"))
    spaces = concepts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("ns", "c"))).alias("facts"))
    return spaces.select("key", F.to_json(F.struct("facts")).alias("json"))


_FACTS_SQL = """o as (select o_custkey as key, case when o_orderkey % 3 = 0 then 2 else 1 end as ns, case when o_orderkey % 2 = 0 then 'Assets' else 'Trust' end as concept, case when o_orderkey % 7 = 0 then 'EUR' else 'USD' end as unit, cast(o_orderdate as date) as d, o_totalprice as val, o_orderkey as accn, o_orderkey % 5 > 0 as periodic from orders),
best as (select key, concept, min(ns) as ns from o group by 1, 2), facts as (select o.* from o join best using (key, concept, ns) where unit = 'USD' and periodic)"""


@query(f"""with {_FACTS_SQL} select key, concept, unit, d as period_end, cast(d + 30 as date) as filed, round(val, 6) as val, '10-Q' as form, cast(accn as varchar) as accn from facts""")
def a_json_facts(spark, sf_dir):
    return rounded(readers.json_facts(_facts(spark, sf_dir), ["Assets", "Trust"], ["us-gaap", "ifrs-full"]))


@query(f"""with {_FACTS_SQL} select key, cast(accn as varchar) as accn, d as period_end, round(val, 6) as balance, cast(d + 30 as date) as filed from facts where val != 0""")
def a_filing_balance(spark, sf_dir):
    return rounded(readers.filing_balance(readers.json_facts(_facts(spark, sf_dir), ["Assets", "Trust"], ["us-gaap", "ifrs-full"]), ["Trust", "Assets"]))


@query("""select 'SC TO-I' as form, 'CUSTOMER ' || o_custkey || ' CORP' as company, cast(o_custkey as varchar) as cik, cast(o_orderdate as date) as filed, 'edgar/data/' || o_orderkey || '.txt' as path from orders where o_orderkey % 3 = 0""")
def a_form_index(spark, sf_dir):
    path, k = _path(spark, "index"), F.col("o_orderkey")
    d = F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    form = F.when(k % 3 == 0, "SC TO-I").when(k % 3 == 1, "SC TO-I/A").otherwise("10-K")
    company = F.concat(F.lit("CUSTOMER "), F.col("o_custkey").cast("string"), F.lit(" CORP"))
    line = F.concat(F.rpad(form, 12, " "), F.rpad(company, 40, " "), F.rpad(F.col("o_custkey").cast("string"), 12, " "), F.rpad(d, 12, " "), F.lit("edgar/data/"), k.cast("string"), F.lit(".txt"))
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    return readers.form_index(spark, path, ["SC TO-I"])


@query("""select row_number() over (order by o_orderkey) as n, o_orderkey, o_orderstatus as status, round(o_totalprice, 6) as price from orders where o_orderkey % 9 > 0""")
def a_ledger_lines(spark, sf_dir):
    path = _path(spark, "ledger")
    o = table(spark, sf_dir, "orders")
    line = F.when(F.col("o_orderkey") % 9 > 0, F.to_json(F.struct("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")))).otherwise(" ")
    o.select(line.alias("value")).write.text(path)
    from pyspark.sql import Window

    rows = readers.ledger_lines(spark, path, "o_orderkey long, status string, price double").drop("value")
    # one key a line: the number in order of keys says that none is missing
    smaller = rows.groupBy(F.floor(F.col("o_orderkey") / 1000).alias("_p")).count()
    start = smaller.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    n = F.row_number().over(Window.partitionBy("_p").orderBy("o_orderkey"))
    return rounded(rows.withColumn("_p", F.floor(F.col("o_orderkey") / 1000)).withColumn("_n", n).join(start, "_p").select((F.col("_from") + F.col("_n")).alias("n"), "o_orderkey", "status", "price"))


@query(f"""with {DAILY_SQL}, d as (select dt, count(*) as x, sum(volume) as y from bars group by 1) select dt, x / 100::double as mkt, y / 100::double as vol from d where dt < date '1998-01-01'""")
def a_first_block(spark, sf_dir):
    """A file of dated values between a preamble and a second block; its lines are numbered by date."""
    d = daily_bars(spark, sf_dir).groupBy("dt").agg(F.count(F.lit(1)).alias("x"), F.sum("volume").alias("y"))
    body = d.select(F.datediff("dt", F.lit("1990-01-01")).alias("n"), F.concat_ws(", ", F.date_format("dt", "yyyyMMdd"), F.col("x").cast("string"), F.col("y").cast("string")).alias("value"))
    cut = body.select((F.datediff(F.lit("1998-01-01"), F.lit("1990-01-01")) - 0.5).alias("n")).limit(1)
    lines = body.select(F.col("n").cast("double"), "value").unionByName(cut.select("n", F.lit("").alias("value")))
    lines = lines.unionByName(cut.select(F.lit(-2.0).alias("n"), F.lit("Made of bars").alias("value"))).unionByName(cut.select(F.lit(-1.0).alias("n"), F.lit(",Mkt,Vol").alias("value")))
    return readers.first_block(lines, ["mkt", "vol"])


@query("""select o_custkey, round(max(o_totalprice), 6) as price, cast(max(year(o_orderdate)) as int) as year from orders group by o_custkey, year(o_orderdate)""")
def a_upsert_table(spark, sf_dir):
    """The dearest order of each customer and year: even orders first, then odd ones merged into the years they touch."""
    path = _path(spark, "upserted")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey"), F.col("o_totalprice").alias("price"), F.year("o_orderdate").alias("year"), "o_orderkey")
    for odd in (0, 1):
        readers.upsert_table(spark, path, o.where(F.col("o_orderkey") % 2 == odd).drop("o_orderkey"), ["o_custkey", "year"], "price", "year")
    return rounded(spark.read.parquet(path))


# --- texts ---


@query("""select o_orderkey as id, case when o_orderkey % 3 = 0 then 2 else 0 end as part, 'SC TO-I' as type, case when o_orderkey % 3 = 0 then 64 else 40 end as size from orders""")
def k_main_parts(spark, sf_dir):
    """Containers of three parts: a letter that only mentions the offer behind a notice, a picture, and the offer; the longest part with the offer first is the main one."""
    k = F.col("o_orderkey")
    one = F.lit("<DOCUMENT><TYPE>SC TO-I\n<TEXT>" + "Offer to purchase".ljust(40, ".") + "</TEXT></DOCUMENT>")
    picture = F.lit("<DOCUMENT><TYPE>GRAPHIC\n<TEXT>" + "Offer to purchase".ljust(90, ".") + "</TEXT></DOCUMENT>")
    other = F.when(k % 3 == 0, "Offer to purchase".ljust(64, ".")).when(k % 3 == 1, "Letter of transmittal. Offer to purchase".ljust(70, ".")).otherwise("Nothing".ljust(80, "."))
    c = table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(one, picture, F.lit("<DOCUMENT><TYPE>sc to-i\n<TEXT>"), other, F.lit("</TEXT></DOCUMENT>")).alias("text"))
    m = text.main_part(text.parts(c), r"(?i)offer to purchase", r"(?i)letter of transmittal")
    return m.select("id", F.col("part"), "type", F.length("body").alias("size"))


@query(f"""with {DAILY_SQL}, c as (select distinct dt from bars), o as (select o_orderkey, cast(o_orderdate as date) as d, o_orderkey % 2 = 0 as late from orders where o_orderkey % 5 > 0),
n as (select o_orderkey, d, min(c.dt) as e from o left join c on (c.dt > o.d or (not late and c.dt = o.d)) group by 1, 2) select o_orderkey as doc_id, d as stated, e as effective from n""")
def k_effective_dates(spark, sf_dir):
    k, d = F.col("k"), F.col("d")
    said = F.when(k % 5 == 0, "Nothing is decided.").otherwise(F.concat(F.lit("The split will become effective on "), _long_day(d), F.when(k % 2 == 0, ", after the market close.").otherwise(", before trading opens.")))
    return text.effective_dates(filings(spark, sf_dir, _filler(F.lit(100)), said), features.calendar(daily_bars(spark, sf_dir)))


@query("""select o_orderkey as doc_id, cast(case when o_orderkey % 4 = 0 then 2 else 1 end as int) as sentence_n from orders where o_orderkey % 4 < 2""")
def k_cancellations(spark, sf_dir):
    k = F.col("k")
    said = F.when(k % 4 == 0, "It pays well. It has been terminated.").when(k % 4 == 1, "The offer was withdrawn. It had been abandoned.").when(k % 4 == 2, "If it has been terminated, we will tell.").otherwise("It may be cancelled.")
    return text.cancellations(text.sentences(filings(spark, sf_dir, "We make pumps. ", said)), "doc_id")


@query("""select o_orderkey as doc_id, p_partkey as entity from orders join part on p_partkey = o_custkey""")
def k_mentions(spark, sf_dir):
    """Each filing names one maker, of as many as there are parts, at its end, beyond any prefix."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), F.concat(F.lit("Maker"), F.col("p_partkey").cast("string"), F.lit("x Pumps, Inc.")).alias("name"))
    f = filings(spark, sf_dir, _filler(F.lit(2000)), "We thank MAKER", F.col("o_custkey").cast("string"), "X Pumps for it. Maker7x pumpsuits are not theirs.")
    return events.mentions(p, f)


@query("""select o_orderkey as doc_id, 'TK' || chr(cast(65 + o_orderkey % 26 as int)) as symbol, false as plausible from orders union all select o_orderkey, 'BRK-' || chr(cast(65 + o_orderkey % 2 as int)), false from orders where o_orderkey % 3 = 0""")
def k_constituents(spark, sf_dir):
    k = F.col("k")
    bare = F.when(k % 3 == 0, F.concat(F.lit("\n| BRK."), F.char(65 + k % 2), F.lit("\n"))).otherwise("\n")
    return text.constituents(filings(spark, sf_dir, "{{NYSE|TK", F.char(65 + k % 26), "}} and more", bare, "== Changes ==\n{{NYSE|GONE}}"), "doc_id", "text")


@query("""select o_orderpriority as grp, count(*) as n, round(avg(case when o_orderkey % 3 > 0 then 1.0 else 0.0 end), 6) as parsed, round(avg(case when o_orderkey % 3 > 0 then case when o_orderkey % 4 = 0 then 0.0 else 1.0 end end), 6) as agree from orders group by 1""")
def k_coverage_audit(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    parsed = o.where(k % 3 > 0).select("o_orderkey", F.when(k % 4 == 0, -1.0).otherwise(F.col("o_totalprice")).alias("price"))
    return rounded(text.coverage_audit(parsed, o.select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("price")), "o_orderkey", "price", F.col("o_orderpriority")))


@query("""with e as (select distinct o_custkey, cast(o_orderdate as date) as d from orders where o_orderkey % 10 = 0) select o_orderkey from orders o where o_orderkey % 2 = 1 and exists (select 1 from e where e.o_custkey = o.o_custkey and cast(o.o_orderdate as date) between e.d - 120 and e.d + 10)""")
def k_filing_scope(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    f = o.select("o_orderkey", "o_custkey", F.when(k % 2 == 1, "8-K").otherwise("10-K").alias("form"), F.to_date("o_orderdate").alias("filed"))
    e = o.where(k % 10 == 0).select("o_custkey", F.to_date("o_orderdate").alias("effective"))
    return events.filing_scope(f, e, ["8-K"], ["o_custkey"]).select("o_orderkey")


@query("""select o_orderkey from orders where o_orderkey % 3 = 0 and o_orderkey % 5 < 2 and o_orderkey % 7 > 0""")
def b_in_scope(spark, sf_dir):
    k = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 == 0, "common").otherwise("notes").alias("security"), F.when(k % 7 == 0, True).when(k % 7 == 1, None).otherwise(False).alias("is_exchange"), F.when(k % 5 == 0, "dutch").when(k % 5 == 1, "fixed").otherwise("nav").alias("offer_type"))
    return events.in_scope(d).select("o_orderkey")


@query("""select user_id, cast(ts as date) as day, max(event_id) as last_event, count(*) as n from events group by 1, 2""")
def l_scored_once(spark, sf_dir):
    """Events as a stream of two files that overlap by half: each is scored once, and what was appended is summed."""
    path = _path(spark, "stream")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    for n, part in enumerate((e.where("event_id % 4 < 3"), e.where("event_id % 4 > 0"))):
        part.repartition(4).write.parquet(f"{path}/in/{n}")
    stream = spark.readStream.schema(e.schema).parquet(f"{path}/in/*")
    jobs.scoring_stream(stream, lambda b: b.withColumn("day", F.to_date("ts")), f"{path}/out", f"{path}/checkpoint", ["event_id"], "ts").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("user_id", "day").agg(F.max("event_id").alias("last_event"), F.count(F.lit(1)).alias("n"))


@query("""with x as (select user_id, ts, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_type) as was from (select *, count(*) over (partition by user_id, ts) as same from events) where same = 1) select user_id, event_id, event_type from x where was is null or was != event_type""")
def l_changes_only(spark, sf_dir):
    path = _path(spark, "changes")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    once = e.groupBy("user_id", "ts").count().where("count = 1").drop("count")
    e.join(once, ["user_id", "ts"]).repartition(4).write.parquet(f"{path}/in")
    jobs.change_stream(spark.readStream.schema(e.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/checkpoint", ["user_id"], ["event_type"], "ts").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("user_id", "event_id", "event_type")


@query("""with f as (select c_custkey, case c_custkey % 6 when 0 then 'Alpha Income ' || c_custkey when 1 then 'Beta L.P.' when 2 then 'Gamma Alpine Pumps' when 3 then 'Delta llc' when 4 then 'Trusty Parts' else 'Omega Works' end as company, c_custkey % 10 = 0 as known, c_custkey // 3 as cik, case when c_custkey % 3 = 0 then 'SC TO-I' else 'SC TO-I/A' end as form from customer),
o as (select * from f where form = 'SC TO-I' and (known or not regexp_matches(company, '(?i)income|trust|(^|[^a-z0-9])(l\\.?p\\.?|llc)($|[^a-z0-9])')))
select c_custkey from o union all select c_custkey from f where form = 'SC TO-I/A' and cik in (select cik from o)""")
def b_offers_worth_reading(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.when(k % 6 == 0, F.concat(F.lit("Alpha Income "), k.cast("string"))).when(k % 6 == 1, "Beta L.P.").when(k % 6 == 2, "Gamma Alpine Pumps").when(k % 6 == 3, "Delta llc").when(k % 6 == 4, "Trusty Parts").otherwise("Omega Works")
    f = table(spark, sf_dir, "customer").select(k, name.alias("company"), (k % 10 == 0).alias("known"), F.floor(k / 3).alias("cik"), F.when(k % 3 == 0, "SC TO-I").otherwise("SC TO-I/A").alias("form"))
    return text.offers_worth_reading(f, F.col("known")).select("c_custkey")


@query("""select o_orderkey, 'A-' || (o_custkey % 9) as symbol from orders where o_orderkey % 4 > 0 and o_orderkey % 3 < 2""")
def b_dropped_for_size(spark, sf_dir):
    k = F.col("o_orderkey")
    why = F.when(k % 3 == 0, "Market capitalization change").when(k % 3 == 1, "Not Representative of large caps").otherwise("Acquired")
    c = table(spark, sf_dir, "orders").select(k, F.when(k % 4 > 0, F.concat(F.lit("A."), (F.col("o_custkey") % 9).cast("string"), F.lit(" "))).alias("removed"), why.alias("reason"))
    return text.dropped_for_size(c, "removed", "reason").select("o_orderkey", "symbol")


@query("""select o_orderdate, o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as place from orders""")
def o_sorted_table(spark, sf_dir):
    """Orders written in order of day and key; each row's place is read off the files: rows in the parts before, and its place inside its part."""
    from pyspark.sql import Window

    path = _path(spark, "sorted")
    readers.sorted_table(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), path, ["o_orderdate", "o_orderkey"], 6)
    rows = spark.read.parquet(path).select("o_orderdate", "o_orderkey", F.col("_metadata.file_name").alias("part"), F.col("_metadata.row_index").alias("i"))
    sizes = rows.groupBy("part").count()
    before = sizes.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, "part").select("o_orderdate", "o_orderkey", (F.col("before") + F.col("i") + 1).alias("place"))
