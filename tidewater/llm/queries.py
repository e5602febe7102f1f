"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    common.ship(spark)
    return scan(common.documents(spark, sf_dir)).drop("spans")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    common.ship(spark)
    return judge(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hist_sort import shard

    return shard(common.documents(spark, sf_dir))


def _list_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Captures and dated list entries, derived from `pages`: days and memberships come from digests of urls and domains."""
    from .list_join import host_of

    def number(x: Column) -> Column:
        return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")

    day = F.to_date(F.lit("2023-01-01"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = pages.select("page_id", "url", F.date_add(day, (number(F.col("url")) % 730).cast("int")).alias("fetched"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    base = hosts.select(F.array_join(F.slice(F.reverse(F.split("host", "\\.")), 1, 3), ".").alias("r")).select(F.array_join(F.reverse(F.split("r", "\\.")), ".").alias("host"))
    domains = hosts.union(base).distinct().select(F.col("host").alias("domain"), number(F.col("host")).alias("h")).where("h % 3 != 0")
    kinds = F.element_at(F.array(F.lit("malware"), F.lit("phishing"), F.lit("spam")), ((F.col("h") + F.col("x.k")) % 3 + 1).cast("int"))
    steps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(at).alias("at"), F.lit(on).alias("active")) for k, at, on in ((0, 0, True), (0, 200, False), (0, 320, True), (1, 90, True))))
    entries = domains.select("domain", "h", F.explode(steps).alias("x")).where("x.k = 0 or h % 2 = 0").select(
        kinds.alias("list"), "domain", F.date_add(day, (F.col("h") % 400 + F.col("x.at")).cast("int")).alias("day"), F.col("x.active").alias("active")
    )
    return captures, entries


def op4_temporal_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .list_join import judge

    return judge(*_list_tables(spark, sf_dir))


_OP4_SQL = r"""
with pages2 as (
  select page_id, lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#\\]*@)?(\[[^/?#\\\]]*\]|[^/?#\\:@\[\]]*?)\.*(?::[^/?#\\]*)?(?:[/?#\\]|$)', 1), '')) as host,
         cast(date '2023-01-01' + cast(cast('0x' || substr(md5(url), 1, 8) as bigint) % 730 as integer) as date) as fetched
  from pages),
hosts as (select distinct host from pages2 where host is not null),
names as (
  select host as domain from hosts
  union select array_to_string(list_slice(string_split(host, '.'), greatest(1, len(string_split(host, '.')) - 2), len(string_split(host, '.'))), '.') from hosts),
domains as (select domain, cast('0x' || substr(md5(domain), 1, 8) as bigint) as h from names),
steps(k, after_days, active) as (values (0, 0, true), (0, 200, false), (0, 320, true), (1, 90, true)),
entries as (
  select ['malware', 'phishing', 'spam'][cast((h + k) % 3 + 1 as integer)] as list, domain,
         cast(date '2023-01-01' + cast(h % 400 + after_days as integer) as date) as day, active
  from domains, steps where h % 3 != 0 and (k = 0 or h % 2 = 0)),
days as (select list, domain, day, bool_and(active) as active from entries where list is not null group by all),
changed as (select *, coalesce(lag(active) over (partition by list, domain order by day), false) as was from days),
spans as (
  select list, domain, since, until from (
    select list, domain, day as since, active, lead(day) over (partition by list, domain order by day) as until from changed where active != was) where active),
above as (
  select distinct host, fetched, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') as domain
  from pages2, unnest(range(1, if(regexp_matches(host, '^(\[.*|[0-9.]+)$'), 1, len(string_split(host, '.'))) + 1)) as t(i) where host is not null and fetched is not null),
found as (
  select host, fetched, string_agg(distinct list, ',' order by list) as lists, count(*) as n_entries
  from above join spans using (domain) where since <= fetched and (until is null or fetched < until) group by all)
select p.page_id, p.host, p.fetched, f.lists is not null as blocked, coalesce(f.lists, '') as lists, coalesce(f.n_entries, 0) as n_entries
from pages2 p left join found f on p.host = f.host and p.fetched = f.fetched
"""


def op6_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .length_buckets import pack

    return pack(common.documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import judge

    common.ship(spark)
    return judge(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nra_topk import search

    common.ship(spark)
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op8_piece_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .piece_encode import encode_digests

    common.ship(spark)
    return encode_digests(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .wavelet import FILE_SCHEMA, read_shards, write_shards

    common.ship(spark)
    path = common.shared_path(spark, "wavelet")
    write_shards(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2, path)
    common.passing(spark, path)
    return read_shards(spark.read.schema(FILE_SCHEMA).parquet(path))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import components

    common.ship(spark)
    return components(common.documents(spark, sf_dir))


def op11_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is the folder that the session names in `tidewater.token.cache`, kept from run to run, and else an empty one that goes with the driver."""
    import public_tokenizers

    from .digest_cache import count

    common.ship(spark)
    cache = spark.conf.get("tidewater.token.cache", None)
    if not cache:
        cache = common.shared_path(spark, "token-cache")
        common.passing(spark, cache)
    return count(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), cache)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import digests

    common.ship(spark)
    return digests(common.documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_OP13_SQL = r"""
with docs as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') as words from documents),
least as (select text, min(doc_id) as first_id from docs group by text),
told as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
failed as (
  select d.part, coalesce(t.good, 0) as good, coalesce(t.toxic, 0) as toxic,
         case when len(words) < 50 then 'A' else '' end || case when 100 * len(list_distinct(words)) < 65 * len(words) then 'B' else '' end
         || case when 100 * length(regexp_replace(d.text, '[^A-Z]+', '', 'g')) > 5 * length(d.text) then 'C' else '' end
         || case when regexp_matches(d.text, '[#$%&*|]') then 'D' else '' end || case when d.doc_id > l.first_id then 'E' else '' end as fails
  from docs d join least l on d.text = l.text left join told t on d.doc_id = t.doc_id),
counts as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by all),
letters(f) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps as (select filter_order, cast(step as integer) as step, substr(filter_order, step, 1) as f, substr(filter_order, 1, step - 1) as before from orders, unnest(range(1, 6)) as t(step)),
met as (
  select c.part, s.filter_order, s.step, s.f, contains(c.fails, s.f) as fails_it, c.fails = s.f as only_it,
         translate(c.fails, s.before, '') != c.fails as gone, c.n, c.good, c.toxic
  from counts c, steps s),
told_steps as (
  select part, filter_order, step, f,
         sum(case when not gone and not fails_it then n else 0 end) as kept, sum(case when not gone and fails_it then n else 0 end) as removed,
         sum(case when gone and fails_it then n else 0 end) as redundant, sum(case when only_it then n else 0 end) as unique_fails,
         sum(case when not gone and fails_it then good else 0 end) as good_lost, sum(case when not gone and fails_it then toxic else 0 end) as toxic_lost
  from met group by all)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
       cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, f) as bigint) as shapley
from told_steps
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_histogram_shards": op3_histogram_shards,
    "op4_temporal_list_join": op4_temporal_list_join,
    "op5_toxicity": op5_toxicity,
    "op6_length_buckets": op6_length_buckets,
    "op7_exact_topk": op7_exact_topk,
    "op8_piece_encode": op8_piece_encode,
    "op9_wavelet_shards": op9_wavelet_shards,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_digest_cache": op11_digest_cache,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_filter_audit": op13_filter_audit,
}

#: Only what DuckDB can say itself.
ORACLES: dict[str, str] = {"op4_temporal_list_join": _OP4_SQL, "op13_filter_audit": _OP13_SQL}
