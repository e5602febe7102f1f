"""Extraction over tables of pages and documents: native regular expressions, one row per document or sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import html_text
from .joins import session_of


def page_texts(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", html_text(F.col("html")).alias("text"))


def parts(containers: DataFrame, dropped: tuple[str, ...] = ("GRAPHIC", "ZIP", "XML", "EXCEL", "PDF")) -> DataFrame:
    """id, part, type, body of each <DOCUMENT> of a container; parts of the dropped types, or uuencoded, are left out."""
    found = containers.select("id", F.posexplode(F.expr(r"regexp_extract_all(text, '(?s)<DOCUMENT>(.*?)</DOCUMENT>', 1)")).alias("part", "doc"))
    out = found.select("id", "part", F.upper(F.trim(F.regexp_extract("doc", r"<TYPE>\s*([^\r\n<]+)", 1))).alias("type"), F.regexp_extract("doc", r"(?s)<TEXT>(.*?)</TEXT>", 1).alias("body"))
    return out.where(~F.col("type").isin(list(dropped)) & ~F.col("body").rlike(r"(?m)^begin \d{3} "))


def main_part(parts_: DataFrame, wanted: str, negative: str, look: int | None = 5000) -> DataFrame:
    """The longest part of each container whose first `look` characters (all, if None) match `wanted` before any `negative`: what a part is stands at its
    beginning, and what it cites stands further down."""
    head = F.substring("body", 1, look) if look else F.col("body")
    at, no = F.regexp_instr(head, F.lit(wanted)), F.regexp_instr(head, F.lit(negative))
    ok = parts_.where((at > 0) & ((no == 0) | (at < no)))
    w = Window.partitionBy("id").orderBy(F.desc(F.length("body")), "part")
    return ok.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


ABBREVIATIONS = "Inc Corp Co Ltd No Nos Mr Mrs Ms Dr St U.S vs approx"


def sentences(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, n, sentence: cut behind . ; ! or ? and space before a capital, not behind common abbreviations."""
    safe = F.regexp_replace(text, r"\b(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS.split()) + r")\.\s+", "$1.\u0001")
    cut = F.split(safe, r"(?<=[.;!?])\s+(?=\p{Lu})|\n+")
    each = docs.select(ident, F.posexplode(F.transform(cut, lambda s: F.trim(F.regexp_replace(s, "\u0001", " ")))).alias("n", "sentence"))
    return each.where("sentence <> ''")


def classified(sents: DataFrame, ident: str, rules: dict[str, str], context: bool = True) -> DataFrame:
    """Sentences with the first class whose pattern they match, in the order of `rules`; a sentence without one takes its predecessor's
    match, if `context`, when it begins with a pronoun."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(rules.items()):
        kind = F.when(F.col("sentence").rlike(pattern), name).otherwise(kind)
    df = sents.withColumn("kind", kind)
    if context:
        before = F.lag("kind").over(Window.partitionBy(ident).orderBy("n"))
        df = df.withColumn("kind", F.coalesce("kind", F.when(F.col("sentence").rlike(r"^(?i)(this|these|it|such|they)\b"), before)))
    return df


def ratios(sents: DataFrame, ident: str) -> DataFrame:
    """Per document the most frequent 1-for-N ratio (2..10000) and whether a sentence speaks of a range."""
    pattern = r"(?i)\b(?:1|one)[- ]for[- ](\d{1,5}|[a-z]+(?:-[a-z]+)?)\b"
    from ..functions.scalar import number_word

    found = sents.select(ident, F.explode(F.expr(f"regexp_extract_all(sentence, '{pattern}', 1)".replace("\\", "\\\\"))).alias("raw"), F.col("sentence").rlike(r"(?i)\b(range|between|ranging|up to)\b").alias("range"))
    n = found.withColumn("ratio", number_word(F.col("raw"))).where("ratio between 2 and 10000")
    c = n.groupBy(ident, "ratio").agg(F.count(F.lit(1)).alias("c"), F.max("range").alias("range"))
    g = c.groupBy(ident).agg(F.max_by("ratio", F.struct("c", -F.col("ratio"))).alias("ratio"), F.max("range").alias("is_range"), F.count(F.lit(1)).alias("kinds"))
    return g.select(ident, "ratio", (F.col("is_range") | (F.col("kinds") > 1)).alias("is_range"))


def cancellations(sents: DataFrame, ident: str) -> DataFrame:
    """Documents with a sentence that decides against, without a conditional word."""
    decided = F.col("sentence").rlike(r"(?i)\b(has|have|had|was|were|been)\b.{0,60}\b(terminat|abandon|cancel|withdr)") & ~F.col("sentence").rlike(r"(?i)\b(if|may|might|could|unless|would|in the event)\b")
    return sents.where(decided).groupBy(ident).agg(F.min("n").alias("sentence_n"))


def offer_terms(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Price or price range, quantity, odd-lot threshold, CUSIP and ticker of an offer, null where not found."""
    t = F.col(text)
    money = r"\$\s?(\d+(?:\.\d+)?)"
    get = lambda p, i=1: F.nullif(F.regexp_extract(t, p, i), F.lit(""))
    low, high = get(rf"(?i)(?:not (?:less|lower) than|between)\s+{money}").cast("double"), get(rf"(?i)(?:not (?:greater|more|higher) than|and)\s+{money}\s+per share").cast("double")
    return docs.select(
        ident, get(rf"(?i)(?:purchase price of|price of|at)\s+{money}\s+per share").cast("double").alias("price"), low.alias("low"), high.alias("high"),
        F.regexp_replace(get(r"(?i)up to\s+([\d,]+)\s+(?:shares|of its)"), ",", "").cast("long").alias("quantity"),
        get(r"(?i)fewer than\s+(\d+)\s+shares").cast("int").alias("odd_lot"), get(r"\b([0-9A-Z]{6}[0-9]{2}[0-9])\b").alias("cusip"), get(r"(?i)symbol\s+[\"“]?([A-Z]{1,5})\b").alias("ticker"),
    )


def coverage_audit(parsed: DataFrame, truth: DataFrame, key: str, value: str, by: Column) -> DataFrame:
    """Share of the truth's rows that were parsed, and of those that agree, per group."""
    j = truth.select(key, F.col(value).alias("_t"), by.alias("grp")).join(parsed.select(key, F.col(value).alias("_p")), key, "left")
    return j.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("_p").isNotNull(), 1.0).otherwise(0.0)).alias("parsed"), F.avg(F.when(F.col("_p").isNotNull(), (F.col("_p") == F.col("_t")).cast("double"))).alias("agree"))


def constituents(pages: DataFrame, ident: str, text: str, templates: tuple[str, ...] = ("NYSE", "NyseSymbol", "Nasdaq", "NasdaqSymbol", "BATS", "NYSEAmerican", "BATSSymbol")) -> DataFrame:
    """ident, symbol, plausible: tickers of the symbol templates in a page, each once, before its section of changes. A page with fewer
    than 100 of them also gives those in bare cells; `plausible` says whether it has 400 to 520 in all."""
    body = F.split(F.col(text), r"(?i)==\s*(?:selected |recent )?changes", 2)[0]
    find = lambda p: F.array_distinct(F.transform(F.regexp_extract_all("_body", F.lit(p), F.lit(1)), lambda x: F.replace(x, F.lit("."), F.lit("-"))))
    named = find(r"(?i:\{\{\s*(?:" + "|".join(templates) + r")\s*\|\s*)([A-Z][A-Z.\-]{0,6})\s*(?:\||\}\})")
    bare = find(r"(?m)^\|\s*([A-Z]{1,5}(?:\.[A-Z])?)\s*$")
    found = pages.withColumn("_body", body).withColumn("_named", named)
    found = found.withColumn("_all", F.when(F.size("_named") < 100, F.array_union("_named", bare)).otherwise(F.col("_named")))
    return found.select(ident, F.explode("_all").alias("symbol"), F.size("_all").between(400, 520).alias("plausible"))


_MONTH = "(January|February|March|April|May|June|July|August|September|October|November|December)"


def effective_dates(docs: DataFrame, calendar: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, stated, effective: the first date that follows words of taking effect, in the order of the patterns; "after the close" moves it to the next session."""
    t = F.col(text)
    day = rf"{_MONTH}\s+(\d{{1,2}}),\s+(\d{{4}})"
    patterns = [rf"(?i)effective (?:as of|on|at)[^.]{{0,80}}?{day}", rf"(?i)(?:become|becomes|became) effective[^.]{{0,80}}?{day}", rf"(?i)begin trading[^.]{{0,80}}?{day}"]
    stated = F.coalesce(*(F.to_date(F.try_to_timestamp(F.nullif(F.concat_ws(" ", *(F.regexp_extract(t, p, i) for i in (1, 2, 3))), F.lit("  ")), F.lit("MMMM d yyyy"))) for p in patterns))
    late = t.rlike(r"(?i)after (?:the )?(?:market )?close|close of (?:business|trading)")
    d = docs.select(ident, stated.alias("stated"), F.coalesce(late, F.lit(False)).alias("_late")).where("stated is not null")
    for name, strict in (("_on", False), ("_after", True)):
        d = session_of(d, calendar, "stated", name, ahead=True, strict=strict)
    days = calendar.select(F.col("dt").alias("effective"), F.col("day_index").cast("int").alias("_i"))
    d = d.withColumn("_i", F.when(F.col("_late"), F.col("_after")).otherwise(F.col("_on"))).join(days, "_i", "left")
    return d.groupBy(ident, "stated").agg(F.min("effective").alias("effective"))


# Words of the names of funds and other pooled vehicles, and of the reasons for which an index drops a small company.
FUND_WORDS = (
    "FUND", "PORTFOLIO", "MULTI-STRATEGY", "MULTI STRATEGY", "ABSOLUTE RETURN", "HEDGE", "MASTER", "INTERVAL", "ALTERNATIVE", "INCOME", "CREDIT", "LENDING", "PRIVATE EQUITY",
    "INFRASTRUCTURE", "INVESTMENT CORP", "BUSINESS DEVELOPMENT", "BDC", "REIT", "REAL ESTATE", "PROPERTIES", "TRUST",
)
SIZE_REASONS = ("market cap", "representative")


def fund_like(name: Column) -> Column:
    """Does a name hold a word of funds anywhere, or a partnership's or company's form as a word of its own? Case counts for neither; null names do not."""
    upper = F.upper(name)
    anywhere = upper.rlike("|".join(FUND_WORDS))
    form = upper.rlike(r"(^|[^A-Z0-9])(L\.?P\.?|LLC)($|[^A-Z0-9])")
    return F.coalesce(anywhere | form, F.lit(False))


def offers_worth_reading(filings: DataFrame, known: Column, name: str = "company", form: str = "form", filer: str = "cik", original: str = "SC TO-I") -> DataFrame:
    """Original filings by filers that are known or don't look like funds, and every amendment by the same filers."""
    first = filings.where((F.col(form) == original) & (F.coalesce(known, F.lit(False)) | ~fund_like(F.col(name))))
    amendments = filings.where(F.col(form) == f"{original}/A").join(first.select(filer).distinct(), filer, "left_semi").select(filings.columns)
    return first.unionByName(amendments)


def dropped_for_size(changes: DataFrame, removed: str, reason: str) -> DataFrame:
    """Index changes that removed a company for its size, with `symbol` in the spelling of the bars (no dots)."""
    told = F.lower(F.coalesce(reason, F.lit("")))
    small = told.contains(SIZE_REASONS[0]) | told.contains(SIZE_REASONS[1])
    return changes.where(F.col(removed).isNotNull() & small).withColumn("symbol", F.trim(F.replace(F.col(removed), F.lit("."), F.lit("-"))))
