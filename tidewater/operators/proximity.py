"""Terms stated near certain words: every match's place in whole texts, and pairs by distance in characters.

`located` finds all matches of all patterns in one pass over the texts (Arrow batches, white space collapsed); what lies
near what is then decided by windows over the matches of a document, in order of their places: the last word before and
the first word behind an anchor are enough, so no pairs are made. The patterns below are data, not code.

Defined results: null and empty texts have no matches, so documents without any are absent from `located` and null (or
false) in what is built on it; rows that share an identifier are read as one document each with its own places.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from datetime import date
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import number_word

# Words and phrases of filings, in Python's syntax, case ignored. Where many words begin a pattern their first letters are asked first, which is faster.
DATE = r"((?=[jfmasond])(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}\s*,\s*\d{4})"
MONEY = r"\$\s?(\d{1,2}\.\d{2,4})"
NUMBER = r"(\d{1,5}|[a-z]+(?:[- ](?:one|two|three|four|five|six|seven|eight|nine))?)"
REDEMPTION = r"(?=[rtc])(?:redeem\w*|redemption|trust account|conversion (?:amount|price|right))"
NOT_REDEMPTION = r"(?=[wesptoc])(?:warrant|exercise|strike|subscription|private placement|purchase price|offering price|per unit|earn-?out|trading price|closing price|equals or exceeds)"
#: What they begin with, as `located` wants it.
MONTHS, MONEY_BEGINS, REDEMPTION_BEGINS, NOT_REDEMPTION_BEGINS = "janu|febr|marc|apri|may|june|july|augu|sept|octo|nove|dece", "$#|$ #", "rede|trus|conv", "warr|exer|stri|subs|priv|purc|offe|per |earn|trad|clos|equa"
RANGE_WORDS = r"\brange\b|ranging|between|(?:no|not) (?:less|more|fewer|greater) than|up to|at least|as (?:low|high) as"


#: Kinds of characters that beginnings of patterns are told by: letters whatever their case, digits, space, $, - and comma; 0 is any other.
_CLASSES = {chr(97 + i): i + 1 for i in range(26)} | {"#": 27, " ": 28, "$": 29, "-": 30, ",": 31}
_LOOK = 4
#: Characters whose places are looked for at once; a longer text is read by itself.
_AT_ONCE = 1 << 20


_EPOCH, _NO_DAY = date(1970, 1, 1).toordinal(), -(1 << 31)
_MONTH_NUMBERS = {m: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)}


def _classes() -> bytes:
    """The class of each character of ASCII."""
    out = bytearray(256)
    for c, n in _CLASSES.items():
        for x in "0123456789" if c == "#" else c + c.upper():
            out[ord(x)] = n
    return bytes(out)


def _class_of(c: str) -> int:
    """Of a character beyond ASCII: patterns that ignore case take some for letters, and some are digits."""
    return 27 if c.isdecimal() else next((_CLASSES[x] for x in (c.lower()[0], c.upper()[0].lower()) if "a" <= x <= "z"), 0)


def _begun(begins: list[str]) -> np.ndarray:
    """For each four characters' classes in a row, a bit for each set of beginnings that they can be of."""
    out = np.zeros((32,) * _LOOK, np.uint32)
    for i, words in enumerate(begins):
        for word in words.split("|"):
            out[tuple(slice(None) if c == "." else _CLASSES[c] for c in word[:_LOOK])] |= np.uint32(1 << i)
    return out.ravel()


def _candidates(texts: list[str], table: np.ndarray, classes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, place in it and bits of the beginnings wherever there are any."""
    # a text ends in characters of no class, so that no beginning is seen across two texts
    whole = "\n\n\n\n".join((*texts, ""))
    if whole.isascii():
        c = np.frombuffer(whole.encode("ascii").translate(classes), np.uint8)
    else:
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        c = np.frombuffer(np.minimum(codes, 128).astype(np.uint8).tobytes().translate(classes), np.uint8).copy()
        beyond = np.flatnonzero(codes >= 128)
        told, which = np.unique(codes[beyond], return_inverse=True)
        c[beyond] = np.array([_class_of(chr(x)) for x in told], np.uint8)[which]
    two = (c[:-1].astype(np.uint16) << 5) | c[1:]
    bits = table[(two[:-2].astype(np.uint32) << 10) | two[2:]]
    at = np.flatnonzero(bits)
    begins = np.cumsum([0, *(len(t) + 4 for t in texts[:-1])])
    of = np.searchsorted(begins, at, "right") - 1
    return of, at - begins[of], bits[at]


def _matches(texts: list[str], p: re.Pattern, of: np.ndarray | None, at: np.ndarray | None) -> tuple[list, list, list, list]:
    """text, start, end, value of every match of `p`; where places are given it can begin at those only."""
    value = (lambda m: m[1] or m[0]) if p.groups == 1 else lambda m: next((g for g in m.groups() if g), m[0])
    if of is None:
        found = [(i, m) for i, t in enumerate(texts) for m in p.finditer(t)]
        return [i for i, _ in found], [m.start() for _, m in found], [m.end() for _, m in found], [value(m) for _, m in found]
    rows: tuple[list, list, list, list] = ([], [], [], [])
    texts_of, starts, ends, values = (x.append for x in rows)
    match, text, past = p.match, -1, 0
    for i, place in zip(of.tolist(), at.tolist(), strict=True):
        if i != text:
            text, past = i, 0
        if place >= past and (m := match(texts[i], place)):
            past = m.end()
            texts_of(i)
            starts(place)
            ends(past)
            values(value(m) if p.groups else m[0])
    return rows


@lru_cache(1 << 16)
def _written_day(value: str) -> int:
    """Days from 1970 to a date written as in `DATE`; `_NO_DAY` where there is no such day."""
    told = re.fullmatch(r"([a-z]+) ([0-9]{1,2}) ?, ?([0-9]{4})", value, re.IGNORECASE)
    try:
        return date(int(told[3]), _MONTH_NUMBERS[told[1].casefold()], int(told[2])).toordinal() - _EPOCH if told else _NO_DAY
    except (KeyError, ValueError):
        return _NO_DAY


def _least_step(of: np.ndarray, at: np.ndarray, none: int) -> np.ndarray:
    """From each place, in order, to the nearest other one in the same text."""
    step = np.where(np.diff(of) == 0, np.diff(at), none)
    alone = np.full(min(len(at), 1), none)
    return np.minimum(np.concatenate((alone, step)), np.concatenate((step, alone)))


def located(
    docs: DataFrame, patterns: dict[str, str | tuple[str, str]], ident: str = "doc_id", text: str = "text", near: dict[str, tuple[str, int, int]] | None = None,
    apart: str | None = None, kinds: Iterable[str] | None = None, more: Iterable[str] = (), days: Iterable[str] = (),
) -> DataFrame:
    """ident, kind, start, end, value (first group that matched, else the match): every match of each pattern (or of `kinds` only), places from 0.

    A pattern may come with its beginnings, which are faster to look for: the first characters (four count) of all that it can match, parted by |, in lower case, with # for a
    digit and a dot for any character. `near`: name -> (kind, before, after), a column: does a match of that kind begin at most `before` characters before the row's match and
    end at most `after` behind its end? `apart` names a column: characters between the beginnings of the row's match and of the nearest other of its kind, null if there is none.
    `more` columns of `docs` are kept. `days`: kinds whose value is a date as in `DATE`; it stands in a column `day`, null where there is no such day."""
    near, kinds, more, days = near or {}, list(kinds or patterns), list(more), set(days)
    read = docs.select(F.col(ident).alias("id"), F.xxhash64(F.col(text)).alias("row"), *more, F.col(text).cast("string").alias("text"))
    schema = StructType([*read.schema.fields[:-1]])
    for name, of_type in ({"kind": "string", "start": "integer", "end": "integer", "value": "string"} | dict.fromkeys(near, "boolean") | ({apart: "integer"} if apart else {}) | ({"day": "date"} if days else {})).items():
        schema = schema.add(name, of_type)
    plain = {k: p if isinstance(p, str) else p[0] for k, p in patterns.items()}
    begins = {k: p[1] for k, p in patterns.items() if not isinstance(p, str)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {k: re.compile(p, re.IGNORECASE) for k, p in plain.items()}
        table, classes = _begun(list(begins.values())), _classes()

        def read_texts(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [" ".join((t or "").split()) for t in batch.column(batch.num_columns - 1).to_pylist()]
            of, at, bits = _candidates(texts, table, classes)
            found = {}
            for kind, p in compiled.items():
                mine = (bits & np.uint32(1 << list(begins).index(kind))) != 0 if kind in begins else None
                i, start, end, value = _matches(texts, p, None if mine is None else of[mine], None if mine is None else at[mine])
                found[kind] = tuple(np.array(x, np.int64) for x in (i, start, end)) + (value,)
            # places in all texts one behind the other tell where they stand, and in which text
            wide = 1 + max(map(len, texts), default=0)
            i, start, end = (np.concatenate([found[k][n] for k in kinds]) for n in range(3))
            columns = [pa.array(kinds).take(pa.array(np.repeat(np.arange(len(kinds)), [len(found[k][0]) for k in kinds]))), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array([v for k in kinds for v in found[k][3]], pa.string())]
            for kind, before, after in near.values():
                oi, begin, finish, _ = found[kind]
                # matches of a kind don't overlap, so the first that doesn't begin too early is also the first to end
                j = np.searchsorted(oi * wide + begin, i * wide + np.maximum(start - before, 0))
                there = j < len(oi)
                j = np.where(there, j, 0)
                columns.append(pa.array(there & (oi[j] == i) & (finish[j] <= end + after) if len(oi) else np.zeros(len(i), bool)))
            if apart:
                least = np.concatenate([_least_step(*found[k][:2], none=wide) for k in kinds])
                columns.append(pa.array(least, pa.int32(), mask=least == wide))
            if days:
                told = np.array([d for k in kinds for d in (map(_written_day, found[k][3]) if k in days else [_NO_DAY] * len(found[k][3]))], np.int32)
                columns.append(pa.array(told, pa.int32(), mask=told == _NO_DAY).cast(pa.date32()))
            order = np.lexsort((start, i))
            at_doc, order = pa.array(i[order]), pa.array(order)
            return pa.RecordBatch.from_arrays([batch.column(n).take(at_doc) for n in range(batch.num_columns - 1)] + [c.take(order) for c in columns], names=schema.names)

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy()
            cut = np.flatnonzero(np.diff(np.cumsum(sizes) // _AT_ONCE, prepend=0))
            for low, high in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if high > low:
                    yield read_texts(batch.slice(low, high - low))

    # rows of one identifier are told apart by a digest of their text
    return read.mapInArrow(run, schema).withColumnRenamed("id", ident)


def _around(ident: str) -> tuple[Window, Window]:
    """Rows of a document up to the current one, seen from its beginning and from its end."""
    w = Window.partitionBy(ident, "row")
    return tuple(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0) for order in ((F.asc("start"), F.asc("end"), F.asc("kind")), (F.desc("start"), F.desc("end"), F.desc("kind"))))


def beside(kind: str, before: int, after: int, ident: str = "doc_id") -> Column:
    """On rows of `located` (several of these go in one `withColumns`, which sorts the matches twice for all of them): does a match of `kind` begin at most `before` characters before the row's match and end at most `after` behind its end?"""
    back, on = _around(ident)
    place = F.when(F.col("kind") == kind, F.struct("start", "end"))
    last, following = F.last(place, ignorenulls=True).over(back), F.last(place, ignorenulls=True).over(on)
    ok = [(x["start"] >= F.col("start") - before) & (x["end"] <= F.col("end") + after) for x in (last, following)]
    return F.coalesce(ok[0], F.lit(False)) | F.coalesce(ok[1], F.lit(False))


def distance_to_other(ident: str = "doc_id") -> Column:
    """On rows of `located`: characters between the beginnings of the row's match and of the nearest other match of its kind; null if there is none."""
    w = Window.partitionBy(ident, "row", "kind").orderBy("start")
    return F.least(F.col("start") - F.lag("start").over(w), F.lead("start").over(w) - F.col("start"))


def day(value: Column) -> Column:
    """A date written as in `DATE`; null where there is no such day."""
    return F.to_date(F.try_to_timestamp(F.initcap(F.regexp_replace(F.regexp_replace(value, r"\s*,\s*", ", "), r"\s+", " ")), F.lit("MMMM d, yyyy")))


def _more_and_earlier(count: str, place: str) -> Column:
    """What is larger for a larger count and, of equal counts, for an earlier place (whole numbers of 31 bits): one number, as aggregates by number need no sort."""
    return F.shiftleft(F.col(count).cast("long"), 31) + (2**31 - 1 - F.col(place))


def most_frequent(rows: DataFrame, by: list[str], value: str, place: str) -> DataFrame:
    """Per group the most frequent value; of equally frequent ones the one met first. Null is no value: a group of nulls has null."""
    c = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"), F.min(place).alias("_p"))
    return c.groupBy(*by).agg(F.max_by(value, F.when(F.col(value).isNotNull(), _more_and_earlier("_c", "_p"))).alias(value))


def chosen_ratios(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ratio, is_range per document that states 1-for-N ratios of a reverse split (N from 2 to 10,000).

    A ratio belongs to a range if range words stand up to 150 characters before it or 40 behind, or another ratio begins
    within 120. The most frequent ratio outside of ranges is the one chosen; with ranges only there is none."""
    # Patterns.
    found = located(docs, {
        "ratio": (rf"\b(?:1|one)[- ]for[- ]{NUMBER}\b", "#.fo|one."), "subject": (r"reverse|consolidat\w*|combin\w*", "reve|cons|comb"), "range": (RANGE_WORDS, "rang|betw|no |not |up t|at l|as l|as h"),
    }, ident, text, {"of": ("subject", 250, 250), "in": ("range", 150, 40)}, "apart", ["ratio"])
    n = F.coalesce(F.col("value").try_cast("int"), number_word(F.lower("value")))
    stated = found.where("of").withColumn("ratio", n).where("ratio between 2 and 10000")
    # a ratio of a range is counted under null, so that a document with ranges only is met too
    free = F.when(~F.col("in") & ~F.coalesce(F.col("apart") < 120, F.lit(False)), F.col("ratio"))
    best = most_frequent(stated.withColumn("ratio", free), [ident], "ratio", "start")
    return best.withColumn("is_range", F.col("ratio").isNull())


# Patterns of stated amounts, and the words that speak for one and against it.
_STATED = {
    "amount": (rf"{MONEY}\s*(?:per|for each)\s+(?:\w+\s+){{0,3}}?share", MONEY_BEGINS), "word": (REDEMPTION, REDEMPTION_BEGINS), "other": (NOT_REDEMPTION, NOT_REDEMPTION_BEGINS),
    "current": (rf"current\s+(?:conversion|redemption)\s+(?:amount|price)\s+(?:of\s+)?(?:approximately\s+)?{MONEY}", "curr"),
    "price": (rf"per\s?-?\s?share\s+(?:redemption\s+)?(?:price|amount)[^$]{{0,200}}?(?:redeem|redemption|trust)[^$]{{0,200}}?{MONEY}", "per |per-|pers"),
}


def _stated_near(before: int) -> dict[str, tuple[str, int, int]]:
    return {"_told": ("word", before, 60), "_against": ("other", 120, 40)}


def _with_amounts(found: DataFrame, low: float, high: float, kinds: Iterable[str] = ()) -> DataFrame:
    """With `_v`, the number of a stated amount (and of `kinds`), and `_use`: 0 for an amount called the current one, 1 for one of a price, 2 and 3 for one told with words of
    redemption; null for what is no stated amount."""
    v = F.col("_v")
    plain = (F.col("kind") == "amount") & F.col("_told") & ~F.col("_against")
    # a price's own words may stand far before it, so only what stands right before its figure speaks against it
    use = F.when(F.col("kind") == "current", 0).when(F.col("kind") == "price", 1).when(plain & (F.round(v * 100) % 100 != 0), 2).when(plain, 3)
    return found.withColumn("_v", F.when(F.col("kind").isin("amount", "current", "price", *kinds), F.col("value").try_cast("double"))).withColumn("_use", F.when(v.between(low, high), use))


def _stated(rows: str = "_rows", place: str = "_place") -> Column:
    """Of counted amounts: the most frequent of the best use, of equally frequent ones the one met first."""
    return F.max_by("_v", F.when(F.col("_use").isNotNull(), F.shiftleft((3 - F.col("_use")).cast("long"), 61) + _more_and_earlier(rows, place))).alias("stated_amount")


def redemption_amounts(docs: DataFrame, ident: str = "doc_id", text: str = "text", before: int = 250, low: float = 5.0, high: float = 12.5) -> DataFrame:
    """stated_amount per document: what a share is redeemed for.

    An amount called the current redemption or conversion amount comes first, then one that follows "per-share price ... redeem ...",
    then the most frequent amount per share with words of redemption up to `before` characters before it or 60 behind, amounts that are not
    whole before round ones. Amounts beside words of warrants, offers or prices (120 before, 40 behind) and outside [low, high] don't count."""
    found = located(docs, _STATED, ident, text, _stated_near(before), kinds=["amount", "current", "price"])
    d = _with_amounts(found, low, high).where("_use is not null")
    return d.groupBy(ident, "_use", "_v").agg(F.count(F.lit(1)).alias("_rows"), F.min("start").alias("_place")).groupBy(ident).agg(_stated())


# Patterns of terms, and of treatments below.
_MONTHS_TO = rf"within\s+(\d{{1,2}}|twelve|fifteen|eighteen|twenty[- ]one|twenty[- ]four)\s+months\s+(?:\([^)]{{0,200}}\)\s+)?(?:from|after|of)\s+(?:the\s+)?(?:closing|consummation|completion|date)"
_EXCHANGE = r"NYSE\s+(?:American|MKT|Amex)|New\s+York\s+Stock\s+Exchange|American\s+Stock\s+Exchange|NYSE|Nasdaq"


def _first(rows: DataFrame, ident: str, **kinds: str) -> DataFrame:
    """Per document the first value of each kind, under the names given."""
    return rows.groupBy(ident).agg(*(F.min_by(F.when(F.col("kind") == k, F.col("value")), F.when(F.col("kind") == k, F.struct("start", "end"))).alias(name) for name, k in kinds.items()))


def prospectus_terms(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: trust_per_share (the first amount per share or unit within 160 characters of the trust account; 9 to 11.5), deadline_months,
    symbol (of the units, without their U), exchange, and whether a unit holds a warrant or a right."""
    # Patterns.
    found = located(docs, {
        "amount": (rf"{MONEY}\s+per\s+(?:unit|share|public\s+share)", MONEY_BEGINS), "trust": (r"trust\s+account", "trus"), "months": (_MONTHS_TO, "with"), "exchange": (_EXCHANGE, "nyse|new |amer|nasd"),
        "symbol": (r"units?\b[^.]{0,200}?under\s+the\s+(?:ticker\s+)?symbol\s+[\"“]?\s*([A-Z]{2,6})\b", "unit"), "unit": (r"each\s+unit\s+(?:consists|will\s+consist|consisting)\s+of\s+([^.]{0,300})", "each"),
    }, ident, text, {"_near": ("trust", 160, 160)})
    kept = found.where((F.col("kind") != "amount") | F.col("_near"))
    t = _first(kept, ident, amount="amount", months="months", symbol="symbol", exchange="exchange", unit="unit")
    amount, months = F.col("amount").try_cast("double"), F.regexp_replace(F.lower("months"), " ", "-")
    symbol = F.upper("symbol")
    return t.select(
        ident, F.when(amount.between(9.0, 11.5), amount).alias("trust_per_share"), F.coalesce(F.col("months").try_cast("int"), number_word(months)).alias("deadline_months"),
        F.when(symbol.endswith("U") & (F.length(symbol) >= 4), F.regexp_replace(symbol, "U$", "")).otherwise(symbol).alias("symbol"), F.col("exchange"),
        F.coalesce(F.lower("unit").contains("warrant"), F.lit(False)).alias("has_warrant"), F.coalesce(F.lower("unit").rlike(r"\bright"), F.lit(False)).alias("has_right"),
    )


def meeting_terms(docs: DataFrame, ident: str = "doc_id", text: str = "text", form: str = "form") -> DataFrame:
    """Per proxy: kind of meeting, its date, whether holders may redeem, until when, and the stated amount.

    A deadline counts from ten days before the meeting to the meeting. A prospectus supplement (424B3) that speaks of no special or
    extraordinary meeting is no proxy: kind not_a_proxy and nothing else."""
    # Patterns.
    found = located(docs, {
        "held": (rf"(?:to\s+be\s+held|will\s+be\s+held|meeting\s+(?:of\s+\w+\s+)?on)[^.]{{0,120}}?{DATE}", "to b|will|meet"), "special": (r"special\s+meeting|extraordinary\s+general\s+meeting", "spec|extr"),
        "extension": (r"exten(?:d|sion)[^.]{0,120}(?:date|period|time|charter)", "exte"), "combination": (r"business\s+combination|merger\s+agreement", "busi|merg"),
        "right": (r"(?:right|opportunity|elect)\w*[^.]{0,80}redeem|redemption\s+rights?", "righ|oppo|elec|rede"), "until": (rf"(?:redeem|redemption|tender|deliver)[^.]{{0,250}}?(?:prior\s+to|before|by|no\s+later\s+than)[^.]{{0,60}}?{DATE}", "rede|tend|deli"),
    }, ident, text)
    t = _first(found, ident, held="held", special="special", extension="extension", combination="combination", right="right", until="until")
    d = docs.select(ident, F.col(form).alias("_form")).join(t, ident, "left").join(redemption_amounts(docs, ident, text), ident, "left")
    no_proxy = (F.col("_form") == "424B3") & F.col("special").isNull()
    kind = F.when(no_proxy, "not_a_proxy").when(F.col("_form").isin("DEFM14A", "424B3"), "business_combination").when(F.col("extension").isNotNull(), "extension").when(F.col("combination").isNotNull(), "business_combination").otherwise("annual")
    meeting, until = F.when(~no_proxy, day(F.col("held"))), day(F.col("until"))
    d = d.select(ident, kind.alias("kind"), meeting.alias("meeting"), until.alias("_until"), F.col("right").isNotNull().alias("_right"), F.when(~no_proxy, F.col("stated_amount")).alias("stated_amount"))
    return d.select(ident, "kind", "meeting", (F.col("_right") & ~F.col("kind").isin("annual", "not_a_proxy")).alias("redemption_right"), F.when(F.col("meeting").isNotNull() & F.col("_until").between(F.date_sub("meeting", 10), F.col("meeting")), F.col("_until")).alias("redeem_by"), "stated_amount")


def event_updates(docs: DataFrame, ident: str = "doc_id", text: str = "text", filed: str = "filed") -> DataFrame:
    """Per current report: the latest date a meeting was postponed to (within 120 days of filing), the latest date a deadline was extended to,
    whether it tells of a liquidation, on what day and for how much, and what redeeming holders were paid a share.

    What was paid is stated next to words of redemption (160 characters) without words of expectation (60); without one it is the most frequent
    amount near redemption, else dollars over shares redeemed, where that is 5 to 12.5."""
    # Patterns.
    own = {
        "postponed": (rf"(?:postpone|adjourn|reschedul|reconven)\w*[^.]{{0,300}}?(?:to|until|on|for)\s+(?:\w+day,\s+)?{DATE}", "post|adjo|resc|reco"),
        "extended": (rf"(?:approved|extended|elected\s+to\s+extend)[^.]{{0,60}}?exten[^.]{{0,400}}?(?:to|until|through)\s+{DATE}|extended[^.]{{0,400}}?(?:to|until|through)\s+{DATE}", "appr|exte|elec"),
        "liquidation": (r"will\s+not\s+(?:be\s+able\s+to\s+)?(?:consummate|complete)\s+(?:an|its|a)\s+(?:initial\s+)?business\s+combination|redeem\s+all\s+(?:of\s+)?(?:the\s+|its\s+)?outstanding|dissol\w+\s+and\s+liquidat\w*|wind[\s-]up", "will|rede|diss|wind"),
        "redeemed_on": (rf"(?:be|been|were|was)\s+redeemed\s+(?:on|as\s+of)\s+(?:or\s+about\s+)?(?:\w+day,\s+)?{DATE}", "be r|been|were|was "), "dated": (rf"(?:on\s+or\s+about|as\s+of|on|effective)\s+(?:\w+day,\s+)?{DATE}", "on |as o|effe"),
        "liquidation_amount": (rf"per[- ]share\s+(?:redemption|liquidation)\s+(?:price|amount)[^$]{{0,120}}?{MONEY}", "per |per-"),
        "paid": (rf"{MONEY}\s*(?:per|for\s+each)", MONEY_BEGINS), "paid_word": (r"redeemed|redemption\s+(?:price|amount|payment)|conversion\s+amount|right\s+to\s+redeem", "rede|conv|righ"),
        "expected": (r"will\s+be\s+approximately|would\s+be|anticipate\w*|expect\w*|estimate\w*", "will|woul|anti|expe|esti"), "other": _STATED["other"],
        "total": (r"([\d,]+\s+(?:\w+\s+){0,4}?shares[^.]{0,250}?(?:redeem|redemption|tendered)[^.]{0,250}?\$\s?[\d,]+(?:\.\d+)?(?:\s*million)?)", "#|,"),
    }
    near = {"_paid": ("paid_word", 160, 0), "_expected": ("expected", 60, 0), "_other": ("other", 120, 30), "_over": ("liquidation", 1500, 1500)} | _stated_near(300)
    # the stated amounts are found in the same reading of the texts
    found = located(docs.withColumn("_filed", F.col(filed).cast("date")), own | _STATED, ident, text, near, kinds=[k for k in own | _STATED if k != "word"], more=["_filed"], days=["postponed", "extended", "redeemed_on", "dated"])
    d = _with_amounts(found, 5.0, 12.5, ["liquidation_amount", "paid"])
    on = F.col("day")

    def of(kind: str, rule: Column, value: Column) -> Column:
        return F.when((F.col("kind") == kind) & rule, value)

    shares = F.regexp_replace(F.regexp_extract("value", r"^([\d,]+)", 1), ",", "").try_cast("double")
    dollars = F.regexp_replace(F.regexp_extract("value", r"\$\s?([\d,]+(?:\.\d+)?)", 1), ",", "").try_cast("double") * F.when(F.col("value").rlike("(?i)million$"), 1e6).otherwise(1.0)
    each = F.when(shares > 0, dollars / shares)
    amount, paid, whole = F.col("_v").between(5, 12.5), F.col("_v").between(5, 12.5) & F.col("_paid") & ~F.col("_expected") & ~F.col("_other"), each.between(5, 12.5)
    firsts = {"_amount": ("liquidation_amount", amount, F.col("_v")), "_per": ("paid", paid, F.col("_v")), "_whole": ("total", whole, F.round(each, 4))}
    # once for each stated amount of a document and once for all else, then once a document
    c = d.groupBy(ident, "_use", F.when(F.col("_use").isNotNull(), F.col("_v")).alias("_v")).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("start").alias("_place"), F.max(F.col("kind").isin(*own)).alias("_own"),
        F.max(of("postponed", (on > F.col("_filed")) & (on <= F.date_add("_filed", 120)), on)).alias("postponed_to"), F.max(of("extended", on > F.col("_filed"), on)).alias("extended_to"),
        F.max(F.col("kind") == "liquidation").alias("liquidation"), F.max(of("redeemed_on", on >= F.col("_filed"), on)).alias("_redeemed"), F.min(of("dated", (on >= F.col("_filed")) & F.col("_over"), on)).alias("_dated"),
        *(F.min_by(value, of(kind, rule, F.col("start"))).alias(name) for name, (kind, rule, value) in firsts.items()), *(F.min(of(kind, rule, F.col("start"))).alias(f"{name}_at") for name, (kind, rule, _) in firsts.items()),
    )
    g = c.groupBy(ident).agg(*(F.max(n).alias(n) for n in ("_own", "postponed_to", "extended_to", "liquidation", "_redeemed")), F.min("_dated").alias("_dated"), *(F.min_by(n, f"{n}_at").alias(n) for n in firsts), _stated()).where("_own")
    gone = F.col("liquidation")
    return g.select(ident, "postponed_to", "extended_to", gone, F.when(gone, F.coalesce("_redeemed", "_dated")).alias("liquidation_date"), F.when(gone, F.col("_amount")).alias("liquidation_amount"), F.coalesce("_per", "stated_amount", "_whole").alias("per_share"))


def offer_details(docs: DataFrame, ident: str = "doc_id", text: str = "text", filed: str = "filed") -> DataFrame:
    """Per offer: the day it expires (the first date on or after the filing that stands up to 250 characters behind a word of expiring), the odd-lot
    threshold (stated up to 1,500 characters behind a mention of odd lots), whether odd lots come first, whether only they are bought, and the security."""
    kinds = ["notes", "options", "warrants", "preferred", "units", "rights", "common"]
    # Patterns.
    found = located(docs.withColumn("_filed", F.col(filed).cast("date")), {
        "day": (DATE, MONTHS), "expires": (r"expire[sd]?\b|expiration", "expi"), "odd": (r"odd[\s\-]*lots?\b", "odd"), "fewer": (r"(?:fewer|less)\s+than\s+(\d{2,4}|one\s+hundred)\s+(?:\(\d+\)\s+)?(?:[\w-]+\s+){0,3}?(?:shares|units)", "fewe|less"),
        "first": (r"priority|before\s+proration|not\s+be\s+subject\s+to\s+proration|without\s+(?:regard\s+to\s+)?proration|accept\s+for\s+purchase\s+all", "prio|befo|not |with|acce"),
        "only": (r"held\s+by\s+(?:holders|stockholders|shareholders)\s+of\s+(?:\d{2,3}|ninety-nine)\s+or\s+fewer|odd[\s-]*lot\s+tender\s+offer", "held|odd"),
        "notes": (r"\bnotes?\b|debenture|\bbonds?\b", "note|debe|bond"), "options": (r"\boptions?\b", "opti"), "warrants": (r"warrants?", "warr"), "preferred": (r"preferred|preference", "pref"), "units": (r"\bunits\b", "unit"), "rights": (r"\brights\b", "righ"),
        "common": (r"common|ordinary|shares|stock|beneficial\s+interest", "comm|ordi|shar|stoc|bene"), "title": (r"offer\s+to\s+(?:purchase|exchange)", "offe"),
    }, ident, text, {"_expires": ("expires", 250, 0), "_odd": ("odd", 1500, 0), "_close": ("odd", 200, 120), "_titled": ("title", 600, 0)}, more=["_filed"], days=["day"])
    threshold = F.when(F.lower("value").contains("hundred"), 100).otherwise(F.col("value").try_cast("int"))
    g = found.groupBy(ident).agg(
        F.min_by("day", F.when((F.col("kind") == "day") & F.col("_expires") & (F.col("day") >= F.col("_filed")), F.col("start"))).alias("expires"),
        F.min_by(threshold, F.when((F.col("kind") == "fewer") & F.col("_odd"), F.col("start"))).alias("odd_lot"),
        F.coalesce(F.max((F.col("kind") == "first") & F.col("_close")), F.lit(False)).alias("_first"), F.max(F.col("kind") == "only").alias("odd_lot_only"),
        *(F.max((F.col("kind") == k) & F.col("_titled")).alias(f"_{k}") for k in kinds),
    )
    security = F.lit("other")
    for k in reversed(kinds):
        security = F.when(F.col(f"_{k}"), k).otherwise(security)
    return g.select(ident, "expires", "odd_lot", (F.col("_first") & F.col("odd_lot").isNotNull()).alias("odd_lot_priority"), "odd_lot_only", security.alias("security"))


#: Treatments of fractional shares, in the order in which a sentence is read.
TREATMENTS = ("ROUNDUP_PARTICIPANT", "MIXED", "ROUNDUP_HOLDER", "CASH", "DOWN")
_UP, _CASH, _DOWN = r"(?i)round(?:ed|ing)?\s+up|next\s+(?:higher\s+)?whole\s+(?:share|number)", r"(?i)\bcash\b", r"(?i)round(?:ed|ing)?\s+down|(?:cancel|disregard)\w*\s+without"
_PARTICIPANT = r"(?i)participant\s+level|(?:holders?|stockholders?|shareholders?)\s+of\s+record|(?:record|registered)\s+(?:holders?|stockholders?|shareholders?)"
_CASHED_OUT = r"(?i)reverse\s*/\s*forward|reverse\s+(?:stock\s+)?split\s+(?:immediately\s+)?followed\s+by\s+a\s+forward|cashed[\s-]+out|cash[\s-]+out\s+(?:of\s+)?(?:fractional|holders|stockholders|shareholders)"


def fraction_treatment(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """treatment per document that speaks of fractional shares, by a vote of its sentences.

    Sentences about options, warrants, notes or mergers have no vote; "to the nearest" is no rounding up; "Instead ..." takes the holders of record of the
    sentence before it. Rounding up for participants anywhere makes all rounding up one for participants. The class told at least twice as often as all
    others together wins, else UNKNOWN. A reverse split followed by a forward split, or a cash-out of holders, is CASH whatever the sentences say."""
    from .text import sentences

    s = sentences(docs.select(ident, F.col(text).alias("text")), ident)
    before = F.lag("sentence").over(Window.partitionBy(ident).orderBy("n"))
    x = F.col("sentence")
    d = s.withColumn("_before", before).where(x.rlike(r"(?i)fraction") & ~x.rlike(r"(?i)\b(?:options?|awards?|warrants?|notes|spin-?off|merger)\b"))
    up = x.rlike(_UP) & ~(x.rlike(r"(?i)round(?:ed|ing)?\s+(?:off\s+)?to\s+the\s+nearest") & ~x.rlike(r"(?i)round(?:ed|ing)?\s+up(?:ward)?\s+to"))
    nearest = x.rlike(_UP) & ~up
    cash = x.rlike(_CASH) & ~x.rlike(r"(?i)\b(?:no|not|without)\b[^.]{0,40}\bcash\b")
    part = x.rlike(_PARTICIPANT) | (x.rlike(r"(?i)^\s*(?:instead|rather|in\s+lieu)") & F.coalesce(F.col("_before").rlike(_PARTICIPANT) & F.col("_before").rlike("(?i)fraction"), F.lit(False)))
    kind = F.when(nearest, F.lit(None)).when(up & part, TREATMENTS[0]).when(up & cash, TREATMENTS[1]).when(up, TREATMENTS[2]).when(cash, TREATMENTS[3]).when(x.rlike(_DOWN), TREATMENTS[4])
    votes = d.withColumn("kind", kind).where("kind is not null").groupBy(ident).agg(*(F.sum((F.col("kind") == k).cast("int")).alias(k) for k in TREATMENTS))
    one = F.col(TREATMENTS[0]) > 0
    only_up = (F.col("MIXED") + F.col("CASH") + F.col("DOWN")) == 0
    n = {TREATMENTS[0]: F.when(one & only_up, F.col(TREATMENTS[0]) + F.col(TREATMENTS[2])).otherwise(F.col(TREATMENTS[0])), TREATMENTS[2]: F.when(one & only_up, F.lit(0)).otherwise(F.col(TREATMENTS[2]))}
    n |= {k: F.col(k) for k in ("MIXED", "CASH", "DOWN")}
    total = sum(n.values(), F.lit(0))
    won = F.lit("UNKNOWN")
    for k in ("DOWN", "CASH", TREATMENTS[2], TREATMENTS[0]):
        won = F.when((n[k] > 0) & (n[k] >= 2 * (total - n[k])), k).otherwise(won)
    told = votes.select(ident, won.alias("_won"))
    out = docs.select(ident, F.coalesce(F.col(text).rlike(_CASHED_OUT), F.lit(False)).alias("_out")).join(told, ident, "left")
    return out.select(ident, F.when(F.col("_out"), "CASH").otherwise(F.coalesce("_won", F.lit("UNKNOWN"))).alias("treatment"))
