"""Timelines against plain walks over sorted rows."""

import random
from bisect import bisect_left, bisect_right
from datetime import date, timedelta

from pyspark.sql import functions as F

from tidewater.operators import timelines

FIRST = date(2017, 6, 1)
SESSIONS = [d for d in (FIRST + timedelta(n) for n in range(420)) if d.weekday() < 5]


def calendar(spark):
    return spark.createDataFrame(list(enumerate(SESSIONS)), "day_index int, dt date")


def settle(d):
    return 3 if d < date(2017, 9, 5) else 2 if d < date(2024, 5, 28) else 1


def ahead(d, n):
    return SESSIONS[min(max(bisect_left(SESSIONS, d) + n, 0), len(SESSIONS) - 1)]


def some_day(rng, a=0, b=400):
    return FIRST + timedelta(rng.randrange(a, b))


FILING = "event int, usable date, acc string, form string, treatment string, ratio int, ratio_is_range boolean, effective date, cancel boolean"


def filings_of(rng, events):
    rows = []
    for e in range(events):
        start = rng.randrange(20, 200)
        for _ in range(rng.randint(0, 7)):
            usable = ahead(FIRST + timedelta(start + rng.randrange(60)), 0)
            rows.append((e, usable, f"a{rng.randrange(1000):03d}", rng.choice(["8-K", "8-K/A", "DEFM14A", "PRE 14A"]), rng.choice(["UNKNOWN", "ROUNDUP_HOLDER", "ROUNDUP_HOLDER", "ROUNDUP_PARTICIPANT", "CASH"]),
                         rng.choice([None, 10, 10, 10, 20]), rng.random() < 0.1, rng.choice([None, FIRST + timedelta(start + rng.randrange(30, 80))]), rng.random() < 0.08))
    return rows


def walk(rows, rule, t):
    k = {"treatment": "UNKNOWN", "ratio": None, "effective": None, "announced": None, "cancelled": False}
    for _, usable, _, form, treatment, ratio, is_range, effective, cancel in sorted(rows, key=lambda r: (r[1], r[2])):
        if usable > t:
            break
        said = form.startswith("8-K") or (rule == "v2" and form in ("DEFM14A",))
        ratio = ratio if said and not is_range else None
        k["cancelled"] |= cancel and (rule == "v1" or k["announced"] is not None)
        if treatment != "UNKNOWN":
            k["treatment"] = treatment
        k["ratio"], k["effective"] = ratio or k["ratio"], effective or k["effective"]
        if k["announced"] is None and ratio and effective:
            k["announced"] = usable
    return k


def test_terms_known_on_each_day(spark):
    rng = random.Random(1)
    rows = [r for r in filings_of(rng, 40)]
    rows = list({(r[0], r[1], r[2]): r for r in rows}.values())
    for rule in ("v1", "v2"):
        got = timelines.known_terms(spark.createDataFrame(rows, FILING), rule).collect()
        assert {(r.event, r.usable) for r in got} == {(r[0], r[1]) for r in rows} and len(got) == len({(r[0], r[1]) for r in rows})
        for r in got:
            k = walk([x for x in rows if x[0] == r.event], rule, r.usable)
            assert (r.treatment, r.ratio, r.effective, r.announced, r.cancelled) == tuple(k.values())


def payoff(event, rows, quotes, rule):
    _, symbol, split_on, n = event
    own = [r for r in rows if r[0] == event[0]]
    bids = sorted((d, b) for (s, d), (b, _) in quotes.items() if s == symbol and b is not None)
    for d in (x for x in SESSIONS if x < split_on):
        k = walk(own, rule, d)
        if not k["announced"] or d < k["announced"] or not k["effective"] or k["cancelled"]:
            continue
        after = SESSIONS[min(SESSIONS.index(d) + 1, len(SESSIONS) - 1)]
        if ahead(d, settle(d)) < k["effective"] <= ahead(after, settle(after)):
            break
    else:
        return None
    ask = quotes.get((symbol, d), (None, None))[1]
    if k["treatment"] not in timelines.ROUND_UP or ask is None:
        return None
    for _, usable, _, form, treatment, ratio, is_range, effective, cancel in sorted(own, key=lambda r: (r[1], r[2])):
        ratio = ratio if (form.startswith("8-K") or (rule == "v2" and form == "DEFM14A")) and not is_range else None
        if d < usable < split_on and (cancel or (ratio and ratio != k["ratio"]) or (effective and effective != k["effective"]) or treatment in ("CASH", "DOWN")):
            sold = next(((x, b) for x, b in bids if x >= usable), None)
            if sold and sold[0] < split_on:
                return (event[0], d, "changed", sold[0], sold[1], sold[1], False)
    sold = next(((x, b) for x, b in bids if x >= split_on), None)
    return sold and (event[0], d, "split", sold[0], sold[1], sold[1] / n, ahead(d, settle(d)) >= split_on)


def test_split_entries_and_payoffs(spark):
    rng = random.Random(2)
    rows = list({(r[0], r[1], r[2]): r for r in filings_of(rng, 120)}.values())
    events = [(e, f"S{e % 20}", ahead(max([r[7] for r in rows if r[0] == e and r[7]], default=some_day(rng)) + timedelta(rng.choice([0, 0, 0, 3, -4, 10])), 0), 10) for e in range(120)]
    quotes = {(f"S{s}", d): ((None if rng.random() < 0.1 else round(2 + rng.random(), 2)), None if rng.random() < 0.05 else round(3 + rng.random(), 2)) for s in range(20) for d in SESSIONS[:280]}
    q = spark.createDataFrame([(s, d, *x) for (s, d), x in quotes.items()], "symbol string, dt date, bid double, ask double")
    seen = set()
    for rule in ("v1", "v2"):
        got = timelines.split_payoffs(spark.createDataFrame(events, "event int, symbol string, split_on date, ratio int"), spark.createDataFrame(rows, FILING), q, calendar(spark), rule).collect()
        want = sorted(x for x in (payoff(e, rows, quotes, rule) for e in events) if x)
        assert sorted((r.event, r.entry_on, r.exit, r.exit_on, r.rounded, r.cash, r.settle_miss) for r in got) == want and want
        seen |= {(x[2], x[6]) for x in want}
    assert seen >= {("split", False), ("changed", False)}


def test_break_even_lies_where_profit_is_nothing(spark):
    rows = [("split", 6.0, 5.0, 6.0 / 20, False), ("split", 6.0, 5.0, 0.3, True), ("changed", 4.0, 5.0, 4.0, False)]
    d = spark.createDataFrame(rows, "exit string, rounded double, ask double, cash double, settle_miss boolean")
    first, missed, changed = timelines.split_value(d, F.lit(0.5)).collect()
    assert abs(first.break_even_p - 4.7 / 5.7) < 1e-12 and abs(first.expected_profit - (0.5 * 1.0 + 0.5 * -4.7)) < 1e-12
    assert missed.expected_profit == -4.7 and changed.expected_profit == -1.0 and changed.break_even_p is None
    at = timelines.split_value(d.limit(1), F.lit(first.break_even_p)).first()
    assert abs(at.expected_profit) < 1e-12


def tender(deal, moves, px, variant):
    name, symbol, filed, expires, outcome, price, final, ended, paid = deal
    first = bisect_right(SESSIONS, filed)
    if first >= len(SESSIONS):
        return None
    i = first
    if variant == "E2":
        if not expires:
            return None
        until = expires
        while True:
            k = max(bisect_right(SESSIONS, until) - 1, 0)
            i = max(k - settle(SESSIONS[max(k, 0)]) - 2, first)
            i = max(k - settle(SESSIONS[i]) - 2, first)
            known = max([expires] + [to for at, to in moves if at < SESSIONS[i]])
            if known <= until:
                break
            until = known
        if ended and ended <= SESSIONS[i]:
            return None
    bars = [(d, *px[symbol, d]) for d in SESSIONS if (symbol, d) in px]
    entry = next(((d, c, f) for d, c, _, f in bars if d >= SESSIONS[i] and c is not None), None)
    if not entry:
        return None
    bought = entry[1]
    if outcome == "terminated":
        out = next(((d, c) for d, c, _, _ in bars if d > ended and c is not None), None)
        if not out or out[0] < entry[0]:
            return None
        exit_on, got, paid = out[0], out[1], out[0]
    elif outcome == "completed" and price is not None:
        exit_on, got = final, price
        k = bisect_right(SESSIONS, final) - 1
        paid = paid or (SESSIONS[k + settle(SESSIONS[k])] if k + settle(SESSIONS[k]) < len(SESSIONS) else SESSIONS[-1])
        then = [f for d, c, _, f in bars if d <= final and c is not None]
        bought *= then[-1] / entry[2] if then else 1.0
    else:
        return None
    return (name, variant, entry[0], round(bought, 9), exit_on, got, paid, outcome == "completed")


def test_tender_trades(spark):
    rng = random.Random(3)
    deals, moves = [], []
    for n in range(150):
        filed = some_day(rng, 0, 300)
        expires = filed + timedelta(rng.randrange(15, 50)) if rng.random() < 0.9 else None
        final = expires
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            at = (final or filed) - timedelta(rng.randrange(0, 9))
            final = (final or filed) + timedelta(rng.randrange(-3, 25))
            moves.append((n, at, final))
        outcome = rng.choice(["completed", "completed", "terminated", "open"])
        deals.append((n, f"S{n % 12}", filed, expires, outcome, rng.choice([None, 10.0, 11.5]), final, (final or filed) + timedelta(rng.randrange(-8, 3)) if outcome == "terminated" else None, None if rng.random() < 0.6 or not final else final + timedelta(9)))
    deals = [d for d in deals if d[4] != "completed" or d[6]]
    px = {(f"S{s}", d): (None if rng.random() < 0.08 else round(8 + 4 * rng.random(), 2), rng.randrange(1000), 2.0 if d < date(2017, 12, 1) else 1.0) for s in range(12) for d in SESSIONS if rng.random() < 0.97}
    got = timelines.tender_trades(
        spark.createDataFrame(deals, "deal int, symbol string, filed date, expires date, outcome string, final_price double, final_expires date, terminated_on date, paid_on date"),
        spark.createDataFrame(moves, "deal int, known date, expires date"), calendar(spark), spark.createDataFrame([(*k, *v) for k, v in px.items()], "symbol string, dt date, close double, volume int, factor double"),
    ).collect()
    own = {}
    for n, at, to in moves:
        own.setdefault(n, []).append((at, to))
    want = sorted(x for d in deals for v in ("E1", "E2") if (x := tender(d, own.get(d[0], []), px, v)))
    assert sorted((r.deal, r.variant, r.entry_on, round(r.entry, 9), r.exit_on, r.exit, r.paid_on, r.fee > 0) for r in got if r.fee != 40) == sorted((*x[:7], fee) for x in want for fee in (False, True))
    for r in got:
        fee = r.fee if next(x for x in want if x[:2] == (r.deal, r.variant))[7] else 0.0
        assert abs(r.profit - (99 * (r.exit - r.entry) - fee)) < 1e-9 and r.days_locked == (r.paid_on - r.entry_on).days


def fold(rows, since, deadline):
    meetings, moves, due = [], [], [(since, deadline)]
    for filed, _, kind, form, meeting, right, redeem_by, stated, postponed, extended in sorted(rows, key=lambda r: (r[0], r[1])):
        if kind == "proxy":
            if meeting is None or meeting <= filed:
                continue
            same = [m for m in meetings if abs((m["last"] - meeting).days) <= 60 and m["last"] >= filed]
            if same:
                moves.append((same[-1]["id"], filed, meeting))
                same[-1]["last"] = max(same[-1]["last"], meeting)
                same[-1]["right"] |= right
            else:
                meetings.append({"id": len(meetings), "filed": filed, "meeting": meeting, "last": meeting, "redeem_by": redeem_by, "right": right, "stated": stated})
            continue
        if postponed:
            pending = [m for m in meetings if m["filed"] < filed and m["last"] >= ahead(filed, -3)]
            if pending:
                moves.append((pending[-1]["id"], filed, postponed))
                pending[-1]["last"] = max(pending[-1]["last"], postponed)
        if form.startswith("8-K") and extended and extended > due[-1][1]:
            due.append((filed, extended))
    return meetings, moves, due


def test_meetings_and_their_outcomes(spark):
    rng = random.Random(4)
    rows, starts = [], []
    for e in range(60):
        starts.append((e, FIRST, FIRST + timedelta(200)))
        for _ in range(rng.randrange(12)):
            filed = some_day(rng, 10, 380)
            kind = rng.choice(["proxy", "update"])
            rows.append((e, filed, f"a{rng.randrange(10**6):06d}", kind, "8-K" if rng.random() < 0.8 else "DEFA14A", filed + timedelta(rng.randrange(-3, 50)) if kind == "proxy" and rng.random() < 0.9 else None, rng.random() < 0.5, None, rng.choice([None, 10.0, 10.2]),
                         filed + timedelta(rng.randrange(1, 40)) if rng.random() < 0.4 else None, filed + timedelta(rng.randrange(60, 300)) if rng.random() < 0.3 else None, filed if rng.random() < 0.5 else None, rng.choice([None, 10.05, 13.0])))
    f = spark.createDataFrame(rows, "entity int, filed date, acc string, kind string, form string, meeting date, right boolean, redeem_by date, stated double, postponed_to date, extended_to date, voted_on date, per_share double").repartition(3)
    told = timelines.assembled(f, spark.createDataFrame(starts, "entity int, since date, deadline date"), calendar(spark))
    outcomes = {(r.entity, r.id): r for r in timelines.meeting_outcomes(told, f, calendar(spark)).collect()}
    revised = 0
    for r in told.collect():
        own = [x for x in rows if x[0] == r.entity]
        meetings, moves, due = fold([x[1:11] for x in own], *starts[r.entity][1:])
        assert [m.asDict() for m in r.meetings] == meetings and [tuple(x) for x in r.moves] == moves and [tuple(x) for x in r.deadlines] == due
        revised += len(moves)
        votes = sorted({x[11] for x in own if x[11]})
        for m in meetings:
            o = outcomes.pop((r.entity, m["id"]))
            held = next((v for v in votes if ahead(m["meeting"], -3) <= v <= m["last"] + timedelta(45)), m["last"])
            paid = next((x[12] for x in sorted(own, key=lambda x: (x[1], x[2])) if x[3] == "update" and x[12] and held <= x[1] <= held + timedelta(30)), None)
            thrown = bool(paid and m["stated"] and abs(paid - m["stated"]) > 1)
            assert (o.held, o.paid, o.paid_from, o.pay_on) == (held, None if thrown else paid, "discarded" if thrown else paid and "8-K", ahead(held, 5))
    assert not outcomes and revised > 20


def test_phase_ends(spark):
    s = SESSIONS
    rows = [(0, None, None, None, s[50]), (1, s[9], s[8], s[7], s[50]), (2, None, None, s[40], s[50]), (3, None, None, s[10], s[50]), (4, None, None, s[60], s[50]), (5, None, s[45], s[40], s[55])]
    got = timelines.phase_ends(spark.createDataFrame(rows, "entity int, closed date, changed date, last_vote date, last_day date"), calendar(spark)).collect()
    assert {r.entity: (r.phase_end, r.merged) for r in got} == {0: (None, False), 1: (s[8], True), 2: (s[40], True), 3: (None, False), 4: (None, False), 5: (s[40], True)}
