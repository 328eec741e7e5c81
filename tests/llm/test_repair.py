"""Repair of conversations against a search over all edits, with and without rules, in one segment and in many."""

import hashlib
import heapq
import itertools
import random
import re

import pytest

from quillgauge.llm import repair as R

FIRST = {"s": 0, "u": 2, "a": 3}


def plain_audit(symbols):
    """Cheapest edits by a search over (cost, edits so far): the first finished way out of the queue is the best."""
    queue, seen = [(0, "", 0, 0)], set()
    while queue:
        cost, edits, at, state = heapq.heappop(queue)
        if at == len(symbols) and state in (0, 3):
            return cost, edits
        if (edits, at, state) in seen:
            continue
        seen.add((edits, at, state))
        emit = {"u": {0: 2, 1: 2, 3: 2}.get(state), "a": {2: 3}.get(state), "s": {0: 1}.get(state)}
        for role in "ua":
            if emit[role] is not None and not edits.endswith("III"):
                heapq.heappush(queue, (cost + 2, edits + "I", at, emit[role]))
        if at < len(symbols):
            x = symbols[at]
            heapq.heappush(queue, (cost + 3, edits + "D", at + 1, state))
            if x not in "1234":
                extra = int(x.isupper())
                if emit.get(x.lower()) is not None:
                    heapq.heappush(queue, (cost + extra, edits + "K", at + 1, emit[x.lower()]))
                for role in "ua":
                    if emit[role] is not None:
                        heapq.heappush(queue, (cost + 2 + extra, edits + "R", at + 1, emit[role]))


def least(symbols, rules=()):
    return R.best_audit(R.Grammar(list(rules)).block(symbols) if symbols else None)


def test_all_short_strings():
    for n in range(4):
        for s in itertools.product("suaoSUA1", repeat=n):
            assert least("".join(s)) == plain_audit("".join(s)), s


def test_rules_change_nothing():
    rng = random.Random(3)
    rules = [("一", "ua"), ("丁", "Uo"), ("丂", "一一"), ("七", "丂1")]
    for _ in range(60):
        s = "".join(rng.choice(["ua", "Uo", "1", "s", "A", "uaua1"]) for _ in range(rng.randrange(1, 5)))
        assert least(s, rules) == least(s)
        if len(s) <= 8:
            assert least(s) == plain_audit(s)
    assert len(R.Grammar(rules).compress("uauauaua1")) == 2


def plain_report(rows, conv_ids):
    out = {}
    for c in conv_ids:
        own = sorted(((t, r or " " if r != "" else "", x if x is not None else " ") for k, t, r, x in rows if k == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, counts, symbols = set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0), ""
        for _, role, text in own:
            body = re.sub(r"[\x20\x09-\x0d]", "", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            r = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "1" if fault in ("blank", "duplicate") else r.upper() if fault else r
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit = plain_audit(symbols)
        said, state, at = [], 0, 0
        for e in audit:
            if e in "IR":
                state = 3 if state == 2 else 2
                said.append(f"{R.NAMES[state]}:{own[at][2] if e == 'R' else ''}")
            elif e == "K":
                state = {"s": 1, "u": 2, "a": 3}[own[at][1][0]]
                said.append(f"{own[at][1]}:{own[at][2]}")
            at += e != "I"
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


ROWS = [
    (1, 0, "user", "Hello."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 5, "assistant", "No end"),
    (2, None, "system", "Be kind."), (2, None, None, None), (2, 3, "tool", "out."), (2, 4, "user", " \t"),
    (3, 0, "assistant", "A."), (3, 1, "user", "Q?"), (None, 0, "user", "null key."), (None, 1, "user", "again."), (4, 0, "user", "Kept\n. "),
    (6, 0, "", "No role."), (6, 2, "system", "s."), (6, 3, "user", "u."),
]


def rows_of(got):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got.collect()}


@pytest.mark.parametrize(("segment", "fan"), [(1024, 64), (2, 2)])
def test_report(spark, monkeypatch, segment, fan):
    monkeypatch.setattr(R, "SEGMENT", segment)
    monkeypatch.setattr(R, "FAN", fan)
    rows = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "conv_id long, turn long, role string, text string, symbol string, number long").repartition(3)
    ids = spark.createDataFrame([(1,), (2,), (3,), (None,), (4,), (5,), (6,), (5,)], "conv_id long")
    want = plain_report(ROWS, [1, 2, 3, None, 4, 5, 6])
    assert rows_of(R.repair(rows, ids)) == want
    assert want[5] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_conversation_over_many_segments(spark, monkeypatch):
    monkeypatch.setattr(R, "SEGMENT", 64)
    monkeypatch.setattr(R, "FAN", 4)
    rng = random.Random(1)
    rows = [(7, i, rng.choice(["user", "assistant", "assistant", "bot"]), f"{'' if i % 9 == 0 else i % 400}{'.' if i % 5 else ''}") for i in range(3000)]
    got = R.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), spark.createDataFrame([(7,)], "conv_id long"))
    monkeypatch.setattr(R, "SEGMENT", 100_000)
    whole = R.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), spark.createDataFrame([(7,)], "conv_id long"))
    assert rows_of(got) == rows_of(whole)
    audit = got.first().audit
    assert len(audit.replace("I", "")) == 3000


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.repair(R.damage(none), none).count() == 0


def test_rules_come_from_the_corpus(spark):
    strings = spark.createDataFrame([("uauaua",), ("suaua",), ("o",)], "symbols string")
    rules = R.learn_rules(strings)
    assert rules[0][1] == "ua" and all(len(p) == 2 for _, p in rules)
