"""Conversation repair against an exhaustive search and a plain pass with whole strings."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from panelmill.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")
EMPTY = hashlib.sha256(b"").hexdigest()


def faults(rows):
    """(conv) rows in order -> (role, text, must go, truncated, which fault)."""
    seen, out = set(), []
    for role, text in rows:
        sign = re.findall(r"[^\x20\x09-\x0D]", text)
        kind = "blank" if not sign else "duplicate" if (role, text) in seen else "truncated" if sign[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, kind))
    return out


def exhaustive(rows):
    """The cheapest (cost, audit, text) over every choice of edits with at most two inserts in a gap."""
    best = None
    for edits in itertools.product("DKua", repeat=len(rows)):
        if any(e != "D" and r[2] in ("blank", "duplicate") for e, r in zip(edits, rows)):
            continue
        for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            initials, audit, cost, text = "", "", 0, []
            for i, gap in enumerate(gaps):
                for g in gap:
                    initials, audit, cost = initials + g, audit + "I", cost + 2
                    text.append({"u": "user", "a": "assistant"}[g] + ":")
                if i == len(rows):
                    break
                role, body, kind = rows[i]
                e = edits[i]
                if e == "D":
                    audit, cost = audit + "D", cost + 3
                    continue
                role = role if e == "K" else {"u": "user", "a": "assistant"}[e]
                initials, audit, cost = initials + role[:1], audit + ("K" if e == "K" else "R"), cost + 2 * (e != "K") + (kind == "truncated")
                text.append(f"{role}:{body}")
            if GRAMMAR.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(text))
    return best


def plain(rows):
    """The pass over states with whole strings and texts."""
    def close(layer):
        out = dict(layer)
        for a, b, roles in cv.CLOSING:
            if a in layer:
                c, s, t = layer[a]
                new = (c + 2 * len(roles), s + "I" * len(roles), t + [f"{r}:" for r in roles])
                out[b] = min(out.get(b, new), new, key=lambda x: x[:2])
        return out

    layer = close({0: (0, "", [])})
    for role, text, kind in rows:
        new = {}
        for state, (c, s, t) in layer.items():
            ways = [(state, (c + 3, s + "D", t))]
            if kind not in ("blank", "duplicate"):
                c += kind == "truncated"
                for letter, to in cv.NEXT[state].items():
                    if letter == role[:1]:
                        ways.append((to, (c, s + "K", [*t, f"{role}:{text}"])))
                    elif letter != "s":
                        ways.append((to, (c + 2, s + "R", [*t, f"{cv.ROLES[letter]}:{text}"])))
            for to, way in ways:
                new[to] = min(new.get(to, way), way, key=lambda x: x[:2])
        layer = close(new)
    c, s, t = min((layer[x] for x in cv.ACCEPTING if x in layer), key=lambda x: x[:2])
    return c, s, "\n".join(t)


def through(rows):
    r = cv.Repair()
    for role, text, kind in rows:
        r.read(role, text, kind in ("blank", "duplicate"), kind == "truncated")
    return r.result()


def random_rows(rng, n, roles=("user", "assistant", "system", "tool", "u")):
    return faults([(rng.choice(roles), rng.choice(["", "Yes.", "No", "x!", " \t", f"t{rng.randrange(50)}."])) for _ in range(n)])


def test_pass_is_the_cheapest_of_all_edits():
    rng = random.Random(3)
    for _ in range(40):
        rows = random_rows(rng, rng.randrange(4))
        c, s, t = exhaustive(rows)
        assert through(rows) == (c, s, hashlib.sha256(t.encode()).hexdigest()) and plain(rows) == (c, s, t)


@pytest.mark.parametrize("settle", [1, 5, 1024])
def test_long_conversations(monkeypatch, settle):
    monkeypatch.setattr(cv, "SETTLE", settle)
    rng = random.Random(settle)
    for n in (0, 1, 2, 30, 400):
        for roles in (("user", "assistant"), ("user", "assistant", "system", "tool")):
            rows = random_rows(rng, n, roles)
            c, s, t = plain(rows)
            assert through(rows) == (c, s, hashlib.sha256(t.encode()).hexdigest())


def test_memory_does_not_grow_with_a_conversation():
    r = cv.Repair()
    for i in range(20_000):
        r.read("assistant" if i % 2 else "user", f"t{i}", False, i % 5 == 0)
    assert max(len(r._nodes(x[1])) for x in r.layer.values()) < 3 * cv.SETTLE
    assert r.result()[1] == "K" * 20_000


def by_hand(table):
    """The rows of the query by plain Python over rows(conv_id, turn, role, text, gone)."""
    out = []
    for conv in {r[0] for r in table}:
        rows = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x, gone in table if c == conv and not gone]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        marked = faults([r[1:] for r in rows])
        kinds = [m[2] for m in marked]
        numbers = [r[0] for r in rows if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in cv.LEGAL for a, b in zip(rows, rows[1:]))
        c, s, t = plain(marked)
        out.append((conv, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, c, s, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


ODD = [
    (1, 0, "system", "Be kind.", False), (1, 1, "user", "Hi", False), (1, 3, "assistant", "Yes.", False), (2, None, None, None, False), (2, 4, "user", "A?", False), (2, 4, "user", "A?", False),
    (None, 1, "user", "Null conversation.", False), (None, 2, "assistant", "So it is!", False), (None, None, "assistant", "first.", False), (3, 0, "user", "gone.", True), (4, 0, "assistant", "word " * 30_000 + ".", False),
    (4, 0, "", "same number.", False), (4, 0, "Assistant", "é漢.\n", False), (5, None, "user", "\x0b\x0c", False), (6, -5, "user", "low.", False), (6, 9, "assistant", "high.", False),
]


def test_repair_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, f"{SCHEMA}, gone boolean").withColumns({c: F.lit(1) for c in ("kind", "digest", "at", "blank", "cost")})
    got = cv.repaired_conversations(df)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand(ODD)
    assert cv.repaired_conversations(df.where("conv_id = -1")).count() == 0
    assert got.where("conv_id = 3").first()["repaired_sha256"] == EMPTY
    texts = {}
    for r in cv.repaired_turns(df, got).orderBy("conv_id", "position").collect():
        texts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in got.collect():
        assert hashlib.sha256("\n".join(texts.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]


def test_repair_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    broken = cv.damaged(table)
    rows = [tuple(r) for r in broken.select("conv_id", "turn", "role", "text", "gone").collect()]
    assert {r[0] for r in rows} == {r[0] for r in table.select("conv_id").collect()}
    assert sorted((tuple(r) for r in cv.repaired_conversations(broken).collect()), key=repr) == by_hand(rows)
