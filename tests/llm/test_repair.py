import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavelens.llm import op11_repair as op
from wavelens.llm import queries as q

ROWS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def _damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        n = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        out += [(c, t, "user" if n == 4 else role, text)] * (0 if n == 0 else 2 if n == 3 else 1)
    return out


def _fault(role, text, seen):
    body = text.strip(" \t\n\x0b\x0c\r")
    return "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""


def cheapest(rows):
    """(cost, audit, repaired lines) over (role, text, fault) rows: shortest paths over (row, initials so far)."""
    ends = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def relax(into, state, got):
        if state not in into or got[:2] < into[state][:2]:
            into[state] = got

    def inserts(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                to = ends[state]
                relax(best, to, (cost + 3, audit + "I", lines + ({"u": "user", "a": "assistant"}[to] + ":",)))
        return best

    for role, text, fault in rows:
        new = {}
        for state, (cost, audit, lines) in inserts(best).items():
            relax(new, state, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            cut = 3 * (fault == "truncated")
            if role[:1] and (role[:1] == ends[state] or (role[:1] == "s" and state == "")):
                relax(new, role[:1], (cost + cut, audit + "K", lines + (f"{role}:{text}",)))
            to = ends[state]
            relax(new, to, (cost + 3 + cut, audit + "R", lines + ({"u": "user", "a": "assistant"}[to] + f":{text}",)))
        best = new
    best = inserts(best)
    return min(best[s] for s in ("", "a") if s in best)


def brute(rows):
    by = defaultdict(list)
    for r in _damaged(rows):
        by[r[0]].append(r[1:])
    out = []
    for c in {r[0] for r in rows}:
        turns = sorted(by[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1],
                                             hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in turns:
            faults.append(_fault(role, text, seen))
            seen.add((role, text))
        known = {t for t, _, _ in turns if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        cost, audit, lines = cheapest([(role, text, f) for (_, role, text), f in zip(turns, faults)])
        out.append((c, max(known) - min(known) + 1 - len(known) if known else 0, *(faults.count(f) for f in (
            "blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def _got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("block", [op.BLOCK, 2])
def test_whole_table(spark, monkeypatch, block):
    """Blocks of two rows: conversations are put together from many matrices."""
    monkeypatch.setattr(op, "BLOCK", block)
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert _got(q.repaired_conversations(rows)) == brute([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])


def test_odd_rows(spark, monkeypatch):
    long = "word " * 50_000
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("user", "Hi."), ("assistant", "Yes."), ("user", "Hi."), ("tool", "x!"),
                                                     ("", "no role."), (None, "null role?"), ("user", None), ("user", " \n")])]
    rows += [(None, None, None, None), (None, 3, "user", "a"), (None, None, "user", "b."), (2, None, "system", "s."),
             (3, 5, "user", long), (3, 5, "user", long), (3, 5, "user", long), (3, 9, "assistant", long + "."),
             (3, 9, "assistant", "tie."), (3, 9, "user", "tie."), (3, -4, "système", "é。"), (5, 1, "user", "k ")]
    rows += [(i, 0, "user", "only.") for i in range(40, 80)]
    docs = spark.createDataFrame(rows, ROWS)
    want = brute(rows)
    for block in (4096, 1, 3):
        monkeypatch.setattr(op, "BLOCK", block)
        assert _got(q.repaired_conversations(docs)) == want
    extra = docs.selectExpr("*", "1 AS conv", "2 AS block", "'k' AS key", "3 AS state", "4 AS n", "5 AS audit")
    assert _got(q.repaired_conversations(extra)) == want


def test_long_and_repeated(spark, monkeypatch):
    """A conversation with most of the rows, in which one row stands again and again and one
    text comes back at every turn, is cut over partitions and blocks."""
    rows = [(7, i, ("user", "assistant", "system")[i * i % 3], f"text {i % 50 if i % 4 else 0}{'.?x'[i % 3]}") for i in range(3000)]
    rows += [(7, 100, "user", "again.")] * 1000 + [(i, j, "user", "hm.") for i in range(100, 200) for j in range(3)]
    monkeypatch.setattr(op, "BLOCK", 64)
    assert _got(q.repaired_conversations(spark.createDataFrame(rows, ROWS).repartition(6))) == brute(rows)


def test_empty(spark):
    assert q.repaired_conversations(spark.createDataFrame([], ROWS)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = q.repaired_conversations(spark.createDataFrame([(gone, 0, "user", "x.")], ROWS)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


ROW = {"x": ("user", "", "blank"), "s": ("system", "t.", ""), "u": ("user", "t.", ""), "a": ("assistant", "t.", ""),
       "o": ("tool", "t.", ""), "S": ("system", "t", "truncated"), "U": ("user", "t", "truncated"),
       "A": ("assistant", "t", "truncated"), "O": ("tool", "t", "truncated")}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=op.SYMBOLS, min_size=1, max_size=40), min_size=1, max_size=30))
def test_grammar(words):
    """Matrices and ropes of compressed sequences equal the shortest paths."""
    g = op.Grammar()
    rules = g.compress([[op.SYMBOLS.index(c) for c in w] for w in words])
    for w, rule in zip(words, rules):
        ends = [(int(g.cost[rule, 0, j]) + 3 * op.CLOSING[j], int(g.rank[rule, 0, j]), j) for j in range(4)]
        cost, _, j = min(ends)
        assert (cost, g.audit(int(rule), 0, j) + "I" * op.CLOSING[j]) == cheapest([ROW[c] for c in w])[:2]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=op.SYMBOLS, max_size=4))
def test_shortest_paths_against_enumeration(word):
    """The test's own shortest paths against every audit with at most five inserts."""
    best = None

    def go(i, roles, cost, audit, inserts):
        nonlocal best
        if i == len(word) and LEGAL.fullmatch(roles):
            best = min(best or (cost, audit), (cost, audit))
        if inserts < 5:
            for r in "ua":
                go(i, roles + r, cost + 3, audit + "I", inserts + 1) if LEGAL.fullmatch(roles + r) or LEGAL.fullmatch(roles + r + "a") else None
        if i < len(word):
            c = word[i]
            go(i + 1, roles, cost + 4, audit + "D", inserts)
            if c != "x":
                cut = 3 * c.isupper()
                go(i + 1, roles + c.lower(), cost + cut, audit + "K", inserts) if LEGAL.match(roles + c.lower() + "ua") else None
                for r in "ua":
                    go(i + 1, roles + r, cost + 3 + cut, audit + "R", inserts)

    go(0, "", 0, "", 0)
    assert best == cheapest([ROW[c] for c in word])[:2]


def test_many_deletions():
    g = op.Grammar()
    for n in (1, 2, 5, 1000, 1 << 20):
        rule = int(g.compress([g.deletions(n)])[0])
        assert g.cost[rule, 0, 0] == 4 * n and len(g.audit(rule, 0, 0)) == n if n < 2000 else g.cost[rule, 0, 0] == 4 * n
