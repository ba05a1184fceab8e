import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperproof.llm import prefixes as P
from paperproof.llm.queries import op12_prefix_trie

SF = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string, node string, part int, units int"


def whole(rows):
    """Rebuilt conversations from conv_id, turn, role, text rows, by the definition."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", P_order(role or "", text or ""), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5 * (1 if c >= 0 else -1))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def P_order(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(convs):
    """convs: {conv_id: turns}"""
    members, below = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                below[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    own = {p: (len(m) - 1) * len(p[-1][1].encode()) if p else 0 for p, m in members.items()}
    saved, leaves = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            saved[p[:d]] += own[p]
            leaves[p[:d]] += not below[p]
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p)).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below[p]), leaves[p], saved[p], ends(p)) for p, m in members.items()), key=str)


def got(spark, rows, **settings):
    table = spark.createDataFrame([(*r, "n", 1, 2) for r in rows], KIND)
    return sorted(map(tuple, P.prefix_trie(P.rebuilt(table), **settings).collect()), key=str)


def conversations(seed, n, words=3):
    pick = random.Random(seed)
    ids = pick.sample(range(-30, 3 * n), n)
    return [(c, t, pick.choice(["user", "bot", None]), pick.choice(["", None, "é", "long text"][:words])) for c in ids for t in range(pick.randint(1, 12))]


@pytest.mark.parametrize("settings", [{}, {"part_bytes": 300, "run_bytes": 100}, {"part_bytes": 900, "run_bytes": 1}])
def test_against_the_definition(spark, settings):
    rows = conversations(1, 60) + [(None, 1, "user", "lost"), (200, None, "user", "first"), (200, 5, "user", "later"), (200, None, None, None), (201, 1, "x", "tie"), (201, 1, "x", "tie"), (201, 1, "y", "eit"), (10**15, 0, "user", "far")]
    pick = random.Random(2)
    pick.shuffle(rows)
    assert got(spark, rows, **settings) == brute(whole(rows))


def test_turnless_and_no_conversations(spark):
    alone = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2][:3]
    rows = [(c, 0, "user", "gone") for c in alone]
    assert got(spark, rows) == brute(whole(rows)) == [(alone[0], 0, None, 3, 0, 1, 0, hashlib.sha256(",".join(map(str, alone)).encode()).hexdigest())]
    assert got(spark, []) == []


def test_one_conversation_and_one_first_turn_hold_most(spark):
    rows = [(5 * c, t, "user", f"same {t}") for c in range(700) for t in range(4)]
    rows += [(5 * c, t, "user", f"same {t}" if t == 0 else f"own {c % 40} {t}") for c in range(700, 1000) for t in range(3)]
    assert got(spark, rows, part_bytes=2000, run_bytes=500) == brute(whole(rows))


def test_a_very_long_conversation(spark):
    rows = [(5, t, "user", f"turn {t}") for t in range(20_000)] + [(10, t, "user", f"turn {t}") for t in range(30)]
    nodes = got(spark, rows, part_bytes=1, run_bytes=1)
    assert len(nodes) == 20_001 and (10, 30) not in {(r[0], r[1]) for r in nodes}
    assert {r[3] for r in nodes if r[1] <= 30} == {2} and {r[5] for r in nodes} == {1}


key = st.lists(st.sampled_from("abc"), max_size=5).map("".join)


def units(k):
    return b"".join(hashlib.sha256(c.encode()).digest()[:16] + bytes([0, 0, 0, 1]) for c in k)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(key, st.integers(0, 9)), min_size=1, max_size=8), max_size=9))
def test_merge_keeps_order_and_shared_turns(many):
    rows = [[(units(k), chunk, 1, "1") for k, chunk in run] for run in many]
    out = list(P.merged([P.unfolded(P._run(0, list(r))) for r in rows]))
    assert [r[1:3] for r in out] == sorted((r[:2] for run in rows for r in run))
    before = b""
    for n, k, *_ in out:
        assert n == P.shared(before, k)
        before = k


def test_merge_compares_no_shared_turn_twice(monkeypatch):
    asked = []
    real = P.shared
    monkeypatch.setattr(P, "shared", lambda a, b, known=0: asked.append(real(a, b, known) - known) or real(a, b, known))
    rows = [[(units("abcab" * 40 + x), 0, 1, "1") for x in run] for run in ("aab", "bba", "cab", "abc")]
    runs = [P._run(0, r) for r in rows]
    asked.clear()
    out = list(P.merged([P.unfolded(r) for r in runs]))
    assert len(out) == 12 and sum(asked) <= 200 * 3 + 12 * 3  # all heads meet once, later rows come with what they share


def test_whole_table_by_sql_and_definition(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = op12_prefix_trie(spark, SF)
    cur = con.execute(P.ORACLE)
    assert [c[0] for c in cur.description] == df.columns
    rows = sorted(map(tuple, df.collect()), key=str)
    assert rows == sorted(cur.fetchall(), key=str) == brute(whole(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()))
