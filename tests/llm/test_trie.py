"""The prefix trie of conversations against brute force over rebuilt tuples."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from sylvan.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def brute(rows):
    by = defaultdict(list)
    for c, turn, role, text, _ in rows:
        if c is not None:
            by[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in by.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = (own.get(c - c % 20, [])[:h] + t[h:]) if c % 20 else t
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out, below = [], {}
    for p in sorted(members, key=len, reverse=True):  # children first
        leaves, saved = below.get(p, (0, 0))
        leaves, saved = leaves or 1, saved + (len(members[p]) - 1) * words(p)
        if p:
            a, b = below.get(p[:-1], (0, 0))
            below[p[:-1]] = (a + leaves, b + saved)
        ends = sorted(c for c in members[p] if len(whole[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def conversations(seed, n=90, extra=()):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 17 != 5 and not (c % 20 == 0 and c % 60 == 40):  # bases that are absent
            turns = r.randint(1, 6)
            rows += [(c, t, r.choice(["user", "bot", None]), r.choice(["hello there", "a  b\tc", "", None, "x"]), "y") for t in range(turns)]
    return [*rows, *extra]


def test_against_brute_force(spark):
    rows = conversations(1)
    # A copy of another conversation, a turn without a number, rows without a conversation, a row that stands twice.
    rows += [(1000 + 20 * k, t, "user", f"same {t}", "z") for k in range(40) for t in range(5)]
    rows += [(500, None, "user", "first of all", "q"), (500, 0, "bot", "then", "q"), (None, 0, "user", "nobody", "q"), (501, 3, "user", "twice", "q"), (501, 3, "user", "twice", "q")]
    got = found(conversation_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert got == brute(rows)


def test_a_conversation_over_many_tasks(spark):
    """Ranges split conversations of thousands of turns; their keys and sums are those of one walk."""
    r = random.Random(3)
    long = [(t, "user", f"{r.random()} {'long ' * (t % 7)}", "") for t in range(4000)]
    rows = [(c, *x) for c in (20, 40) for x in long] + [(60, *x) for x in long[:1500]] + [(61, *x) for x in long[:900]] + conversations(4, 15)
    paths = conversation_trie.ranked(spark.createDataFrame(rows, SCHEMA).repartition(6)).persist()
    assert paths.where("c = 20").select("part").distinct().count() > 1 or paths.where("c = 40").select("part").distinct().count() > 1
    got = found(conversation_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(6)))
    assert got == brute(rows)


def test_equal_turns_do_not_depend_on_row_order(spark):
    rows = [(20 * c, t // 2, "user", f"text {t}", "") for c in range(3) for t in range(6)]
    assert found(conversation_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == found(conversation_trie.prefix_trie(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)))


def test_every_turn_drops_a_member(spark):
    """As many rounds as turns."""
    rows = [(20 * c, t, "user", f"t{t}", "") for c in range(1, 13) for t in range(c)]
    assert found(conversation_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x", "")]])
def test_no_conversations(spark, rows):
    assert conversation_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 50)
    rows = [(20 * c, t, "user", f"t{t}", "") for c in range(200) for t in range(2)]
    assert found(conversation_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_long_text(spark):
    rows = [(0, 0, "user", "word " * 300_000, ""), (20, 0, "user", "word " * 300_000, ""), (20, 1, None, None, "")]
    assert found(conversation_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
