"""op13 against a plain trie: shared first turns, copies, conversations of several bands, odd rows, one hash table alone."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quire.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, x long, n long"


def brute(rows: list[tuple], every: int = 20, most: int = 3) -> list[tuple]:
    turns: dict = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            turns.setdefault(c, []).append(((turn is not None, turn or 0), key, (role, text)))
    turns = {c: [x[2] for x in sorted(ts)] for c, ts in turns.items()}
    members: dict = {}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        base = c - (abs(c) % every if c >= 0 else -(abs(c) % every))
        paths[c] = tuple(turns.get(base, [])[:h] + own[h:])
        for d in range(len(paths[c]) + 1):
            members.setdefault(paths[c][:d], []).append(c)
    children: dict = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in children.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in children.get(p, [])) + (len(members[p]) - 1) * words
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children.get(p, [])), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if paths[c] == p).encode()).hexdigest()) for p, m in members.items())


def found(spark, rows: list[tuple], parts: int = 3) -> list[tuple]:
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in got)


def random_rows(seed: int, convs: int, longest: int) -> list[tuple]:
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rnd.choice([1, 2, 3, 5, longest])):
            rows.append((c, t, rnd.choice(["user", "user", "assistant"]), rnd.choice(["a", "b c", "d  e\tf", ""]), c, t))
    return rows


@pytest.mark.parametrize(("seed", "longest"), [(1, 6), (2, 9)])
def test_random_tries(spark, seed, longest):
    rows = random_rows(seed, 120, longest)
    assert found(spark, rows) == brute(rows)


def test_conversations_of_several_bands_share_their_beginnings(spark):
    rows = []
    for c, n in ((0, 200), (20, 200), (40, 64), (60, 65), (80, 128), (100, 129), (1, 200), (21, 300)):
        rows += [(c, t, "user", "w" * (t % 5) + (" x" if c == 100 and t > 100 else ""), 0, 0) for t in range(n)]
    assert found(spark, rows) == brute(rows)


def test_a_group_of_copies_and_a_conversation_of_most_rows(spark):
    rows = [(c, t, "user", f"same {t}", 0, 0) for c in range(0, 6000, 20) for t in range(3)]
    rows += [(7, t, "assistant", f"turn {t % 11}", 0, 0) for t in range(1500)]
    assert found(spark, rows, 5) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost", 0, 0), (5, None, "user", "first", 0, 0), (5, 1, None, None, 0, 0), (5, 1, "", "", 0, 0), (5, 2, "a", "bc", 0, 0), (5, 3, "ab", "c", 0, 0),
            (-7, 0, "user", "negative", 0, 0), (-20, 0, "user", "base of it", 0, 0), (-20, 1, "user", "more of it", 0, 0), (11, 0, "user", "x " * 200_000, 0, 0), (11, 0, "user", "y", 0, 0)]
    rows += [(c, 0, "user", "only one", 0, 0) for c in range(30, 40)]  # some lose their only turn: members of the root alone
    expected = brute(rows)
    assert found(spark, rows) == expected
    root = [r for r in expected if r[1] == 0]
    assert len(root) == 1 and root[0][7] != hashlib.sha256(b"").hexdigest()


def test_an_empty_table_has_no_nodes(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 0, "user", "x", 0, 0)]) == []


def test_slots_are_minimal_and_refuse_foreign_keys():
    rng = np.random.default_rng(0)
    x, y = (rng.integers(0, 2**63, 20_000, dtype=np.uint64) for _ in range(2))
    x[:500] = x[0]  # half a key alike
    slots = prefix_trie.Slots(x, y)
    assert sorted(slots(x, y)) == list(range(20_000))
    with pytest.raises(ValueError, match="not enumerated"):
        slots(x[600:601], y[601:602])


def test_ids_of_one_node_are_hashed_across_rows(spark):
    rows = [(1, 1, 10 * i, ",".join(str(10 * i + k) for k in range(10))) for i in range(50)] + [(1, 2, 3, "3")]
    got = spark.createDataFrame(rows, "x long, y long, conv_id long, ids string").repartition(4, "x", "y").sortWithinPartitions("x", "y", "conv_id").mapInArrow(prefix_trie._hashed, "x long, y long, sha string")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest()), (1, 2, hashlib.sha256(b"3").hexdigest())]
