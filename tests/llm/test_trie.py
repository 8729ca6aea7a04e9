"""Conversation trie against a dictionary of prefixes, and tree contraction against recursion."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from helpers import ordered
from pyspark.sql import functions as F

TURNS = "conv_id long, turn long, role string, text string"
OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows: list[tuple]) -> list[tuple]:
    convs: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, sha, role, text))
    turns = {c: [t[3:] for t in sorted(own)] for c, own in convs.items()}
    members: dict[tuple, list[int]] = {}
    ends: dict[tuple, list[int]] = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        giver = c - (c % 20 if c >= 0 else -(-c % 20))
        seq = tuple(turns.get(giver, [])[:h] + own[h:])
        ends.setdefault(seq, []).append(c)
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children: dict[tuple, int] = dict.fromkeys(members, 0)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for seq in members:
        if seq:
            children[seq[:-1]] += 1
    for seq, own in members.items():
        tokens = (len(own) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", seq[-1][1])) if seq else 0
        for d in range(len(seq) + 1):
            leaves[seq[:d]] += children[seq] == 0
            saved[seq[:d]] += tokens
    return [
        (min(own), len(seq), min(members[seq[:-1]]) if seq else None, len(own), children[seq], leaves[seq], saved[seq],
         hashlib.sha256(",".join(map(str, sorted(ends.get(seq, [])))).encode()).hexdigest())
        for seq, own in members.items()]


def made(convs: int, seed: int = 1, kinds: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in range(-45, convs - 45):
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, rng.choice([t, t, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(["", None, *(f"a b\tw{k}\n" for k in range(kinds))])))
    return rows + rows[:20] + [(None, 1, "user", "x")] * 3


def trie(spark, rows):
    from tidemark.llm.trie import prefix_trie

    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("own") for c in ("id", "conv", "at", "sha", "words", "depth", "children", "n")})
    return ordered(prefix_trie(df).select(*OUT).collect())


@pytest.mark.parametrize("rows", [
    # one conversation holds most of the rows, one turn begins many, rows repeat
    [*made(60), *[(20, t, "user", f"t {t % 7}") for t in range(1100)], *[(c, t, "user", f"t {t % 7}") for c in range(100, 140) for t in range(4)], *[(41, 1, "user", "same")] * 50,
     *[(c * 5000, 0, "user", "hello " * 30) for c in range(-60, 60)]],
    [(None, 0, "user", "x")],
], ids=["mixed", "null"])
def test_trie(spark, rows):
    assert trie(spark, rows) == ordered(brute(rows))


def test_contraction_of_deep_trees(spark):
    from tidemark.llm.trie import subtree_totals

    rng = random.Random(4)
    up = {0: None}
    for k in range(1, 300):
        up[k] = k - 1 if k < 120 else rng.choice([rng.randrange(k), k - 1, 119])
    value = {k: rng.randrange(100) for k in up}
    want = dict(value)
    for k in sorted(up, reverse=True):
        if up[k] is not None:
            want[up[k]] += want[k]
    nodes = spark.createDataFrame([(f"{k}", None if up[k] is None else f"{up[k]}", value[k], 1) for k in up], "id string, parent_id string, v long, one long")
    got = {r.id: (r.v, r.one) for r in subtree_totals(nodes, ["v", "one"]).collect()}
    assert {k: v for k, (v, _) in got.items()} == {f"{k}": v for k, v in want.items()} and got["0"][1] == 300


def test_query(spark):
    from tidemark.llm.queries import QUERIES

    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert ordered(QUERIES["op13_trie"](spark, "/root/testdata/sf0.001").select(*OUT).collect()) == ordered(brute([tuple(r) for r in turns]))
