"""Merkle manifest against a tree built row by row."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from helpers import corpus, documents, ordered
from pyspark.sql import functions as F

OUT = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row: tuple) -> str:
    doc_id, text, lang, source, n_chars = row
    parts = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if p is None else f"{len(p.encode())}:{p}" for p in parts))


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and of every node the siblings level by level."""
    steps: list[list[tuple[str, str]]] = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = p - p % 3
            steps[k].append(("".join(nodes[run:p]), "".join(nodes[p + 1:run + 3])))
        nodes, at = [sha("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)], [p // 3 for p in at]
    return nodes[0], steps


def brute(rows: list[tuple]) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    if not order:
        return []
    root, above = climb([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, above):
        for x, steps in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1]):
            r, whole = x[3], steps + up
            node = leaf((r[0], r[1].replace("\n", ""), *r[2:])) if r[1] and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0 else x[2]
            for a, b in whole:
                node = sha(a + node + b)
            out.append((r[0], x[2], trees[s][0], root, sha("".join(a + b for a, b in whole)), node, node == root))
    return out


def query(docs):
    from tidemark.llm.common import fold
    from tidemark.llm.merkle import manifest

    tampered = F.when(fold(F.col("doc_id"), 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(docs, tampered).select(*OUT)


def made(n: int, seed: int = 1, spread: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    sources = ["a", "a", "a", "b", "ü", "", None, "a b", "~"]
    ids = rng.sample(range(-n * spread, n * spread), n)
    return [(i, f"t{i}\nmore\n" if rng.random() < 0.8 else None, rng.choice(["en", None]), rng.choice(sources), rng.choice([None, 3])) for i in ids]


@pytest.mark.parametrize("rows", [
    # dense and sparse ids, nulls, copies, a very long text
    [*corpus(), *made(900), *[(r[0], r[1], r[2], f"{r[3]} sparse", r[4]) for r in made(300, 2, 1 << 40)]], made(4)[:2], [],
    # one id and the null id hold many different rows, and rows repeat
    [*made(60), *[(7, f"x{k}\n", None, "a", k) for k in range(300)], *[(None, f"y{k}", "en", "a", None) for k in range(300)], *[(8, "z\n", "en", "a", 1)] * 20,
     *[(None, "w", "en", None, 1)] * 5, *[(2**63 - 1, "hi", "en", "a", 1), (-2**63, "lo", "en", "a", 1)]],
], ids=["mixed", "two", "none", "ties"])
def test_manifest(spark, rows):
    assert ordered(query(documents(spark, rows, clashing=True).withColumns({c: F.lit("own") for c in ("g", "leaf", "place", "n", "slots", "total", "root")})).collect()) == ordered(brute(rows))


def test_many_sources_join_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.merkle.MOST_BROADCAST", 0)
    rows = [(k, f"t{k}\n", "en", f"s{k % 300}", k) for k in range(700)]
    assert ordered(query(documents(spark, rows)).collect()) == ordered(brute(rows))


def test_copies_of_a_row_over_blocks(spark):
    rows = [(1, "same\n", "en", "a", 1)] * 9000 + made(10)
    assert ordered(query(documents(spark, rows)).collect()) == ordered(brute(rows))


def test_any_change_shows(spark):
    from tidemark.llm.merkle import manifest

    rows = made(500, 3)
    docs = documents(spark, rows)
    assert all(r.verified for r in manifest(docs).collect())
    assert not any(r.verified for r in manifest(docs, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).collect())


def test_query(spark):
    from tidemark.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    assert ordered(QUERIES["op12_merkle"](spark, "/root/testdata/sf0.001").select(*OUT).collect()) == ordered(brute([tuple(r) for r in docs.collect()]))
