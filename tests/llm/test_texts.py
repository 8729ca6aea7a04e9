"""Jaccard join, substrings, sharding and packing against brute force, with nulls, copies, ties, empty and clashing tables."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from helpers import CLASHES, corpus, documents, jaccard_brute, ordered, substring_brute
from pyspark.sql import functions as F


@pytest.mark.parametrize("clashing", [False, True])
def test_jaccard_classes(spark, clashing):
    from tidemark.llm.jaccard import jaccard_classes

    got = jaccard_classes(documents(spark, clashing=clashing)).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(got) == ordered(jaccard_brute(corpus()))


@pytest.mark.parametrize("partners", [3, 256])
def test_keys_of_few_sets_walk_no_trie(spark, monkeypatch, partners):
    from tidemark.llm import jaccard as J

    walked, walk = [], J.in_tries
    monkeypatch.setattr(J, "PARTNERS", partners)
    monkeypatch.setattr(J, "in_tries", lambda *args: walked.append(1) or walk(*args))
    got = J.jaccard_classes(documents(spark)).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(got) == ordered(jaccard_brute(corpus()))
    assert partners < 256 or not walked


def test_pairs_of_a_key_by_place_and_class(spark):
    from tidemark.llm.jaccard import side_by_side

    rng = np.random.default_rng(3)
    rows = [(int(k), int(u), int(n), int(rng.integers(0, n // 4 + 1)), int(u) % 5) for k in range(40) for u, n in zip(rng.permutation(60)[:k], rng.integers(8, 40, k))]
    got = side_by_side(spark.createDataFrame(rows, "key long, uid long, n int, at int, class long"), 75).collect()
    able = {(x[1], y[1], x[4], y[4]) for x in rows for y in rows
            if x[0] == y[0] and x[1] < y[1] and x[4] != y[4] and 175 * min(x[2] - x[3], y[2] - y[3]) >= 75 * (x[2] + y[2])}
    assert able and sorted(map(tuple, got)) == sorted(able)


def test_classes_that_link_are_no_square_of_edges(spark, monkeypatch):
    from tidemark.llm import jaccard as J

    words = [f"w{k}" for k in range(60)]
    sets = [" ".join([*words, f"x{k}"]) if k < 20 else " ".join([f"y{k}", *words]) for k in range(40)] + ["other words " + " ".join(words[:30])]
    texts = spark.createDataFrame([(k, len(J.shingles(t.encode())), bytearray(t.encode())) for k, t in enumerate(sets)], "uid long, n int, raw binary")
    classes = spark.sparkContext.broadcast(J.frequency_classes(texts, 2_000))
    seen, decide = [], J.verified
    monkeypatch.setattr(J, "verified", lambda pairs, *rest: seen.append(pairs.count()) or decide(pairs, *rest))
    pairs = spark.createDataFrame([(a, b, 0, 20) for a in range(20) for b in range(20, 40)] + [(a, 40, 0, 40) for a in range(20)], J.PAIRS)
    assert [tuple(r) for r in J.class_links(pairs, texts, classes, 75).collect()] == [(0, 20)]
    assert seen == [40]  # 20 sets with one of each other class; all 420 pairs before


def test_a_pair_is_judged_at_its_first_common_key(spark):
    from tidemark.llm import jaccard as J

    sets = [" ".join([*(f"w{k}" for k in range(60)), f"x{i}"]).encode() for i in range(2)]
    texts = spark.createDataFrame([(k, len(J.shingles(t)), bytearray(t)) for k, t in enumerate(sets)], "uid long, n int, raw binary")
    classes = spark.sparkContext.broadcast(J.frequency_classes(texts, 200))
    keys = [J.ordered(J.shingles(t), classes.value) for t in sets]
    shared = [k for k in keys[0][:J.prefix(len(keys[0]))] if k in keys[1][:J.prefix(len(keys[1]))]]
    for nth, want in ((0, [(0, 1)]), (1, []), (-1, [])):
        rows = [(int(shared[nth].view(np.int64)), u, len(k), int(np.flatnonzero(k == shared[nth])[0]), u, 2) for u, k in enumerate(keys)]
        open_ = spark.createDataFrame(rows, "key long, uid long, n int, at int, class long, blocks int")
        assert [tuple(r)[:2] for r in J.in_tries(open_, texts, classes, 75).collect()] == want


def test_large_keys_meet_further_leaders(spark, monkeypatch):
    from tidemark.llm import jaccard as J

    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        words = [f"w{i}" for i in range(200)]
        for at in rng.choice(200, 4, replace=False):
            words[at] = f"z{k}-{at}"
        rows.append((k, " ".join(words), "en", "s", 0))
    seen, links = [], J.class_links
    monkeypatch.setattr(J, "PARTNERS", 8)
    monkeypatch.setattr(J, "class_links", lambda pairs, *rest: seen.append(pairs.count()) or links(pairs, *rest))
    for rounds in (0, J.ROUNDS):
        monkeypatch.setattr(J, "ROUNDS", rounds)
        got = J.jaccard_classes(documents(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
        assert ordered(got) == ordered(jaccard_brute(rows))
    assert seen[1] < seen[0]


def test_one_of_each_names_a_text_once(spark):
    """A filter over the name worked it out again, in two more Python workers a core."""
    from tidemark.llm.jaccard import one_of_each

    assert "EvalPython" not in one_of_each(documents(spark))._jdf.queryExecution().executedPlan().toString()


def test_frequency_classes_count_every_shingle(spark):
    from tidemark.llm.jaccard import frequency_classes, shingles

    texts = [b"a b c d e f g"] * 300 + [b"p q r s t %d" % k for k in range(70)]
    got = frequency_classes(spark.createDataFrame([(t,) for t in texts], "raw binary").repartition(3), 1_000)
    counts = np.zeros(len(got), dtype=np.int64)
    for t in texts:
        counts[(shingles(t) & np.uint64(len(got) - 1)).astype(np.int64)] += 1
    assert (got == np.log2(np.maximum(counts, 1)).astype(np.uint8)).all() and counts.max() == 300


def test_one_of_each_keeps_one_row_a_class(spark):
    from tidemark.llm.jaccard import one_of_each

    out = one_of_each(documents(spark, clashing=True))
    assert out.columns == documents(spark, clashing=True).columns
    rows = [(r.doc_id, r.text) for r in out.collect()]
    brute = jaccard_brute(corpus())
    expected = [(r[0], r[1]) for r, b in zip(corpus(), brute) if not b[1]]  # rows without words
    expected += sorted({(r[0], r[1]) for r, b in zip(corpus(), brute) if b[1] and r[0] == b[2]})
    assert ordered(rows) == ordered(expected)


def test_one_of_each_tells_classes_of_one_id_apart(spark):
    """Different texts of null ids, and different texts that repeat an id, are classes of their own."""
    from tidemark.llm.jaccard import one_of_each

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(None, a, "en", "s", 0), (None, b, "en", "s", 0), (None, f"{b} more", "en", "s", 0), (7, c, "en", "s", 0), (7, d, "en", "s", 0), (8, d, "en", "s", 0)]
    got = [(r.doc_id, r.text) for r in one_of_each(documents(spark, rows)).collect()]
    assert len(got) == 4 and {(None, a), (7, c), (7, d)} < set(got)
    assert len({(None, b), (None, f"{b} more")} & set(got)) == 1


def test_trie_walk_equals_brute_force():
    from tidemark.llm.jaccard import Trie

    rng = np.random.default_rng(5)
    for _ in range(60):
        base = rng.choice(200, 40, replace=False)
        sets = []
        for _ in range(int(rng.integers(1, 12))):
            keep = base[rng.random(40) < 0.9]
            sets.append(np.unique(np.concatenate((keep, rng.choice(200, int(rng.integers(0, 12)))))).astype(np.uint64))
        x = np.unique(base).astype(np.uint64)
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, x)) >= 75 * len(np.union1d(s, x))]
        assert sorted(Trie(sets).linked(x, 75)) == want


@pytest.mark.parametrize("hot", [2_000, 1])
def test_substrings(spark, monkeypatch, hot):
    from tidemark.llm import substrings

    monkeypatch.setattr(substrings, "HOT", hot)  # 1: every mixed anchor is halved, then counted window by window
    monkeypatch.setattr(substrings, "SHARD", 10)
    out = substrings.remove_repeats(documents(spark, clashing=True))
    got = out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()
    assert ordered(got) == ordered(substring_brute(corpus()))


def test_without_repeats_leaves_other_texts_alone(spark):
    from tidemark.llm.substrings import without_repeats

    docs = documents(spark)
    out = without_repeats(docs)
    assert out.columns == docs.columns
    brute = substring_brute(corpus())
    untouched = [(r[0], r[1]) for r, b in zip(corpus(), brute) if not b[2]]
    got = ordered((r.doc_id, r.text) for r in out.collect())
    assert all(x in got for x in ordered(untouched))


def test_suffix_automaton_counts_paths():
    from tidemark.llm.substrings import SuffixAutomaton

    rng = np.random.default_rng(2)
    for _ in range(40):
        texts = [rng.integers(0, 3, int(rng.integers(4, 30))).tolist() for _ in range(4)]
        times = [int(x) for x in rng.integers(1, 3, 4)]
        sam = SuffixAutomaton()
        for t, n in zip(texts, times):
            sam.add(t, n)
        sam.finish()
        for t in texts:
            bits = sam.repeated(t, 4)
            for k in range(len(t) - 3):
                occurs = sum(n * sum(o[i:i + 4] == t[k:k + 4] for i in range(len(o) - 3)) for o, n in zip(texts, times))
                assert bool(bits >> k & 1) == (occurs > 1)


@pytest.mark.parametrize("bucket", [16 << 20, 3_000])
def test_sharding(spark, bucket):
    from tidemark.llm.sharding import shard

    docs = documents(spark, clashing=True)
    out = shard(docs, bucket_bytes=bucket)
    assert set(out.columns) == set(docs.columns)
    rows = out.collect()
    assert ordered((r.doc_id, r.text) for r in rows) == ordered((r[0], r[1]) for r in corpus())
    slots: dict[int, list[int]] = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(k, [])) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_is_native(spark):
    from tidemark.llm.sharding import shard

    plan = shard(documents(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_packing_is_exact_and_full(spark):
    from tokenizers import Tokenizer

    from tidemark.llm.packing import pack
    from tidemark.llm.tokens import default_vocabulary

    tokenizer = Tokenizer.from_file(default_vocabulary())
    rows = pack(documents(spark, clashing=True), capacity=64).collect()
    want = []
    for r in corpus():
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want += [(r[0], k, 64 * k, zlib.crc32(np.array(ids[64 * k:64 * k + 64], "<u4").tobytes())) for k in range(-(-len(ids) // 64))]
    assert ordered((r.doc_id, r.piece, r.start, zlib.crc32(bytes(r.ids))) for r in rows) == ordered(want)
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    least = -(-sum(r.length for r in rows) // 64)
    assert least <= len(by) <= 1.05 * least + 1


def test_plan_becomes_a_table_without_python_workers(spark, monkeypatch):
    from tidemark.llm.packing import best_fit

    pieces = documents(spark).select("doc_id", F.lit(5).alias("length"))
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    assert {r.offset % 5 for r in best_fit(pieces).collect()} == {0}


def test_plan_is_best_fit_and_short():
    from tidemark.llm.packing import plan

    rng = np.random.default_rng(1)
    counts = {int(k): int(n) for k, n in zip(rng.integers(1, 2049, 1500), rng.integers(1, 10**6, 1500))}
    rows = plan(counts)
    assert sum(r[2] for r in rows) == sum(counts.values())
    assert len(rows) < 3 * 2048 * 11
    for length, _, count, per, _, place in rows:
        assert place + per * length <= 2048 and count % per == 0


def test_pieces_beyond_the_capacity_are_refused(spark):
    from tidemark.llm.packing import best_fit

    with pytest.raises(Exception, match="piece length"):
        best_fit(spark.createDataFrame([(1, 9)], "doc_id long, length long"), capacity=8).collect()


def test_empty_tables(spark):
    from tidemark.llm.jaccard import jaccard_classes, one_of_each
    from tidemark.llm.packing import pack
    from tidemark.llm.sharding import shard
    from tidemark.llm.substrings import remove_repeats
    from tidemark.llm.tokens import decode, encode

    none = documents(spark, [])
    for out in (jaccard_classes(none), one_of_each(none), remove_repeats(none), shard(none), pack(none), decode(encode(none))):
        assert out.collect() == []
    assert len(CLASHES) == len(set(CLASHES))


def test_best_fit_with_clashing_columns_null_ids_and_repeated_rows(spark):
    from tidemark.llm.packing import best_fit

    rows = [(None, 5), (None, 5), (1, 3), (1, 3), (2, 8), (3, 8), (4, 1)]
    own = {c: F.lit("own") for c in ("__len", "__base", "__runs", "__hit", "__run", "__RANK")}
    got = best_fit(spark.createDataFrame(rows, "doc_id long, length long").withColumns(own), capacity=8).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == sorted((i or 0, n) for i, n in rows)
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0) and all(r[c] == "own" for c in own)
        filled[r.sequence_id] = r.offset + r.length
    assert len(filled) == 5 and max(filled.values()) <= 8
