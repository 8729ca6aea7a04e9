"""The three learned operators: parts against brute force, held-out accuracy, nulls and empty tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import bag, corpus, documents
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, old = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(old[j] + (x != y), old[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_automaton_accepts_words_within_the_edits():
    from tidemark.llm.toxicity import EXACT, FUZZY, NO_HIT, LevenshteinTrie

    terms = ["scum", "idiot", "clown", "pathetic", "worthless", "disgusting"]
    trie = LevenshteinTrie(terms, ["lowei"])
    rng = random.Random(3)
    letters = "abcdilorstuwnpehg"
    for _ in range(4000):
        word = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            match rng.randrange(3):
                case 0:
                    word.insert(at, rng.choice(letters))
                case 1:
                    word[at:at + 1] = []
                case 2:
                    word[at:at + 1] = rng.choice(letters)
        w = "".join(word)
        near = any(distance(w, t) <= trie.edits(t) for t in terms)
        assert trie.find(w) == (EXACT if w in terms else FUZZY if near else NO_HIT), w
    assert trie.find("loweichen") == EXACT and trie.find("lowes") == NO_HIT


def test_quotation_is_not_abuse():
    from tidemark.llm.toxicity import ToxicityModel, context

    model = ToxicityModel(["idiot", "worthless"], [])
    score = lambda text: float(model.score(np.array([context(text, model.verdicts())[0]]))[0])
    assert score("you idiot , you are worthless") > 0.5 > score('they wrote "you idiot" in it')
    assert score("you are a wortless idiot") > score("you are a wortless thing") > score("you are a kind thing")
    assert score("") < 0.1


def toxic_fixture(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(400):
        w = bag(rng, 60, 3000)
        if k % 4 == 0:
            for term in rng.sample(["numskull", "blockhead", "ratbag"], 2):
                w.insert(rng.randrange(60), term)
        rows.append((k, " ".join(w), "en", "s", 0))
        labels.append((k, 1, int(k % 4 == 0)))
    rows.append((1000, "plain words and a nmskull and a blockhaed here", "en", "s", 0))
    rows.append((1001, None, None, None, None))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_terms_and_meets_misspellings(spark):
    from tidemark.llm.toxicity import drop_toxic, fit_toxicity, score_toxicity

    docs, labels = toxic_fixture(spark)
    model = fit_toxicity(docs, labels)
    assert set(model.words) | set(model.stems) >= {"blockhead", "numskull", "ratbag"}
    got = {r.doc_id: r.score for r in score_toxicity(docs, model).collect()}
    assert all((got[k] >= 0.5) == (k % 4 == 0) for k in range(400))
    assert got[1000] > got[1001]
    assert drop_toxic(docs, labels).filter("doc_id < 400").count() == 300


def test_bounded_samples_keep_the_shares_of_the_labels(spark):
    """The texts tell nothing about the label, so scores show the prior: it is that of all labelled rows, however few of
    them are sampled."""
    from tidemark.llm.quality import fit_quality, score_quality
    from tidemark.llm.toxicity import fit_toxicity, score_toxicity

    rng = random.Random(8)
    docs = documents(spark, [(k, " ".join(bag(rng, 60, 3000)), "en", "s", 0) for k in range(600)])
    labels = spark.createDataFrame([(k, int(k % 10 > 0), int(k % 10 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    for fit, score, share in ((fit_quality, score_quality, 0.9), (fit_toxicity, score_toxicity, 0.1)):
        means = [np.mean([r.score for r in score(docs, fit(docs, labels, max_rows=most)).collect()]) for most in (10_000, 30)]
        assert all(abs(m - share) < 0.06 for m in means), (fit, means)


def accuracy(rows, label: str) -> tuple[float, int]:
    held = [r for r in rows if r.held_out]
    return sum(r.predicted == r[label] for r in held) / len(held), len(held)


@pytest.mark.parametrize(("name", "label", "least"), [("op8_quality", "quality", 0.97), ("op5_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    from tidemark.llm.queries import QUERIES

    rows = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    got, n = accuracy(rows, label)
    assert n > 50 and got >= least
    assert all(0 <= r.score <= 1 for r in rows)


def test_gradients_equal_differences():
    from tidemark.llm.language import BiGru, padded

    net = BiGru.new(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = padded([b"ab", b"hello", b"\xc3\xbcber"])
    y = np.array([0, 2, 1])
    grads = net.gradients(x, mask, y)

    def loss() -> float:
        p = net.labels(x, mask)
        return float(-np.log(p[np.arange(3), :, y])[mask].sum() / mask.sum())

    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was = net.p[k][at]
        net.p[k][at] = was + 1e-3
        up = loss()
        net.p[k][at] = was - 1e-3
        down = loss()
        net.p[k][at] = was
        assert abs((up - down) / 2e-3 - g[at]) < 1e-4 * max(1, abs(g[at])), k


def test_language_held_out(spark):
    from tidemark.llm.queries import QUERIES

    rows = QUERIES["op6_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.95


def test_language_of_texts_without_letters_and_of_no_training(spark):
    from tidemark.llm.language import fit_language, predict_language

    docs = documents(spark, [(1, None, "en", None, None), (2, "", "en", None, 0), (3, "12 !?", "de", None, 0), (4, "abc", None, None, 0)])
    net = fit_language(docs)
    assert {(r.doc_id, r.lang_pred, r.score) for r in predict_language(docs, net).collect()} == {(k, "und", 0.0) for k in (1, 2, 3, 4)}


def test_tables_without_labels_or_rows(spark):
    from tidemark.llm.language import fit_language, predict_language
    from tidemark.llm.quality import fit_quality, score_quality
    from tidemark.llm.toxicity import fit_toxicity, score_toxicity

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs, empty = documents(spark, clashing=True), documents(spark, [])
    for own in (docs, empty):
        quality = score_quality(own, fit_quality(own, none))
        toxic = score_toxicity(own, fit_toxicity(own, none))
        lang = predict_language(own, fit_language(own))
        n = len(corpus()) if own is docs else 0
        assert quality.count() == toxic.count() == lang.count() == n
        assert [r for r in quality.collect() if not 0 <= r.score <= 1] == [r for r in toxic.collect() if not 0 <= r.score <= 0.5] == []


def test_numerals_are_no_letters_and_own_columns_may_clash(spark):
    from tidemark.llm.language import fit_language, predict_language

    learn = spark.createDataFrame([(i, "der und die " * 5 if i % 2 else "the and of " * 5, "de" if i % 2 else "en") for i in range(40)], "doc_id long, text string, lang string")
    net = fit_language(learn)
    docs = spark.createDataFrame([(1, "² ½ Ⅷ ① ٣"), (2, "Ⅷ the and of"), (3, "ª")], "doc_id long, text string").withColumn("__p", F.lit("own"))
    got = {r.doc_id: r for r in predict_language(docs, net).collect()}
    assert (got[1].lang_pred, got[1].score) == ("und", 0.0) and got[2].lang_pred != "und" and got[3].lang_pred != "und"
    assert {r["__p"] for r in got.values()} == {"own"}
