import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from boundwise.llm import learning, mil_toxicity, queries, subword_quality
from boundwise.llm.common import Texts, table

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string, label int, score int"
LABELS = "doc_id long, quality int, toxic int, text string"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "Word. " * 50_000), (6, "one"), (6, "one"), (None, "some text"), (7, "\U0001f600 漢字 ä́"), (8, "...")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", 9, 9) for r in rows], DOCS)


def scores(name, spark):
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    return [(r, labels[r.doc_id]) for r in queries.queries()[name](spark, SF).collect() if r.doc_id in labels]


def test_quality_on_held_out_documents(spark):
    rows = [(r, x.quality) for r, x in scores("op3_subword_quality", spark) if r.held_out]
    right = {y: np.mean([r.predicted == y for r, z in rows if z == y]) for y in (0, 1)}
    assert right[0] >= 0.95 and right[1] >= 0.99
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r, _ in rows)


def test_toxicity_on_held_out_documents(spark):
    rows = [(r, x.toxic) for r, x in scores("op8_mil_toxicity", spark) if r.held_out]
    right = {y: np.mean([r.predicted == y for r, z in rows if z == y]) for y in (0, 1)}
    assert right[1] >= 0.75 and right[0] >= 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r, _ in rows)


@pytest.mark.parametrize("module", [subword_quality, mil_toxicity])
def test_odd_rows(spark, module):
    labels = spark.createDataFrame([(4, 1, 0, "x"), (5, 0, 1, "x"), (5, 0, 1, "x"), (4, None, None, "x"), (None, 1, 1, "x"), (99, 1, 1, "x"), (7, 7, 7, "x")], LABELS)
    docs = frame(spark, ODD)
    got = module.scored(docs, module.train(docs, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    same = [r.score for r in got if r.doc_id == 6]
    assert same[0] == same[1] == next(r.score for r in got if r.doc_id == 4)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    empty = frame(spark, [])
    assert module.scored(empty, module.train(empty, labels.limit(0))).collect() == []


@pytest.mark.parametrize("module", [subword_quality, mil_toxicity])
def test_one_class_of_labels(module):
    t = Texts(pa.record_batch({"text": ["a word", ""]}))
    for label in (0, 1):
        model = module.fit(pa.table({"text": ["a", "b"], "label": pa.array([label] * 2, pa.int32())}), {label: 1.0})
        assert (model.scores(t)[0] >= 0.5) == label
    none = module.fit(pa.table({"text": pa.array([], pa.string()), "label": pa.array([], pa.int32())}), {})
    assert len(none.scores(t)) == 2


def test_samples_leave_the_held_out_fold_alone(spark):
    docs = frame(spark, [(i, f"text {i}") for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(300)], LABELS)
    got, weights = learning.labelled(docs, labels, "quality", 3, 1, per_class=40)
    ids = [int(t.split()[1]) for t in got["text"].to_pylist()]
    assert len(ids) == 80 and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids)
    assert sorted(got["label"].to_pylist()) == [0] * 40 + [1] * 40 and weights.keys() == {0, 1}
    again, _ = learning.labelled(docs.repartition(7), labels.repartition(3), "quality", 3, 1, per_class=40)
    assert again.equals(got)


def test_labels_and_other_columns_do_not_reach_a_score(spark):
    rows = [(i, f"good words here {i % 5}" if i % 2 else "bad | bad | bad") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2, "x") for i in range(60)], LABELS)
    for module in (subword_quality, mil_toxicity):
        model = module.train(frame(spark, rows), labels)
        one = {r.doc_id: r.score for r in module.scored(frame(spark, rows), model).collect()}
        other = spark.createDataFrame([(i + 1000, t, "xx", "yy", i, -i) for i, t in rows], DOCS)
        assert {r.doc_id - 1000: r.score for r in module.scored(other, model).collect()} == one


def test_offending_sentences_are_located(spark):
    rng = np.random.default_rng(5)
    clean = lambda: " ".join(f"w{chr(97 + k)}" for k in rng.integers(0, 26, 6)).capitalize() + "."
    rows, labels = [], []
    for i in range(400):
        parts = [clean() for _ in range(5)]
        if i % 4 == 0:
            parts[2] = "You are a rotter today."
        rows.append((i, " ".join(parts)))
        labels.append((i, 1, int(i % 4 == 0), "x"))
    docs = frame(spark, rows)
    model = mil_toxicity.train(docs, spark.createDataFrame(labels, LABELS))
    found = mil_toxicity.located(docs, model).collect()
    assert {r.doc_id for r in found} == {i for i, _ in rows if i % 4 == 0}
    assert {(r.nth, r.sentence) for r in found} == {(2, "You are a rotter today")}


def test_documents_that_are_rejected_go(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = subword_quality.train(docs, table(spark, "/root/testdata/sf0.01", "labels"))
    kept = {r.doc_id for r in subword_quality.accepted(docs, model).collect()}
    assert kept == {r.doc_id for r in subword_quality.scored(docs, model).collect() if r.predicted == 1}


def naive_quality(model, text):
    """One text, feature by feature."""
    def bucket(word, kind):
        sets = [b for b, _ in subword_quality.features(Texts(pa.record_batch({"text": [word]})))]
        return int(sets[kind][0])

    words = [w for w in re.split("[ \t-\r]+", text or "") if w]
    kinds = [[bucket(w, 0) for w in words]]
    back = []
    for i, w in enumerate(words):
        lags = [k for k in range(1, subword_quality.LAGS + 1) if i >= k and words[i - k] == w]
        back.append((2 << subword_quality.BITS) + (min(lags) if lags else 0))
    if subword_quality.LAGS:
        kinds.append(back)
    for k, n in enumerate(subword_quality.NGRAMS):
        grams = [w[i : i + n] for w in words for i in range(len(w) - n + 1)]
        kinds.append([bucket(g, len(kinds) - k + k) for g in grams])
    z = model.bias + sum(np.mean(model.weights[b]) if b else 0 for b in kinds) / subword_quality.KINDS
    return 1 / (1 + np.exp(-z))


def naive_toxicity(model, text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    clean, each = 1.0, []
    for sentence in re.split("[\n\r!.?]", lower):
        buckets = set()
        for w in re.findall("[a-z\x80-\U0010ffff]+", sentence):
            s = mil_toxicity.sentences(Texts(pa.record_batch({"text": [w]})))
            buckets |= set(s.buckets.tolist())
        if buckets:
            p = 1 / (1 + np.exp(-(model.bias + sum(model.weights[b] for b in buckets))))
            clean *= 1 - p
            each.append(p)
    return 1 - clean, each


TEXTS = ["good words, good good words here", "bad | bad | bad", "", None, "Ünïcödé wörds and więcej; a", "x", "a a b a. You are bad! Bad\nbad? fine", "words\twords\x0bhere " * 5]


def test_scores_match_brute_force(spark):
    rows = [(i, f"good words here {i % 5}" if i % 2 else "bad | bad | bad. fine words") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2, "x") for i in range(60)], LABELS)
    docs = frame(spark, [(i, t) for i, t in enumerate(TEXTS)])
    model = subword_quality.train(frame(spark, rows), labels)
    got = {r.doc_id: r.score for r in subword_quality.scored(docs, model).collect()}
    assert [got[i] for i in range(len(TEXTS))] == pytest.approx([naive_quality(model, t) for t in TEXTS], abs=1e-9)
    model = mil_toxicity.train(frame(spark, rows), labels)
    found = {r.doc_id: r for r in mil_toxicity.scored(docs, model).collect()}
    want = [naive_toxicity(model, t) for t in TEXTS]
    assert [found[i].score for i in range(len(TEXTS))] == pytest.approx([x for x, _ in want], abs=1e-9)
    for i, (_, each) in enumerate(want):
        assert found[i].n_offending == sum(p >= 0.5 for p in each)
        assert each[found[i].worst_sentence] == pytest.approx(max(each)) if each else found[i].worst_sentence is None
    assert len({x for x, _ in want}) > 3
