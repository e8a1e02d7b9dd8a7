"""Strings and sequences that weak hashes take for each other, and what tasks remember."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from boundwise.llm import common, cover_dedup, lsh_forest, piece_encoder, rans_store
from boundwise.llm.common import Steps, Texts, Words, identities, lookup, save, table, windows, word_hashes
from hypothesis import given, settings
from hypothesis import strategies as st
from test_texts import frame, jaccard_groups, without_repeats


def thue_morse(n, a, b):
    """The first n letters: a polynomial hash modulo 2**64 of any base can't tell it from the sequence with a and b swapped."""
    return [(a, b)[bin(i).count("1") % 2] for i in range(n)]


ONE, OTHER = "".join(thue_morse(2048, "a", "b")), "".join(thue_morse(2048, "b", "a"))
LONG_ONE, LONG_OTHER = " ".join(thue_morse(2048, "one", "two")), " ".join(thue_morse(2048, "two", "one"))


def test_words(spark):
    t = Texts(pa.record_batch({"text": [f"{ONE} {OTHER}"]}))
    w = Words(t)
    for seed in (0, 1, 2):
        assert len(set(word_hashes(t, w, seed).tolist())) == 2


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=20), max_size=30))
def test_identities_are_those_of_the_strings(rows):
    ends = np.cumsum([len(r) for r in rows], dtype=np.int64) if rows else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends])[: len(rows)].astype(np.int64)
    low, high = identities(np.frombuffer(b"".join(rows), np.uint8), starts, ends)
    assert all((rows[i] == rows[j]) == ((low[i], high[i]) == (low[j], high[j])) for i in range(len(rows)) for j in range(i))


@pytest.mark.parametrize("n", [1, 2, 5, 20, 50])
def test_windows(n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 3, 400).astype(np.uint64)
    values[200:300] = values[50:150]
    got = windows(values, n)
    rows = [tuple(values[i : i + n].tolist()) for i in range(400 - n + 1)]
    assert len(got) == len(rows) and len(set(got.tolist())) == len(set(rows))
    assert len(windows(values[:3], 5)) == 0


def test_joins_tell_long_words_and_sequences_apart(spark):
    rows = [(1, ONE, "en", "a"), (2, OTHER, "en", "a"), (3, LONG_ONE, "en", "a"), (4, LONG_OTHER, "en", "a"), (5, ONE, "en", "a")]
    got = sorted((r.doc_id, r.n_links, r.component_id) for r in lsh_forest.join(frame(spark, rows)).collect())
    assert [g for g in got if g[0] in (1, 2, 5)] == [(1, 1, 1), (2, 0, 2), (5, 1, 1)]
    assert {r.class_id for r in lsh_forest.join(frame(spark, rows)).collect()} == {1, 2, 3, 4}
    assert got == sorted(jaccard_groups(rows))


def test_windows_tell_long_words_apart(spark):
    before = [f"w{i}" for i in range(60)]
    rows = [(d, " ".join([*before, word, *before[::-1]]), "en", "a") for d, word in ((1, ONE), (2, OTHER))]
    got = [tuple(r) for r in cover_dedup.digests(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(without_repeats(rows)) and {r[2] for r in got} == {0, 120}


def test_pre_tokens_are_told_apart():
    own = piece_encoder.PieceEncoder(rans_store.TOKENIZER)
    rows = [ONE, OTHER, ONE]
    ids, count = own.encode(Texts(pa.record_batch({"text": rows})))
    assert [x.tolist() for x in np.split(ids, np.cumsum(count))[:-1]] == [own.tokenizer.encode(r, add_special_tokens=False).ids for r in rows]


@pytest.mark.parametrize("remembered", [0, 7, 1 << 18])
def test_what_a_task_remembers_does_not_change_the_result(monkeypatch, remembered):
    """Two tasks, in this process: what they send is reduced here as the query does it."""
    monkeypatch.setattr(cover_dedup, "REMEMBERED", remembered)
    monkeypatch.setattr(cover_dedup, "STEP", 2000)
    rng = np.random.default_rng(8)
    passages = [[f"p{k}-{i}" for i in range(70)] for k in range(4)]
    rows = []
    for d in rng.permutation(90).tolist():
        text = [f"u{d}-{i}" for i in range(int(rng.integers(0, 30)))]
        for k in rng.integers(0, 4, 2).tolist():
            text += passages[k][int(rng.integers(0, 15)) :] + [f"v{d}"]
        rows.append((d if d % 9 else 9, " ".join(text), "en", "a"))  # some rows share a doc_id
    sent, marks = [], iter(range(len(rows)))
    for task in (rows[:45], rows[45:]):
        places = [list(range(len(t.split()))) for _, t, *_ in task]
        batch = pa.record_batch({"doc_id": [r[0] for r in task], "text": [r[1] for r in task], "mark": [next(marks) for _ in task], "places": pa.array(places, pa.list_(pa.int32()))})
        for out in cover_dedup._windows(iter([batch])):
            sent += zip(*(out.column(c).to_pylist() for c in ("h1", "h2", "doc_id", "at", "later")), strict=True)
    least = {}
    for h1, h2, doc, _, _ in sent:
        least[h1, h2] = min(doc, least.get((h1, h2), doc))
    gone = {(at >> 32, (at & 0xFFFFFFFF) >> 1) for h1, h2, doc, at, later in sent if later or least[h1, h2] < doc}
    first = {}
    at_all = [(doc, i, k, tuple(w[k : k + 50])) for i, (doc, t, *_) in enumerate(rows) for w in [t.split()] for k in range(len(w) - 49)]
    for doc, _, _, key in at_all:
        first[key] = min(doc, first.get(key, doc))
    assert gone == {(i, k) for doc, i, k, key in at_all if first[key] < doc} and len(gone) > 1000


def test_a_passage_goes_to_one_place_once_for_each_task(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    batch = pa.record_batch({"doc_id": list(range(400)), "text": [f"{passage} u{d}" for d in range(400)], "mark": [0] * 400})

    def most(remembered):
        keep, cover_dedup.REMEMBERED, step, cover_dedup.STEP = cover_dedup.REMEMBERED, remembered, cover_dedup.STEP, 3000
        try:
            h = [x for out in cover_dedup._anchors(iter([batch])) for x in out.column("h").to_pylist()]
        finally:
            cover_dedup.REMEMBERED, cover_dedup.STEP = keep, step
        return max(np.unique(h, return_counts=True)[1])

    assert most(1 << 18) == 1 and most(0) > 10


def test_a_lookup_deals_hot_keys_out(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_KEYS", 20)
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    rows = spark.range(1000).selectExpr("id", "if(id % 3 = 0, -1, id % 40) AS k")
    of = save(spark.range(-1, 35).selectExpr("id AS k", "id * 10 AS v"), "of")
    for how in ("inner", "left"):
        got = sorted(map(tuple, lookup(rows, of, ["k"], how).select("id", "k", "v").collect()))
        assert got == sorted(map(tuple, rows.join(of, "k", how).select("id", "k", "v").collect()))


def test_steps_remove_what_they_have_saved(spark):
    with Steps(spark) as steps:
        gone = save(spark.range(3).toDF("x"), "gone")
        kept = steps.keep(gone.withColumn("y", gone.x * 2), "kept")
    assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        gone.count()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Conf:
        get = staticmethod(lambda name, default=None: default)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_paths_are_cut_as_far_as_the_target_asks():
    for recall in (0.9, 0.999, 0.9999):
        floor = lsh_forest.prefix_length(0.8, 20, recall=recall)
        for crowded in range(1, 21):
            rest = lsh_forest.shortened(0.8, crowded, 20, floor, recall)
            lengths = [floor] * (20 - crowded) + [floor + x for x in rest]
            assert rest == sorted(rest) and len(rest) == crowded
            assert lsh_forest.missed(0.8, lengths) <= 1 - recall
        assert lsh_forest.shortened(0.8, 1, 20, floor, recall)[0] > 0


@pytest.mark.parametrize("crowded", [4, 64])
def test_recall_of_the_forest(spark, monkeypatch, crowded):
    """Families of texts at all similarities around the threshold, which share a common passage with others."""
    monkeypatch.setattr(lsh_forest, "CROWDED", crowded)
    rng = np.random.default_rng(12)
    rows, common_words = [], [f"c{i}" for i in range(60)]
    for f in range(40):
        base = [f"f{f}-{i}" for i in range(80)]
        for _ in range(8):
            w = list(base)
            for at in rng.integers(0, 80, int(rng.integers(0, 4))).tolist():
                w[at] = f"z{len(rows)}"
            rows.append((len(rows), " ".join(common_words + w), "en", "a"))
    rows = [(d, t, lang, s) for d, t, lang, s in rows]
    want = jaccard_groups_fast(rows)
    got = {r.doc_id: r.n_links for r in lsh_forest.join(frame(spark, rows)).collect()}
    links = sum(want.values())
    assert links > 500 and all(got[d] <= n for d, n in want.items())
    print("recall", sum(got.values()) / links)
    assert sum(got.values()) >= 0.999 * links


def jaccard_groups_fast(rows):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t, *_ in rows)]
    return {rows[i][0]: sum(i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}


def test_chains_of_similar_texts_stay_in_small_groups(spark):
    """Each text is similar to its neighbours in the chain, so that all are one component; no group holds them all."""
    w = [f"w{i}" for i in range(1300)]
    rows = [(i, " ".join(w[4 * i : 4 * i + 100]), "en", "a") for i in range(300)]
    docs = frame(spark, rows)
    made = lsh_forest._signatures(20, 4)
    marked = docs.selectExpr("doc_id", "text", "0L AS mark").toArrow().to_batches()
    signed = pa.Table.from_batches([b for batch in marked for b in made(iter([batch]))])
    held = spark.createDataFrame(signed).selectExpr("doc_id AS rep", "top", "rest")
    groups = lsh_forest._groups(lsh_forest._leaves(held, 0.8, 20, 4, 0.9999)).groupBy("group").count().collect()
    assert max(r["count"] for r in groups) < 60
    got = {r.doc_id: (r.n_links, r.component_id) for r in lsh_forest.join(docs).collect()}
    want = jaccard_groups_fast(rows)
    assert sum(n for n, _ in got.values()) >= 0.999 * sum(want.values()) and {c for _, c in got.values()} == {0}


def test_class_digests():
    raw = b" a  b\tc "
    assert lsh_forest._class(raw) == lsh_forest._class(b"a b c") != lsh_forest._class(b"ab c")
    assert len(hashlib.blake2b(raw, digest_size=16).digest()) == len(lsh_forest._class(raw))
    assert table is common.table
