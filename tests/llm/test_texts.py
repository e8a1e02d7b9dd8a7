import hashlib
import re
import zlib

import numpy as np
import pytest
from boundwise.llm import chunk_bpe, cover_dedup, lsh_forest, mixing, piece_encoder, queries, rans, rans_store
from boundwise.llm.common import Texts, Words, table, texts, word_hashes
from duck import assert_same
from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
#: doc_id, text, lang, source, n_chars, and columns whose names the operators use inside.
ODD = [
    (1, PASSAGE, "en", "a"),
    (2, f"before it {PASSAGE} behind it", "en", "b"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \t\n ", "en", ""),
    (6, "one", "en", "a"),
    (7, "one", "en", None),
    (8, LONG, "en", "b"),
    (9, "x " + LONG, "en", "b"),
    (10, "a b c \x1f d", "en", "c"),
    (11, PASSAGE, "en", "a"),
    (11, PASSAGE, "en", "a"),
    (11, "another text of the same id", "en", "a"),
    (None, PASSAGE, "en", "a"),
    (12, " ".join(["na"] * 300), "en", "\U0001f600"),
    (13, " ".join(["na"] * 120), "en", "z"),
    (14, "hello <|endoftext|> world", "en", "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark int, size int, taken string, row int, kept int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, 2, "x", 3, 4) for r in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


def words(text):
    return WORD.findall(text or "")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\x0b\x0c\r é", max_size=12), max_size=6))
def test_words(rows):
    t = Texts(pa.record_batch({"text": pa.array(rows, pa.string())}))
    w = Words(t)
    got = [[t.data[w.starts[k] : w.ends[k]].tobytes().decode() for k in range(w.first[i], w.first[i + 1])] for i in range(len(rows))]
    assert got == [words(r) for r in rows]
    flat = [x for r in got for x in r]
    h = word_hashes(t, w)
    assert len(set(h.tolist())) == len(set(flat))
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


def test_cover_has_every_difference():
    c, n = cover_dedup.COVER, cover_dedup.PERIOD
    assert {(a - b) % n for a in c for b in c} == set(range(n)) and cover_dedup.ANCHOR > 0


def without_repeats(rows, n=50):
    first = {}
    for doc, text, *_ in rows:
        if doc is not None:
            w = words(text)
            for i in range(len(w) - n + 1):
                key = tuple(w[i : i + n])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text, *_ in rows:
        w, gone = words(text), set()
        for i in range(len(w) - n + 1):
            if doc is not None and first[tuple(w[i : i + n])] < doc:
                gone.update(range(i, i + n))
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def test_repeats_of_odd_rows(spark):
    got = [tuple(r) for r in cover_dedup.digests(frame(spark, ODD)).collect()]
    assert sorted(got, key=str) == sorted(without_repeats(ODD), key=str)
    assert cover_dedup.digests(frame(spark, [])).collect() == []


def test_deduplicated_documents_keep_their_columns(spark):
    docs = frame(spark, ODD)
    out = cover_dedup.deduplicate(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    rows = out.collect()
    assert len(rows) == len(ODD) and all(r.mark == 1 and r["size"] == 2 and (r.n_chars or 0) == len(r.text or "") for r in rows)
    assert [r.text for r in rows if r.doc_id == 2] == ["before it behind it"] and [r.text for r in rows if r.doc_id == 1] == [PASSAGE]
    assert [r.text for r in rows if r.doc_id is None] == [PASSAGE]


def test_repeats_at_any_alignment(spark):
    rng = np.random.default_rng(3)
    rows = [(0, " ".join(f"s{i}" for i in range(90)), "en", "a")]
    for k in range(1, 70):
        n, start = int(rng.integers(45, 60)), int(rng.integers(0, 30))
        rows.append((k, " ".join([f"u{k}-{i}" for i in range(k)] + [f"s{i}" for i in range(start, start + n)] + [f"v{k}"]), "en", "a"))
    got = [tuple(r) for r in cover_dedup.digests(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(without_repeats(rows))


def jaccard_groups(rows):
    """(doc_id, n_links, component) by brute force, for rows with an id."""
    docs = [(d, words(t)) for d, t, *_ in rows]
    out = []
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, w in docs]
    n = len(docs)
    link = [[i != j and bool(docs[i][1]) and (docs[i][1] == docs[j][1] or bool(sets[i] and sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for j in range(n)] for i in range(n)]
    label = [d for d, _ in docs]
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    label[i] = label[j] = min(label[i], label[j])
    for i in range(n):
        out.append((docs[i][0], sum(link[i]), label[i]))
    return out


def test_join_of_odd_rows(spark):
    base = " ".join(f"k{i}" for i in range(200))
    rows = [r for r in ODD if r[0] != 11] + [(20, base, "en", "a"), (21, base + " and more", "en", "a"), (22, base.replace("k7 ", "q "), "en", "a"), (23, base, "en", "a"), (24, "k1 k2 k3 k4 k5 k6", "en", "a")]
    known = [r for r in rows if r[0] is not None]
    got = lsh_forest.join(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_links, r.component_id) for r in got if r.doc_id is not None) == sorted(jaccard_groups(known))
    assert [(r.class_id, r.n_links, r.kept) for r in got if r.doc_id is None] == [(None, 0, True)]
    assert lsh_forest.join(frame(spark, [])).collect() == []


def test_rows_of_one_id_do_not_break_the_join(spark):
    got = lsh_forest.join(frame(spark, ODD)).collect()
    assert len(got) == len(ODD) and sorted(r.component_id for r in got if r.doc_id == 11) == [1, 1, 11]
    out = lsh_forest.distinct(frame(spark, ODD))
    assert out.columns == frame(spark, ODD).columns
    assert {r.doc_id for r in out.collect()} == {1, 3, 4, 5, 6, 8, 10, 11, 12, 14, None}


@pytest.mark.parametrize("block", [1024, 16])
def test_large_groups_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(lsh_forest, "BLOCK_DOCS", block)
    rng = np.random.default_rng(4)
    base = [f"k{i}" for i in range(150)]
    rows = []
    for d in range(120):
        w = list(base)
        for at in rng.integers(0, 150, 3):
            w[at] = f"z{d}-{at}"
        rows.append((d, " ".join(w), "en", "a"))
    got = sorted((r.doc_id, r.n_links, r.component_id) for r in lsh_forest.join(frame(spark, rows)).collect())
    want = sorted(jaccard_groups(rows))
    assert [g[2] for g in got] == [w[2] for w in want] and sum(g[1] for g in got) >= 0.999 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("copies", [2, 3])
def test_blocks_of_a_group_may_be_empty(spark, monkeypatch, copies):
    monkeypatch.setattr(lsh_forest, "BLOCK_BYTES", 1000)
    rows = [(10 * g + k, " ".join(f"g{g}-{i}" for i in range(120)) + f" end{k}", "en", "a") for g in range(12) for k in range(copies)]
    got = lsh_forest.join(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_links, r.component_id) for r in got) == [(d, copies - 1, d // 10 * 10) for d, *_ in rows]


def test_prefixes_get_shorter_with_the_target():
    lengths = [lsh_forest.prefix_length(0.8, recall=r) for r in (0.5, 0.95, 0.999, 0.9999, 0.9999999)]
    assert lengths == sorted(lengths, reverse=True) and lengths[0] == lsh_forest.LONGEST and lengths[-1] < 4


def test_mix_of_odd_rows(spark):
    docs = frame(spark, ODD)
    got = mixing.quotas(docs).collect()
    assert len(got) == len(ODD) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert sorted(r["size"] for r in got) == sorted(len(words(t)) for _, t, *_ in ODD)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    taken = {}
    for r in got:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    mixed = {}
    for r in rows:
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + len(words(r.text))
        assert r.n_chars == len(r.text) and r["size"] == 2 and r.taken == "x"
    assert mixed == {d: n for d, n in taken.items() if n}
    assert mixing.quotas(frame(spark, [])).collect() == [] and mixing.mixed(frame(spark, [])).collect() == []


def test_mix_reaches_its_targets(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    rows, again = mixing.quotas(docs).collect(), mixing.quotas(docs.repartition(5)).collect()
    assert sorted(rows) == sorted(again)
    by, total = {}, sum(r["size"] for r in rows)
    for r in rows:
        by[(r.source_size, r.target)] = by.get((r.source_size, r.target), 0) + r.taken
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1
    assert all(t <= 2 * s and abs(n - t) <= 0.01 * t + 200 for (s, t), n in by.items())


def test_rows_without_doc_id_spread_over_shards(spark):
    rows = [(None if i % 3 else i, " ".join(["w"] * (i % 40 + 1)), "en", "a") for i in range(600)]
    docs = frame(spark, rows).select("doc_id", "source", mixing.n_words("text").alias("size"))
    got = mixing.plan(docs, shard_docs=50).groupBy("lo").count().count()
    per_source = mixing.quotas(frame(spark, rows), shard_docs=50).collect()
    taken, target = sum(r.taken for r in per_source), per_source[0].target
    assert got > 12 and abs(taken - target) <= 64 * 12 + 0.02 * target


def test_seats_go_to_the_highest_quotients(spark):
    rng = np.random.default_rng(6)
    for seats in (1, 7, 100):
        votes = [float(x) for x in rng.integers(0, 1000, 13)]
        got = {r.k: r.got for r in mixing.sainte_lague(spark.createDataFrame([(1, k, v, seats) for k, v in enumerate(votes)], "g int, k int, v double, n long"), ["g"], "k", "v", "n").collect()}
        want = dict.fromkeys(range(13), 0)
        for _ in range(seats):
            want[max(want, key=lambda k: (votes[k] / (2 * want[k] + 1), -k))] += 1
        assert got == want


def ids_of(text):
    return chunk_bpe.encoding().encode_ordinary(text or "")


def test_bpe_of_odd_rows(spark, monkeypatch):
    rows = [*ODD, (30, "a" * 70_000, "en", "a"), (31, "\n" * 70_000 + "end", "en", "a"), (32, "\U0001f600 漢字 <|endoftext|>", "en", "a")]
    got = [tuple(r) for r in chunk_bpe.digests(frame(spark, rows)).collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(d, len(ids_of(t)), sha(",".join(map(str, ids_of(t))).encode()), sha((t or "").encode())) for d, t, *_ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert chunk_bpe.digests(frame(spark, [])).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'srelvt 1²\n\t.!éあ", max_size=120), st.integers(5, 30), st.integers(2, 20))
def test_chunks_meet(text, chunk, overlap):
    assert chunk_bpe.encode(text, chunk, min(chunk, overlap)) == ids_of(text)
    assert chunk_bpe.decode(ids_of(text)) == text.encode()


@pytest.fixture(scope="module")
def pieces():
    return piece_encoder.PieceEncoder(rans_store.TOKENIZER)


@settings(max_examples=300, deadline=None)
@given(rows=st.lists(st.text(alphabet="abs'tSrelvmd 12²\n\t\r.!-é́ אあ<|>", max_size=40), max_size=8))
def test_pieces(pieces, rows):
    t = Texts(pa.record_batch({"text": pa.array(rows, pa.string())}))
    ids, count = pieces.encode(t)
    want = [e.ids for e in pieces.tokenizer.encode_batch(rows, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(count))[:-1]] == want


def test_added_tokens_in_texts():
    from tokenizers import Tokenizer

    rows = ["a<|endoftext|> b", "<|endoftext|>", None, "<|endof", "text|> plain"]
    ids, count = piece_encoder.PieceEncoder(rans_store.TOKENIZER).encode(Texts(pa.record_batch({"text": pa.array(rows, pa.string())})))
    own = Tokenizer.from_file(rans_store.TOKENIZER)
    want = [own.encode(t or "", add_special_tokens=False).ids for t in rows]
    assert want[1] == [50256] and [x.tolist() for x in np.split(ids, np.cumsum(count))[:-1]] == want


def test_pieces_are_forgotten(pieces, monkeypatch):
    monkeypatch.setattr(piece_encoder, "KEPT", 50)
    rows = [f"new{i} and old{i % 3}" for i in range(300)]
    for t in texts(iter([pa.record_batch({"text": pa.array(rows)})]), step=200):
        ids, _ = pieces.encode(t)
        assert ids.tolist() == [i for k in range(len(t)) for i in pieces.tokenizer.encode(t.raw(k).decode(), add_special_tokens=False).ids]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=700), st.integers(1, 300))
def test_blocks_round_trip(ids, block):
    ids = np.array(ids, np.uint32)
    f = rans.quantised(np.bincount(ids, minlength=50)).astype("<u4").tobytes()
    parts = rans.encode_blocks(ids, f, block)
    assert np.array_equal(rans.decode_blocks(parts, f), ids)
    if parts:
        data, n, crc = parts[0]
        with pytest.raises(ValueError):
            rans.decode_blocks([(data, n, crc ^ 1)], f)


def test_a_rare_id_among_many():
    counts = np.full(50_257, 1)
    counts[7] = 10**12
    f = rans.quantised(counts)
    assert f.sum() == 1 << rans.SCALE and f.min() == 1


def test_store_of_odd_rows(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(rans_store.TOKENIZER)
    enc = {t: own.encode(t or "", add_special_tokens=False).ids + [rans_store.END_ID] for _, t, *_ in ODD}
    got = sorted(rans_store.digests(frame(spark, ODD)).collect(), key=lambda r: r.start)
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, len(enc[r[1]])))
    start, want = 0, []
    for d, t, *_ in rows:
        want.append((d, start, len(enc[t]), zlib.crc32(np.array(enc[t], "<u4").tobytes())))
        start += len(enc[t])
    assert [tuple(r) for r in got] == want
    assert rans_store.digests(frame(spark, [])).collect() == []


def test_blocks_are_read_from_their_checkpoints():
    ids = [np.arange(100, dtype=np.uint32) % 7, np.arange(50, dtype=np.uint32) % 5]
    f = rans.quantised(np.bincount(np.concatenate(ids))).astype("<u4").tobytes()
    segment = rans_store.pack([4, 9], ids, 1000, f, block=32)
    docs, counts, place, every = rans_store.unpack(segment, f)
    assert docs.tolist() == [4, 9] and counts.tolist() == [100, 50] and place == 1000
    assert rans_store.unpack(segment, f, range(2, 4))[3].tolist() == every[64:128].tolist() == np.concatenate(ids)[64:128].tolist()
    with pytest.raises(ValueError):
        rans_store.unpack(segment, f + b"\0\0\0\0")


@pytest.mark.parametrize("buckets", ["1", "2", "3", "8", "37"])
def test_any_number_of_buckets_gives_the_same_sequence(spark, buckets):
    rows = [(None if i % 50 == 7 else (i * 37) % 211 - 50, f"text {i % 13}", "en", "a") for i in range(211)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", buckets)
    try:
        got = [r.doc_id for r in sorted(rans_store.digests(frame(spark, rows)).collect(), key=lambda r: r.start)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))


def test_rows_of_one_doc_id_or_none_are_spread(spark):
    rng = np.random.default_rng(2)
    tokens = spark.createDataFrame([(None if i % 3 == 0 else 7 if i % 3 == 1 else i, int(rng.integers(1, 500))) for i in range(3000)], "doc_id long, n long")
    bounds = rans_store._bounds(tokens, 30)
    keys = [(r.doc_id is not None, r.doc_id or 0, r.n) for r in tokens.collect()]
    held = np.bincount([sum(b < k for b in bounds) for k in keys])
    assert bounds == sorted(bounds) and held.max() < 400 and len(bounds) <= 60
    assert rans_store._bounds(tokens.limit(0), 30) == []
