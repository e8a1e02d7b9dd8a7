import hashlib
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from boundwise.llm import chunk_bpe, mixing, subword_quality
from boundwise.llm.common import save, shared_dir, table
from test_texts import jaccard_groups, without_repeats, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output."""
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = save(stage(spark, docs, SF), name)
        out[name], docs = (docs, made), made
    return out


def test_run_is_its_stages(spark, stages):
    folder = Path(shared_dir(spark).removeprefix("file://"), "boundwise")
    before = set(folder.iterdir())
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert [p.name.split("-")[0] for p in set(folder.iterdir()) - before] == ["tokens"]
    assert got == sorted(map(tuple, stages["tokens"][1].collect()))
    columns = table(spark, SF, "documents").columns
    assert all(stages[name][1].columns == columns for name, _ in corpus_pipeline.STAGES[:-1])


def test_quality(spark, stages):
    docs, kept = stages["quality"]
    model = subword_quality.train(docs, table(spark, SF, "labels"))
    good = {r.doc_id for r in subword_quality.scored(docs, model).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == good
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert np.mean([d in good for d, q in labels.items() if q == 1]) >= 0.99


def test_near_duplicates(stages):
    docs, kept = stages["near_duplicates"]
    groups = jaccard_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, c in groups if d == c)


def test_repeated_passages(stages):
    docs, kept = stages["repeated_passages"]
    want = {d: sha for d, _, _, sha in without_repeats([(r.doc_id, r.text) for r in docs.collect()])}
    got = {r.doc_id: hashlib.sha256(" ".join(words(r.text)).encode()).hexdigest() for r in kept.collect()}
    assert got == want


def test_mix(stages):
    docs, out = stages["mix"]
    taken = {r.doc_id: r.taken for r in mixing.quotas(docs).collect() if r.taken}
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
    assert got == taken


def test_tokens(stages):
    docs, out = stages["tokens"]
    want = []
    for r in docs.collect():
        ids = chunk_bpe.encoding().encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest(), np.array(ids, "<u4").tobytes()))
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
