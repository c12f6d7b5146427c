"""The pipeline against a brute-force version, stage by stage on each stage's own input."""

import hashlib
import math
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

import corpus_pipeline
from fathom.llm import quality
from fathom.llm.secrets import find_secrets
from fathom.llm.words import pieces
from test_decontaminate import leaks
from test_near_dedup import brute_force


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Rows before and after every stage, each written and read as the driver does."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        found.append(docs.collect())
    return found


def test_shape(spark, sf_dir, stages):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    assert all(list(rows[0].asDict()) == columns for rows in stages[:-1])


def test_quality_stage(spark, sf_dir, stages):
    table = quality.fit_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    expected = set()
    for r in stages[0]:
        for piece in pieces(pa.array([r.text])):
            grams = quality.gram_lists(piece)[0]
            margin = sum(map(float, table[grams])) / max(1, len(grams))
        if (r.text or "").split() and 1 / (1 + math.exp(-margin)) >= 0.7:
            expected.add(r.doc_id)
    assert {r.doc_id for r in stages[1]} == expected and len(expected) < len(stages[0])


def test_near_dedup_stage(stages):
    expected = brute_force([(r.doc_id, r.text) for r in stages[1]])
    assert {r.doc_id for r in stages[2]} == {i for i, (_, _, kept) in expected.items() if kept}


def test_decontamination_stage(spark, sf_dir, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = {doc_id for doc_id, _ in leaks([(r.doc_id, r.text) for r in stages[2]], items)}
    assert {r.doc_id for r in stages[3]} == {r.doc_id for r in stages[2]} - gone and gone


def test_secret_stage(stages):
    before = {r.doc_id: r for r in stages[3]}
    assert {r.doc_id for r in stages[4]} == set(before)
    for r in stages[4]:
        spans = find_secrets(before[r.doc_id].text)
        assert (r.text == before[r.doc_id].text) == (not spans) and not find_secrets(r.text) and r.n_chars == len(r.text)


def test_mixing_stage(stages):
    docs, size = stages[4], defaultdict(int)
    for r in docs:
        size[r.source] += len(r.text)
    total = sum(size.values())
    share = {s: math.sqrt(n) for s, n in size.items()}
    copies = Counter(r.doc_id for r in stages[5])
    for r in docs:
        rate = share[r.source] * total / sum(share.values()) / size[r.source]
        point = int(hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        n, term = 0, math.exp(-rate)
        below = term
        while point >= below:
            n += 1
            term *= rate / n
            below += term
        assert copies[r.doc_id] == n
    keys = [r.shuffle_key for r in stages[5]]
    assert len(set(keys)) == len(keys)


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r["copy"]) for r in rows) == sorted((r.doc_id, r["copy"]) for r in stages[5])
