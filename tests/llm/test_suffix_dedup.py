import hashlib
import random
from collections import Counter

import numpy as np

from fathom.llm import suffix_dedup as module
from fathom.llm.suffix_array import common_prefixes, suffix_array
from fathom.llm.suffix_dedup import removal_report, suffix_dedup


def brute_force(texts, length=200):
    raw = [(t or "").encode() for _, t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for (doc_id, _), r in zip(texts, raw, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(r)))
        out.append((doc_id, len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], "doc_id long, text string, spans string, id int").repartition(4)
    return sorted(map(tuple, removal_report(suffix_dedup(docs, **options)).collect()), key=str)


def made():
    rng = random.Random(2)
    line = lambda n: "".join(rng.choice("abcdé 日\n") for _ in range(n))
    passage, notice = line(260), line(150)
    texts = [(i, line(rng.randint(0, 300)) + rng.choice([passage, notice, "", passage[: rng.randint(90, 260)]]) + line(rng.randint(0, 200))) for i in range(120)]
    whole = line(700)
    texts += [(200 + i, whole[: 30 * i] + "!" + whole[30 * i :]) for i in range(15)] + [(300, whole), (301, whole), (302, whole)]
    texts += [(400, None), (401, ""), (402, "x" * 199), (403, "x" * 200), (404, "y" * 201), (405, "ab" * 101), (406, ("row of words " * 30)), (407, "z" * 5000), (408, passage * 3)]
    return [*texts, (409, "\x00\x01" * 120), (7, texts[7][1]), (7, texts[7][1]), (None, line(400)), (None, passage), (410, "long " * 20_000 + passage)]


def test_equals_brute_force(spark, monkeypatch):
    texts = made()
    want = brute_force(texts)
    assert run(spark, texts) == want
    monkeypatch.setattr(module, "SHARD", 2000)  # many shards, short segments, strings that come last in later rounds too
    monkeypatch.setattr(module, "RUN", 50)
    monkeypatch.setattr(module, "HEAVY", 3000)
    monkeypatch.setattr(module, "FIT_BYTES", 3000)
    assert run(spark, texts) == want
    assert run(spark, texts, length=12) == brute_force(texts, 12)
    assert run(spark, texts[:60], length=1) == brute_force(texts[:60], 1)


def test_empty_table_and_no_repeats(spark):
    assert run(spark, []) == []
    texts = [(1, "short"), (2, "".join(map(chr, range(300, 700))))]
    assert run(spark, texts) == brute_force(texts)


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for trial in range(400):
        n, k = int(rng.integers(0, 70)), int(rng.integers(1, 6))
        text = np.append(rng.integers(1, k + 1, n), 0).astype(np.uint16)
        if trial % 4 == 0 and n > 6:
            text = np.append(np.tile(text[:3] + 1, n // 3), 0).astype(np.uint16)
        plain = text.tolist()
        order = suffix_array(text)
        assert order.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
        shared = common_prefixes(text, order)
        for r in range(1, len(plain)):
            a, b = int(order[r]), int(order[r - 1])
            n_same = 0
            while max(a, b) + n_same < len(plain) and plain[a + n_same] == plain[b + n_same]:
                n_same += 1
            assert shared[a] == n_same
