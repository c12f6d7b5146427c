import math
import random
import re
from collections import Counter

import numpy as np

from fathom.llm import ranked_search
from fathom.llm.ranked_search import nra, rank_lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item in {i for i, _ in items}:
        asked = {t for i, text in items if i == item for t in terms(text)}
        scores = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def made():
    rng = random.Random(4)
    words = [*"abcdefgh", "Zebra", "ZEBRA", "été", "x1", "1", "wörd", "日本"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "_", "\x00"]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 30))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "---"), (303, "zebra " * 50_000), (304, "only"), (None, "zebra nameless"), (5, docs[7][1]), (5, docs[7][1])]
    items = [(1, "zebra été"), (2, None), (3, ""), (4, "unknown words"), (5, text(40)), (5, "日本 日本 A"), (6, "only"), (None, "b c"), (7, "a " * 1000)]
    return docs, items


def run(spark, docs, items, **options):
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], "doc_id long, text string, rank int, score string").repartition(5)
    items = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    return sorted(map(tuple, rank_lexical(docs, items, **options).collect()), key=str)


def test_equals_brute_force(spark, monkeypatch):
    docs, items = made()
    want = brute_force(docs, items)
    assert want and run(spark, docs, items) == want
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", 16)  # many shards, blocks of items and an index of all terms
    assert run(spark, docs, items, block_terms=3, sent_terms=2) == want
    assert run(spark, docs, items, k=2) == brute_force(docs, items, 2)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a")], []) == [] and run(spark, [(1, "a"), (2, None)], [(1, "a b")]) == brute_force([(1, "a"), (2, None)], [(1, "a b")])


def test_reading_stops_early_with_exact_scores(monkeypatch):
    monkeypatch.setattr(ranked_search, "FIRST_DEPTH", 2)
    rng = np.random.default_rng(3)
    for trial in range(300):
        n_docs, k = int(rng.integers(1, 60)), int(rng.integers(1, 6))
        lists = [rng.permutation(n_docs)[: rng.integers(0, n_docs + 1)] for _ in range(rng.integers(1, 6))]
        impacts = [np.sort(rng.integers(1, 12, len(x)))[::-1] for x in lists]
        total = np.zeros(n_docs, np.int64)
        for d, i in zip(lists, impacts, strict=True):
            total[d] += i
        end = np.cumsum([len(x) for x in lists])
        begin = end - [len(x) for x in lists]
        mark = int(rng.integers(1, 25))
        found, scores = nra(begin, end, np.concatenate(lists).astype(np.int64), np.concatenate(impacts).astype(np.int64), n_docs, k, mark)
        assert (scores == total[found]).all()
        best = [d for d in np.lexsort((np.arange(n_docs), -total))[:k] if total[d] >= mark]
        assert set(best) <= set(found.tolist()), trial


def test_deep_lists_are_not_read_to_the_end():
    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.dtype.kind == "i":
                Counted.read += len(at)
            return np.ndarray.__getitem__(self, at)

    n = 100_000
    docs = np.concatenate([np.arange(n), np.arange(n)])
    impacts = np.concatenate([np.arange(n, 0, -1)] * 2)
    found, scores = nra(np.array([0, n]), np.array([n, 2 * n]), docs.view(Counted), impacts, n, 10, 1)
    assert {0, 1, 9} <= set(found.tolist()) and scores.max() == 2 * n and Counted.read < 2000
