import random
import re
import time

import numpy as np

from fathom.llm import decontaminate as D
from fathom.llm.words import mix


def greedy(item, doc, least=D.SEED):
    """Tiling by its definition: the longest unmarked common run, again and again."""
    free_item, free_doc, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(doc)):
                n = 0
                while p + n < len(item) and t + n < len(doc) and item[p + n] == doc[t + n] and free_item[p + n] and free_doc[t + n]:
                    n += 1
                if n > best[2]:
                    best = (p, t, n)
        p, t, n = best
        if n < least:
            return out
        out.append(best)
        free_item[p : p + n] = [False] * n
        free_doc[t : t + n] = [False] * n


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", low)


def leaks(docs, items, coverage=D.COVERAGE):
    """{(doc_id, item_id): (covered, words, tiles)} by the definition, for pairs that share a seed."""
    out = {}
    for item_id, item_text in items:
        item = plain_words(item_text)
        seed = min(D.SEED, len(item))
        runs = {tuple(item[i : i + seed]) for i in range(len(item) - seed + 1)} if item else set()
        for doc_id, text in docs:
            doc = plain_words(text)
            if any(tuple(doc[i : i + seed]) in runs for i in range(len(doc) - seed + 1)):
                found = greedy(item, doc, seed)
                row = (sum(n for _, _, n in found), len(item), len(found))
                if row[0] >= coverage * len(item):
                    out[doc_id, item_id] = max(out.get((doc_id, item_id), row), row)
    return out


def test_tiles_equal_the_definition():
    rng, tokens = np.random.default_rng(0), mix(np.arange(1, 50, dtype=np.uint64))
    for _ in range(300):
        kinds = int(rng.integers(1, 8))
        item, doc = tokens[rng.integers(0, kinds + 1, rng.integers(0, 25))], tokens[rng.integers(0, kinds + 1, rng.integers(0, 40))]
        assert D.tiles(item, doc, 3) == greedy(item.tolist(), doc.tolist(), 3)


def test_long_repetitive_texts_take_linear_time():
    tokens = mix(np.arange(1, 50, dtype=np.uint64))
    for item, doc in ((np.zeros(400, int), np.zeros(1_000_000, int)), (np.arange(400) % 7, np.arange(1_000_000) % 7)):
        began = time.perf_counter()
        assert D.tiles(tokens[item], tokens[doc]) == [(0, 0, 400)]
        assert time.perf_counter() - began < 20
    rng = np.random.default_rng(1)
    item, doc = tokens[rng.integers(0, 3, 400)], tokens[rng.integers(0, 3, 300_000)]
    free_item, free_doc, before = np.ones(len(item), bool), np.ones(len(doc), bool), len(item)
    for p, t, n in D.tiles(item, doc):
        assert n <= before and (item[p : p + n] == doc[t : t + n]).all() and free_item[p : p + n].all() and free_doc[t : t + n].all()
        free_item[p : p + n], free_doc[t : t + n], before = False, False, n
    windows = lambda x, free: {tuple(x[i : i + D.SEED].tolist()) for i in range(len(x) - D.SEED + 1) if free[i : i + D.SEED].all()}
    assert not windows(item, free_item) & windows(doc, free_doc)


def test_blocks_of_any_size_give_the_definition(spark):
    """One block or many: the same pairs and the same rows left, null and repeated ids included."""
    rng = random.Random(4)
    some = lambda n, kinds: " ".join(rng.choice("abcdefghijklmnop"[:kinds]) * 2 for _ in range(n))
    items = [(k, some(rng.randint(4, 30), rng.choice((2, 5, 16)))) for k in range(25)] + [(None, some(20, 16)), (25, "same " * 12), (26, "a b"), (27, None), (3, some(12, 16)), (28, "own"), (29, "Of its own!"), (30, "nothing"), (31, "words clean"), (32, "--")]
    rows = [(i, some(rng.randint(0, 60), 16) + " " + " ".join(rng.choice(items[:25])[1].split()[rng.randint(0, 5) :])) for i in range(40)]
    rows += [(2, "clean words of its own"), (None, items[4][1]), (None, "nothing"), (50, items[25][1] + "x " + "same " * 7), (51, None), (52, ""), (53, "same"), (54, "".join(items[25][1]))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = leaks(rows, items)
    gone = {i for i, r in enumerate(rows) if leaks([(0, r[1])], items)}
    for limit in (D.BLOCK_CHARS, 900):
        found = {(r.doc_id, r.item_id): (r.covered, r.item_words, r.tiles) for r in D.contaminated(docs, bench, block_chars=limit).collect()}
        assert found == expected and len(expected) > 30
        left = [tuple(r) for r in D.drop_contaminated(docs, bench, block_chars=limit).collect()]
        assert sorted(left, key=str) == sorted((r for i, r in enumerate(rows) if i not in gone), key=str)


def test_repeated_seed_of_one_item(spark):
    """An item that repeats a run: its only shared seed covers several of its places."""
    docs = spark.createDataFrame([(1, "x y a b c d q"), (2, "a b c d a b c d a b c d"), (2, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d e a b c d")], "item_id long, text string")
    expected = leaks([(r.doc_id, r.text) for r in docs.collect()], [(7, "a b c d e a b c d")], 0.4)
    found = {(r.doc_id, r.item_id): (r.covered, r.item_words, r.tiles) for r in D.contaminated(docs, bench, 0.4).collect()}
    assert found == expected and set(found) == {(1, 7), (2, 7)}
    assert sorted(r.text for r in D.drop_contaminated(docs, bench, 0.4).collect()) == ["clean"]
