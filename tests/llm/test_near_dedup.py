import random
import re

from fathom.llm import graph, near_dedup
from fathom.llm.near_dedup import keep_one_of_each, near_duplicates

SCHEMA = "doc_id long, text string, component_id string, kept string"


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def made_rows():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 5)))
    base = [word() for _ in range(80)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one TWO"), (5, "one two three four five"), (6, "x"), (7, "x" * 200_000), (8, "wörd " * 30_000)]
    for i in range(10, 130):  # a chain of edits: neighbours are near, ends are not
        if i % 3 == 0:
            base[rng.randrange(80)] = word()
        rows.append((i, " ".join(base)))
    for i in range(130, 230):  # one group around one text
        own = base[:]
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(80)] = word()
        rows.append((i, "  ".join(own)))
    rows += [(i, " ".join(word() for _ in range(40))) for i in range(230, 260)]
    return rows


def test_equals_brute_force(spark):
    rows = made_rows()
    docs = spark.createDataFrame([(i, t, "clash", None) for i, t in rows], SCHEMA)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert found == brute_force(rows)


def test_keeps_one_of_each_and_empty_table(spark):
    rows = made_rows()[:40]
    docs = spark.createDataFrame([(i, t, "clash", None) for i, t in rows], SCHEMA)
    left = keep_one_of_each(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, (_, _, kept) in brute_force(rows).items() if kept}
    assert near_duplicates(docs.limit(0)).count() == 0


def test_repeated_rows_give_equal_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g")], "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates(docs).collect()) == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False)]


def test_rows_without_id_link_with_nothing(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g"), (2, "a b c d e f g"), (3, "a b c d e f g")], "doc_id long, text string")
    found = [tuple(r) for r in near_duplicates(docs).collect()]
    assert sorted(found, key=str) == sorted([(None, 3, None, True)] * 2 + [(2, 3, 2, True), (3, 3, 2, False)], key=str)
    assert keep_one_of_each(docs).count() == 3


def test_buckets_of_many_blocks_equal_brute_force(spark, monkeypatch):
    """Blocks of a few rows, so that most groups are stars whose rest visits other blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(3)
    rows = made_rows()
    base = rows[-1][1].split() * 2
    for i in range(300, 420):  # around one text, near and far from each other
        own = base[:]
        for _ in range(rng.randint(0, 7)):
            own[rng.randrange(80)] = f"w{rng.randrange(40)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert found == brute_force(rows)


def test_hubs_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 5)
    rng = random.Random(5)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 999) for i in range(60)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(7, 7), (3000, 3001), (3001, 3000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == {x: find(x) for x in root}
    other = spark.createDataFrame([(i, f"v{i}") for i in range(40)], "b long, value string")
    rows = spark.createDataFrame([(i, i % 3 if i % 2 else 17) for i in range(300)], "a long, b long")
    spread = graph.join_spread(rows, other, "b", 300)
    assert sorted(tuple(r) for r in spread.select("a", "b", "value").collect()) == sorted(tuple(r) for r in rows.join(other, "b").select("a", "b", "value").collect())
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
