import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm.chat_format import canonical_turns, escape, fingerprint, format_chats, loss_text, read_back, turn_rows_as_records, unescape
from fathom.llm.embed_dedup import _turned, embedding_duplicates, fit_codes

RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None, "weight": 1}], "id": 4}, "messages", [("user", "hi"), ("assistant", "")]),
    ({"messages": []}, "messages", []),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "z"}], "system": "s", "extra": {"a": 1}}, "system_share", [("system", "s"), ("user", "q"), ("assistant", "z")]),
    ({"instruction": "i", "input": "", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "n", "output": "o"}, "instruction", [("user", "i\nn"), ("assistant", "o")]),
    ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"question": "q", "context": "c", "answer": "a"}, "question", [("user", "c\nq"), ("assistant", "a")]),
    ({"other": 1}, None, []),
    ([1, 2], None, []),
]


def test_layouts_map_to_canonical_turns(spark):
    rows = [(i, json.dumps(r), "clash") for i, (r, _, _) in enumerate(RECORDS)] + [(90, None, ""), (91, "not json", ""), (92, "", "")]
    found = {r.id: r for r in canonical_turns(spark.createDataFrame(rows, "id int, record string, layout string")).collect()}
    assert len(found) == len(rows)
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert (found[i].layout, [tuple(t) for t in found[i].turns]) == (layout, turns)
    assert all(found[i].layout is None and found[i].turns == [] for i in (90, 91, 92))


def test_fingerprints_tell_layouts_apart(spark):
    rows = spark.createDataFrame([(json.dumps(r),) for r, layout, _ in RECORDS if layout], "record string").select(F.parse_json("record").alias("v"))
    assert rows.select(fingerprint(F.col("v")).alias("f")).distinct().count() == 6


def test_escape_is_reversible(spark):
    rng = random.Random(3)
    bits = ["<|", "|>", "<|end|>\n", "<", "[", "\\", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "|", "a", "$1", "\n", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u and "<|" not in r.e and "</s>" not in r.e and "[INST]" not in r.e for r in rows)


def test_round_trip_and_loss(spark):
    rng = random.Random(5)
    bits = ["<|assistant|>\n", "<|end|>\n", "</s>[INST] ok [/INST]", "héllo", "\n", "<", "\\", ""]
    rows, said = [], {}
    for c in range(60):
        said[c] = [(rng.choice(["user", "assistant", "tool|x\n", ""]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))) for _ in range(rng.randint(1, 9))]
        rows += [(c, k, r or None, t or None, 0) for k, (r, t) in enumerate(said[c])]
    said[70] = [("assistant", "long " * 100_000)]
    rows.append((70, 0, "assistant", "long " * 100_000, 0))
    rng.shuffle(rows)
    records = turn_rows_as_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int"))
    made = format_chats(canonical_turns(records), "conv_id")
    read = made.select("conv_id", "n_turns", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(read) == len(said)
    for r in read:
        assert [tuple(t) for t in r.turns] == said[r.conv_id] and r.n_turns == len(said[r.conv_id])
        assert r.loss == "".join(t for role, t in said[r.conv_id] if role == "assistant")
    assert format_chats(canonical_turns(records.limit(0)), "conv_id").count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for label in range(3):
        centres = rng.normal(size=(12, 24))
        for i in range(200):
            v = centres[i % 12] + rng.normal(size=24) * rng.choice([0.05, 0.25, 0.3, 3])
            rows.append([float(x) for x in v.astype(np.float32)])
    data = [(i, v, i // 200, "x") for i, v in enumerate(rows)]
    data += [(1000 + i, rows[0], 0, "x") for i in range(30)]
    odd = [(2000, None, 1, ""), (2001, [], 1, ""), (2002, [0.0] * 24, 1, ""), (2003, [float("nan")] * 24, 1, ""), (2004, [None] + [1.0] * 23, 1, ""), (2005, rows[3], None, ""), (2006, [float("inf")] + [1.0] * 23, 1, ""), (2007, [1.0, 2.0], 1, ""), (2008, [2.0, 4.0], 1, ""), (None, rows[3], 0, "")]
    table = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, label int, digest string")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_duplicates(table).collect()}
    assert len(found) == len(data) + len(odd)
    unit = np.array([v for _, v, _, _ in data], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([x for _, _, x, _ in data])
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(linked, False)
    n = np.array([found[i][0] for i, _, _, _ in data])
    assert (n <= linked.sum(1)).all() and n.sum() >= 0.98 * linked.sum() and linked.sum() > 1000
    assert found[None] == (0, None, True)
    for i in (2000, 2001, 2002, 2003, 2004, 2005, 2006):
        assert found[i] == (0, i, True)
    assert found[2007] == (1, 2007, True) and found[2008] == (1, 2007, False)
    assert embedding_duplicates(table.limit(0)).count() == 0


def _vectors_around(rng, n, dim, share):
    """Unit vectors that have ``share`` of their energy in one common direction."""
    mean, own = rng.normal(size=dim), rng.normal(size=(n, dim))
    x = share**0.5 * mean / np.linalg.norm(mean) + (1 - share) ** 0.5 * own / np.linalg.norm(own, axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("share", [0, 0.3, 0.5, 0.7, 0.8])
def test_tables_find_pairs_at_the_threshold(share):
    """Pairs at cosine 0.93 to 0.95 that the fit has not seen, for any weight of the common mean."""
    rng = np.random.default_rng(int(10 * share))
    unit = _vectors_around(rng, 6000, 64, share)
    bucket = {}
    for n in (2_000, 50_000):
        codes = fit_codes(unit[:3000], np.zeros(3000, int), n, 0.93)
        for cosine in (0.93, 0.94, 0.95):
            for toward in (0, 1):
                x, y = unit[3000:], _turned(unit[3000:], cosine, np.random.default_rng(toward))
                a, b = codes.substrings(x, np.zeros(3000, int)), codes.substrings(y, np.zeros(3000, int))
                found = (a == b).any(1) & (np.bitwise_count(a ^ b).sum(1) <= codes.reach)
                assert found.mean() >= 0.98
        bucket[n] = n * (a[:-1] == a[1:]).mean()
    # 25 times as many vectors, but buckets far less than 25 times as large.
    assert bucket[50_000] < 8 * bucket[2_000], bucket


def test_common_mean_does_not_hide_links(spark):
    rng = np.random.default_rng(3)
    base = _vectors_around(rng, 700, 32, 0.7)
    near = _turned(base[:300], 0.935, rng)
    every = np.concatenate([base, near]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), i % 2 if i < 700 else (i - 700) % 2) for i, v in enumerate(every)], "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_duplicates(table).collect()}
    unit = every.astype(float) / np.linalg.norm(every.astype(float), axis=1, keepdims=True)
    label = np.array([i % 2 if i < 700 else (i - 700) % 2 for i in range(1000)])
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(linked, False)
    n = np.array([found[i][0] for i in range(1000)])
    assert (n <= linked.sum(1)).all() and n.sum() >= 0.98 * linked.sum() and linked.sum() >= 500
    assert np.mean([found[i][1] == found[700 + i][1] for i in range(300)]) >= 0.98


def test_very_long_turns_keep_their_conversation(spark, tmp_path):
    """One turn above what the JSON parser takes, as a table of turns and as JSON."""
    long = F.repeat(F.lit("lörem "), 3_600_000)
    turns = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant"), (1, 2, "user")], "conv_id long, turn long, role string")
    turns = turns.withColumn("text", F.when(F.col("turn") == 1, long).otherwise(F.concat(F.lit("hi "), "turn")))
    records = turn_rows_as_records(turns)
    whole = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.to_json(F.struct(long.alias("prompt"), F.lit("ok").alias("completion"))).alias("record"))
    sizes = lambda made: [tuple(r) for r in made.select("layout", F.transform("turns", lambda t: F.char_length(t["text"])).alias("n")).collect()]
    assert sizes(canonical_turns(records)) == [("messages", [4, 21_600_000, 4])]
    assert sizes(canonical_turns(whole)) == [("prompt", [21_600_000, 2])]
    assert [r.n_turns for r in format_chats(canonical_turns(records), "conv_id").select("n_turns").collect()] == [3]


def test_malformed_json_has_one_outcome_at_every_size(spark):
    for n in (5, 17_000_000):
        broken = spark.range(1).select(F.concat(F.lit('{"prompt": "'), F.repeat(F.lit("a"), n), F.lit('", }')).alias("record"))
        cut_off = spark.range(1).select(F.concat(F.lit('{"prompt": "'), F.repeat(F.lit("a"), n)).alias("record"))
        for rows in (broken, cut_off):
            assert [tuple(r) for r in canonical_turns(rows).select("layout", F.size("turns"), "unread").collect()] == [(None, 0, True)]
    rows = spark.createDataFrame([(None,), ("{}",), ("[1]",), ('{"prompt": "a", "completion": "b"}',)], "record string")
    assert [r.unread for r in canonical_turns(rows).collect()] == [False] * 4
