import numpy as np

from fathom.operators import parzen as Z

CLUSTERS = [[f"{c}{k}" for k in range(6)] for c in "abcdefgh"]


def worth(names, seed):
    """A score with an optimum that few sets reach: gains by factor, a cost per factor, one bad pair."""
    rng = np.random.default_rng(seed)
    gain = {f: g for c in CLUSTERS for f, g in zip(c, rng.normal(0, 1, 6), strict=True)}
    return sum(gain[f] for f in names) - 0.3 * len(names) - (2.0 if {CLUSTERS[0][0], CLUSTERS[1][0]} <= set(names) else 0.0)


def scorer(seed, calls=None):
    def score(sets):
        if calls is not None:
            calls.append(sorted("|".join(s) for s in sets))
        return {"|".join(s): worth(s, seed) for s in sets}

    return score


def test_resumed_search_gives_the_trials_of_an_uninterrupted_one(spark, tmp_path):
    whole = Z.parzen_search(spark, CLUSTERS, scorer(1), 40, 8, startup=16)
    log, calls = str(tmp_path / "log"), []
    part = Z.parzen_search(spark, CLUSTERS, scorer(1, calls), 40, 8, path=log, stop=lambda b: b == 3, startup=16)
    assert part == whole[:24] and Z.logged(spark, log, 8) == part
    spark.createDataFrame([(24, "a0", "0", 9.0)], Z.LOG).write.json(f"{log}/batch=3")  # a batch that was not finished
    before = len(calls)
    assert Z.parzen_search(spark, CLUSTERS, scorer(1, calls), 40, 8, path=log, startup=16) == whole
    assert before < len(calls) <= before + 2
    before = len(calls)
    again = Z.parzen_search(spark, CLUSTERS, scorer(1, calls), 40, 8, path=log, startup=16)
    assert again == whole and len(calls) == before
    scored = [s for c in calls for s in c]
    assert len(scored) == len(set(scored))


def test_beats_random_at_equal_trials(spark):
    better, gap = 0, []
    for seed in range(12):
        ours = max(t.score for t in Z.parzen_search(spark, CLUSTERS, scorer(seed), 96, 8, seed=seed, startup=16))
        plain = max(t.score for t in Z.parzen_search(spark, CLUSTERS, scorer(seed), 96, 8, seed=seed, startup=10_000))
        better += ours > plain
        gap.append(ours - plain)
    assert better >= 10 and np.mean(gap) > 0.5


def test_edges(spark):
    assert Z.parzen_search(spark, CLUSTERS, scorer(0), 0) == [] and Z.as_table(spark, []).count() == 0
    one = Z.parzen_search(spark, [["x"]], lambda sets: {"x": 1.0}, 30, 5, startup=5)
    assert {(t.set_id, t.score) for t in one} == {("x", 1.0), ("", Z.EMPTY)} and one[-1].set_id == "x"
    must = Z.parzen_search(spark, [["x"]], lambda sets: {"|".join(s): float(len(s)) for s in sets}, 10, 5, must=["m"])
    assert {t.set_id for t in must} == {"m", "m|x"}
    assert [r.best for r in Z.as_table(spark, must).orderBy("number").collect()][-1] == 2.0
