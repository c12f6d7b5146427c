"""Factor-set search queries over hourly bars: coefficients, guards, Sharpe ratios, refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.windows import Series, ratio
from fathom.operators import parzen as Z
from fathom.operators import search as R
from fathom.operators.frames import hourly_bars
from fathom.plans.registry import BARS, W, div, lag, query, roll, rounded

S = Series()
NAMES = ("close_position", "mom5", "rel_vol", "ret", "spread")
WINDOW = 30
CLUSTERS = (("mom5", "ret"), ("spread", "rel_vol"), ("close_position",))


def _wide(spark, sf_dir) -> DataFrame:
    """Five factors, the bar's return and a label per bar, over prices lifted so that returns are of one size."""
    bars = hourly_bars(spark, sf_dir).withColumns({c: F.col(c) + 100 for c in ("high", "low", "close")})
    made = bars.withColumns({
        "rn": S.rn().cast("long"), "total": F.count("*").over(Window.partitionBy("symbol")), "ret": S.ret("close"),
        "rel_vol": ratio("volume", S.mean("volume", 20)), "close_position": ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")), "mom5": ratio("close", S.lag("close", 5)) - 1,
        "spread": ratio(F.col("high") - F.col("low"), "close"), "label": ratio(S.lead("close", 3), "close") - 1,
    })
    return made.select("symbol", "ts", "rn", "total", *NAMES, "label")


def _long(wide: DataFrame, *more: str) -> DataFrame:
    return wide.unpivot(["symbol", "ts", "rn", "label", *more], list(NAMES), "factor", "value")


WIDE = f"""{BARS}, wide AS (SELECT symbol, ts, row_number() OVER {W()} - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS total, (close + 100) / ({lag('close')} + 100) - 1 AS ret, {div('volume', roll('avg', 'volume', 20))} AS rel_vol,
  {div('close - low', 'high - low')} AS close_position, (close + 100) / ({lag('close', 5)} + 100) - 1 AS mom5, (high - low) / (close + 100) AS spread, (lead(close, 3) OVER {W()} + 100) / (close + 100) - 1 AS label FROM bars)"""
PARTS = """edged AS (SELECT *, CAST(floor(total * 0.5::DOUBLE) AS BIGINT) AS b, CAST(floor(total * 0.8::DOUBLE) AS BIGINT) AS e FROM wide), counted AS (SELECT *, CASE WHEN e - b < 150 THEN 1 ELSE 3 END AS k FROM edged),
sized AS (SELECT *, greatest((e - b) // k, 1) AS size FROM counted), folded AS (SELECT *, least((rn - b) // size, k - 1) AS fold FROM sized),
placed AS (SELECT *, b + fold * size + 3 AS start, CASE WHEN fold = k - 1 THEN e ELSE b + (fold + 1) * size END - 1 AS stop FROM folded),
parts AS (SELECT * EXCLUDE (rn), rn - CASE WHEN rn < b THEN 0 WHEN rn >= e THEN e ELSE start END AS rn, CASE WHEN rn < b THEN -1 WHEN rn >= e THEN 99 ELSE fold END AS part FROM placed WHERE rn < b OR rn >= e OR (rn >= start AND rn < stop))"""
ALL_SETS = "RECURSIVE names AS (SELECT unnest(['close_position', 'mom5', 'rel_vol', 'ret', 'spread']) AS f), grown AS (SELECT [f] AS fs FROM names UNION ALL SELECT list_append(fs, f) FROM grown, names WHERE f > fs[-1] AND len(fs) < 3), sets AS (SELECT array_to_string(fs, '|') AS set_id, len(fs) AS n, unnest(fs) AS factor FROM grown)"


def _unpivot(source: str, columns: str) -> str:
    return f"SELECT * FROM (SELECT {columns}, {', '.join(NAMES)} FROM {source}) UNPIVOT INCLUDE NULLS (value FOR factor IN ({', '.join(NAMES)}))"


def _stepped(name: str, source: str, keys: str, window: int = WINDOW) -> str:
    """CTEs that end in ``name`` (keys, icir): coefficients of stepped windows over ``source`` (keys, rn, value, label)."""
    step = window // 5
    rank = lambda x: f"rank() OVER (PARTITION BY {keys}, w ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, w, {x}) - 1) / 2.0"
    return f"""{name}_n AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS cnt FROM {source}),
{name}_w AS (SELECT {keys}, value, label, unnest(range(CAST(greatest(0, ceil((rn - {window} + 1) / {step}::DOUBLE)) AS BIGINT), least(rn // {step}, (cnt - {window}) // {step}) + 1)) AS w FROM {name}_n WHERE cnt >= {max(window, 30)} AND value IS NOT NULL AND label IS NOT NULL),
{name}_r AS (SELECT {keys}, w, {rank('value')} AS ra, {rank('label')} AS rb FROM {name}_w), {name}_i AS (SELECT {keys}, w, corr(ra, rb) AS ic FROM {name}_r GROUP BY {keys}, w HAVING count(*) >= {window // 2}),
{name}_g AS (SELECT {keys}, count(*) AS c, avg(ic) AS m, stddev_pop(ic) AS sd FROM {name}_i WHERE ic IS NOT NULL AND NOT isnan(ic) GROUP BY {keys}),
{name} AS (SELECT {keys}, CASE WHEN c >= 3 THEN m / (sd + 1e-9) ELSE 0 END AS icir FROM (SELECT DISTINCT {keys} FROM {source}) LEFT JOIN {name}_g USING ({keys}))"""


@query("i7_three_way_split", f"WITH {WIDE}, {PARTS} SELECT symbol, ts, rn, CAST(part AS INT) AS part FROM parts")
def split(spark, sf_dir) -> DataFrame:
    """Training, purged validation folds and test time by position."""
    return R.three_way_split(_wide(spark, sf_dir)).select("symbol", "ts", "rn", "part")


@query("j7_stepped_icir", f"WITH {WIDE}, long AS ({_unpivot('wide', 'symbol, rn, label')}), {_stepped('j7', 'long', 'symbol, factor')} SELECT symbol, factor, round(icir, 6) AS icir FROM j7")
def stepped(spark, sf_dir) -> DataFrame:
    """Signed coefficient ratio of windows that step by a fifth, population deviation."""
    return rounded(R.stepped_icir(_long(_wide(spark, sf_dir)), ["symbol", "factor"], WINDOW))


COMPOSITE = f"""plong AS (SELECT symbol, part, rn, factor, coalesce(value, 0) AS value, coalesce(label, 0) AS label FROM ({_unpivot('parts', 'symbol, part, rn, label')})), {_stepped('own', 'plong', 'symbol, part, factor')},
mixed AS (SELECT set_id, n, symbol, part, rn, sum(value * CASE WHEN icir >= 0 THEN 1.0 ELSE -1.0 END) / n AS value, max(label) AS label FROM plong JOIN own USING (symbol, part, factor) JOIN sets USING (factor) GROUP BY set_id, n, symbol, part, rn), {_stepped('comp', 'mixed', 'set_id, n, symbol, part')}"""


@query("j9_composite_icir", f"WITH {ALL_SETS}, {WIDE}, {PARTS}, {COMPOSITE} SELECT set_id, symbol, CAST(part AS INT) AS part, round(icir, 6) AS icir FROM comp")
def composite(spark, sf_dir) -> DataFrame:
    """The same ratio for the signed mean of every set, in each part of the time."""
    rows = R.three_way_split(_wide(spark, sf_dir))
    return rounded(R.composite_icir(R.all_sets(NAMES, 3, spark), _long(rows, "part"), WINDOW).select("set_id", "symbol", "part", "icir"))


MAC = f"""pairs AS (SELECT a.symbol, a.factor AS fa, b.factor AS fb, corr(a.value, b.value) AS c FROM ({_unpivot('wide', 'symbol, rn')}) a JOIN ({_unpivot('wide', 'symbol, rn')}) b ON a.symbol = b.symbol AND a.rn = b.rn AND a.factor < b.factor GROUP BY ALL),
mac AS (SELECT s.set_id, x.symbol, coalesce((SELECT avg(abs(CASE WHEN isnan(c) THEN NULL ELSE c END)) FROM pairs p JOIN sets u ON u.set_id = s.set_id AND u.factor = p.fa JOIN sets v ON v.set_id = s.set_id AND v.factor = p.fb WHERE p.symbol = x.symbol), 0) AS mac
  FROM (SELECT DISTINCT set_id FROM sets) s, (SELECT DISTINCT symbol FROM wide) x)"""
GUARDED = f"""{COMPOSITE}, {MAC}, f AS (SELECT set_id, n, symbol, avg(icir) FILTER (part >= 0 AND part <> 99) AS m, stddev_pop(icir) FILTER (part >= 0 AND part <> 99) AS sigma, max(icir) FILTER (part = -1) AS train FROM comp GROUP BY ALL),
g AS (SELECT *, m - sigma AS raw, greatest(0, coalesce(train - (m - sigma), 0)) AS gap FROM f),
scored AS (SELECT g.set_id, g.symbol, raw, sigma, gap, mac, raw - (0.25 * mac + 0.05 * n + greatest(0, sigma - 1.5) + 0.3 * gap) AS score FROM g JOIN mac USING (set_id, symbol))"""


def _scored(spark, sf_dir, sets: DataFrame) -> DataFrame:
    wide = _wide(spark, sf_dir)
    icirs = R.composite_icir(sets, _long(R.three_way_split(wide), "part"), WINDOW)
    return R.guarded_scores(icirs, R.set_correlation(sets, wide, NAMES))


@query("j15_scored_sets", f"WITH {ALL_SETS}, {WIDE}, {PARTS}, {GUARDED} SELECT set_id, symbol, {', '.join(f'round({c}, 6) AS {c}' for c in ('raw', 'sigma', 'gap', 'mac', 'score'))} FROM scored")
def scored_sets(spark, sf_dir) -> DataFrame:
    """All sets of up to three factors in one job, with guards for correlation, size, instability and overfit."""
    return rounded(_scored(spark, sf_dir, R.all_sets(NAMES, 3, spark)))


RETURNS = f"""signs AS (SELECT symbol, factor, CASE WHEN icir >= 0 THEN 1.0 ELSE -1.0 END AS sign FROM own WHERE part = -1), wlong AS (SELECT symbol, ts, rn, factor, coalesce(value, 0) AS value FROM ({_unpivot('wide', 'symbol, ts, rn')})),
means AS (SELECT set_id, n, symbol, ts, rn, sum(value * sign) / n AS value FROM wlong JOIN signs USING (symbol, factor) JOIN sets USING (factor) GROUP BY set_id, n, symbol, ts, rn),
rets AS (SELECT set_id, n, m.symbol, m.rn, m.ts, coalesce(lag(sign(value)) OVER (PARTITION BY set_id, m.symbol ORDER BY m.rn), 0) * coalesce(ret, 0) AS r, total FROM means m JOIN wide USING (symbol, rn))"""


def _sharpe_sql(name: str, where: str, least: int, recent: int | None = None) -> str:
    late = f" QUALIFY row_number() OVER (PARTITION BY set_id, symbol ORDER BY d DESC) <= {recent}" if recent else ""
    return f"""{name}_d AS (SELECT set_id, n, symbol, CAST(ts AS DATE) AS d, sum(r) AS r FROM rets WHERE {where} GROUP BY set_id, n, symbol, CAST(ts AS DATE){late}),
{name} AS (SELECT set_id, n, symbol, CASE WHEN count(*) < {least} THEN -999 WHEN stddev_pop(r) < 1e-9 THEN 0 ELSE avg(r) / stddev_pop(r) * sqrt(252) END AS sharpe FROM {name}_d GROUP BY set_id, n, symbol)"""


LEAST, RECENT = 4, 8
OOS = "rn > floor(total * 0.5::DOUBLE) + 4"
SHARPE = f"{COMPOSITE}, {RETURNS}, {_sharpe_sql('oos', OOS, LEAST)}, {_sharpe_sql('late', OOS, LEAST, RECENT)}"


def _returns(spark, sf_dir, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(returns of every set with total, wide rows): signs by the training time."""
    wide = _wide(spark, sf_dir)
    train = R.three_way_split(wide).where(F.col("part") == R.TRAIN)
    filled = _long(train).withColumns({"value": F.coalesce("value", F.lit(0.0)), "label": F.coalesce("label", F.lit(0.0))})
    own = R.stepped_icir(filled, ["symbol", "factor"], WINDOW)
    signs = own.select("symbol", "factor", F.when(F.col("icir") >= 0, 1.0).otherwise(-1.0).alias("sign"))
    made = R.set_returns(sets, _long(wide), signs, wide.select("symbol", "rn", "ts", "ret"))
    return made.join(wide.groupBy("symbol").agg(F.max("total").alias("total")), "symbol"), wide


def _out_of_sample(returns: DataFrame, ahead: int = 3) -> DataFrame:
    """Rows later than the split by the label's reach and one."""
    return returns.where(F.col("rn") > F.floor(F.col("total") * 0.5) + ahead + 1)


@query(
    "j16_set_sharpe",
    f"WITH {ALL_SETS}, {WIDE}, {PARTS}, {SHARPE}, {MAC} SELECT set_id, symbol, round(oos.sharpe, 6) AS sharpe, round(late.sharpe, 6) AS recent_sharpe, round(mac, 6) AS mac, round(CASE WHEN oos.sharpe <= -998 THEN -999 ELSE oos.sharpe - 0.25 * mac END, 6) AS score FROM oos JOIN late USING (set_id, symbol) JOIN mac USING (set_id, symbol)",
)
def set_sharpe(spark, sf_dir) -> DataFrame:
    """Out-of-sample Sharpe less correlation, over all days and the latest ones."""
    sets = R.all_sets(NAMES, 3, spark)
    returns, wide = _returns(spark, sf_dir, sets)
    late = _out_of_sample(returns)
    made = R.set_sharpe(late, LEAST).join(R.set_sharpe(late, LEAST, RECENT).withColumnRenamed("sharpe", "recent_sharpe"), ["set_id", "symbol"]).join(R.set_correlation(sets, wide, NAMES), ["set_id", "symbol"])
    return rounded(made.withColumn("score", F.when(F.col("sharpe") <= -998, -999.0).otherwise(F.col("sharpe") - 0.25 * F.col("mac"))))


@query(
    "j14_must_include",
    f"""WITH {ALL_SETS}, {WIDE}, {PARTS}, {SHARPE}, pool AS (SELECT symbol, factor FROM own WHERE part = -1 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(abs(icir), 6) DESC, factor) <= 4),
    inside AS (SELECT set_id, p.symbol FROM sets s JOIN pool p USING (factor) GROUP BY set_id, p.symbol, s.n HAVING count(*) = s.n), o AS (SELECT symbol, set_id, n, round(sharpe, 6) AS sharpe FROM oos JOIN inside USING (set_id, symbol)),
    small AS (SELECT * FROM o WHERE n < 3 QUALIFY row_number() OVER (PARTITION BY symbol, n ORDER BY sharpe DESC, set_id) <= 3),
    big AS (SELECT * FROM o WHERE n = 3 AND EXISTS (SELECT 1 FROM small s WHERE s.symbol = o.symbol AND s.n = 2 AND len(list_intersect(string_split(o.set_id, '|'), string_split(s.set_id, '|'))) = 2) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, set_id) <= 3)
    SELECT symbol, set_id, CAST(n AS INT) AS n, sharpe, CAST(row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, n, set_id) AS INT) AS place FROM (SELECT * FROM small UNION ALL SELECT * FROM big)""",
)
def must_include(spark, sf_dir) -> DataFrame:
    """The best single factors, pairs and triples of the strongest four, by out-of-sample Sharpe."""
    sets, wide = R.all_sets(NAMES, 3, spark), _wide(spark, sf_dir)
    train = _long(R.three_way_split(wide).where(F.col("part") == R.TRAIN)).withColumns({"value": F.coalesce("value", F.lit(0.0)), "label": F.coalesce("label", F.lit(0.0))})
    own = R.stepped_icir(train, ["symbol", "factor"], WINDOW).withColumn("size", F.round(F.abs("icir"), 6))
    pool = own.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("size"), "factor"))).where("k <= 4").select("symbol", "factor")
    inside = sets.join(pool, "factor").groupBy("symbol", "set_id", "n").agg(F.count("*").alias("c")).where("c = n").select("symbol", "set_id", "n")
    returns, _ = _returns(spark, sf_dir, sets)
    scored = R.set_sharpe(_out_of_sample(returns), LEAST).withColumn("sharpe", F.round("sharpe", 6)).join(inside, ["symbol", "set_id"])
    return R.must_include(scored.select("symbol", "set_id", "n", "sharpe"), 3)


@query("j17_refined_set")
def refined(spark, sf_dir) -> DataFrame:
    """A greedy climb over the mean guarded score; each round's neighbours are one job."""

    def score(sets):
        made = _scored(spark, sf_dir, R.named_sets(sets, spark)).groupBy("set_id").agg(F.round(F.avg("score"), 6).alias("score"))
        return {r.set_id: r.score for r in made.collect()}

    return spark.createDataFrame(R.refine(("rel_vol", "ret", "spread"), CLUSTERS, score, rounds=3), "round int, set_id string, score double")


@query("i23_parzen_search")
def parzen(spark, sf_dir) -> DataFrame:
    """Picks and include flags of the clusters by a Parzen search over the mean guarded score, a batch a job."""

    def score(sets):
        made = _scored(spark, sf_dir, R.named_sets(sets, spark)).groupBy("set_id").agg(F.round(F.avg("score"), 6).alias("score"))
        return {r.set_id: r.score for r in made.collect()}

    return Z.as_table(spark, Z.parzen_search(spark, CLUSTERS, score, 24, 8, startup=8))


VAL = "rn >= floor(total * 0.5::DOUBLE) AND rn < floor(total * 0.8::DOUBLE)"


@query(
    "j20_overfit_flags",
    f"WITH {ALL_SETS}, {WIDE}, {PARTS}, {COMPOSITE}, {RETURNS}, {_sharpe_sql('val', VAL, LEAST)}, {_sharpe_sql('tst', 'rn >= floor(total * 0.8::DOUBLE)', LEAST)} SELECT set_id, symbol, round(val.sharpe, 6) AS val_sharpe, round(tst.sharpe, 6) AS test_sharpe, CASE WHEN val.sharpe > -900 AND tst.sharpe > -900 THEN abs(val.sharpe - tst.sharpe) > 0.5 END AS overfit FROM val JOIN tst USING (set_id, symbol)",
)
def overfit(spark, sf_dir) -> DataFrame:
    """Validation and test Sharpe of every set, and whether they differ by more than a half."""
    returns, _ = _returns(spark, sf_dir, R.all_sets(NAMES, 3, spark))
    begin, end = F.floor(F.col("total") * 0.5), F.floor(F.col("total") * 0.8)
    validation, test = returns.where((F.col("rn") >= begin) & (F.col("rn") < end)), returns.where(F.col("rn") >= end)
    return rounded(R.overfit_flags(R.set_sharpe(validation, LEAST), R.set_sharpe(test, LEAST)))


_RANK = "rank() OVER (PARTITION BY symbol, factor, refresh, c, s ORDER BY {x}) + (count(*) OVER (PARTITION BY symbol, factor, refresh, c, s, {x}) - 1) / 2.0"


@query(
    "j10_two_level_composite",
    f"""WITH {WIDE}, long AS ({_unpivot('wide', 'symbol, ts, rn, total, label')}), ats AS (SELECT symbol, total, unnest(range(120, total, 40)) AS refresh FROM (SELECT DISTINCT symbol, total FROM wide)),
    u AS (SELECT l.symbol, l.factor, a.refresh, l.rn, l.value, l.label FROM long l JOIN ats a ON l.symbol = a.symbol AND l.rn >= a.refresh - 120 AND l.rn < a.refresh WHERE l.value IS NOT NULL AND l.label IS NOT NULL),
    c AS (SELECT *, count(*) OVER (PARTITION BY symbol, factor, refresh) AS c, row_number() OVER (PARTITION BY symbol, factor, refresh ORDER BY rn) - 1 AS k FROM u), z AS (SELECT *, CASE WHEN c < 40 THEN c WHEN c < 60 THEN c // 3 ELSE 20 END AS size FROM c),
    s AS (SELECT *, k // size AS s FROM z WHERE k // size < c // size), r AS (SELECT symbol, factor, refresh, c, s, {_RANK.format(x='value')} AS ra, {_RANK.format(x='label')} AS rb FROM s),
    i AS (SELECT symbol, factor, refresh, c, s, corr(ra, rb) AS q FROM r GROUP BY ALL), ic AS (SELECT symbol, factor, refresh, c, CASE WHEN isnan(q) THEN NULL ELSE q END AS ic FROM i),
    m AS (SELECT symbol, factor, refresh, c, avg(ic) AS m, stddev_samp(ic) AS sd, count(ic) AS k FROM ic GROUP BY ALL),
    e AS (SELECT symbol, factor, refresh, coalesce(CASE WHEN c < 30 THEN 0 WHEN c < 40 THEN abs(m) * sqrt(greatest(1, c // 20)) WHEN k < 3 THEN 0 WHEN sd < 1e-9 THEN abs(m) * 10 ELSE abs(m) / sd END, 0) AS icir FROM m),
    g AS (SELECT *, CASE WHEN factor IN ('mom5', 'ret') THEN 'a' WHEN factor IN ('spread', 'rel_vol') THEN 'b' ELSE 'c' END AS cluster FROM e),
    p AS (SELECT *, max(icir) OVER (PARTITION BY symbol, refresh, cluster) >= 0.3 AS enough, row_number() OVER (PARTITION BY symbol, refresh, cluster ORDER BY icir DESC, factor) AS place FROM g),
    kept AS (SELECT * FROM p WHERE (enough AND icir >= 0.3) OR (NOT enough AND place = 1)), w AS (SELECT *, CASE WHEN sum(icir) OVER q < 1e-9 THEN 1.0 / count(*) OVER q ELSE icir / sum(icir) OVER q END AS w FROM kept WINDOW q AS (PARTITION BY symbol, refresh, cluster)),
    o AS (SELECT symbol, refresh, cluster, sum(w * icir) AS own FROM w GROUP BY ALL), v AS (SELECT *, CASE WHEN sum(own) OVER q < 1e-9 THEN 1.0 / count(*) OVER q ELSE own / sum(own) OVER q END AS iw FROM o WINDOW q AS (PARTITION BY symbol, refresh)),
    f AS (SELECT symbol, refresh, factor, w * iw AS weight FROM w JOIN v USING (symbol, refresh, cluster) WHERE w * iw >= 1e-9)
    SELECT l.symbol, l.ts, round(sum(l.value * f.weight), 6) AS composite FROM long l JOIN f ON l.symbol = f.symbol AND l.factor = f.factor AND f.refresh = (l.rn - 120) // 40 * 40 + 120 WHERE l.rn >= 120 AND l.value IS NOT NULL GROUP BY ALL""",
)
def two_level(spark, sf_dir) -> DataFrame:
    """Weights inside sub-clusters and between them, refreshed from the rows before, held in between."""
    long = _long(_wide(spark, sf_dir))
    icirs = R.trailing_icir(long, ["symbol", "factor"], 120, 40, 20)
    groups = spark.createDataFrame([(f, str(k)) for k, c in enumerate(CLUSTERS) for f in c], "factor string, cluster string")
    return rounded(R.held_composite(long, R.two_level_weights(icirs, groups, 0.3), 120, 40))
