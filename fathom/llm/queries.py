"""Registered queries of the training-data operators: ``op<N>_<name>``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.chat_format import canonical_turns, format_chats, loss_text, read_back, turn_rows_as_records
from fathom.llm.decontaminate import contaminated
from fathom.llm.embed_dedup import embedding_duplicates
from fathom.llm.hard_negatives import mine_hard_negatives, scaled
from fathom.llm.html_text import extract_main_text
from fathom.llm.license_scan import scan_licenses
from fathom.llm.mixing import mix_sources
from fathom.llm.near_dedup import near_duplicates
from fathom.llm.quality import fit_quality, score_quality
from fathom.llm.ranked_search import rank_lexical
from fathom.llm.secrets import secret_report
from fathom.llm.substring_dedup import repeated_spans
from fathom.llm.suffix_dedup import removal_report, suffix_dedup

KEEP_SCORE = 0.7


def held_out() -> Column:
    """Rows that the fit of op2 does not see."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 in another layout, as two turns of control strings."""
    records = turn_rows_as_records(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    mark = "</s>[INST] ok [/INST]"
    own = F.to_json(F.struct(F.lit(mark).alias("instruction"), F.lit(mark).alias("output")))
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), own.alias("record"))
    turns = canonical_turns(records).drop("record").unionByName(canonical_turns(extra).drop("record"))
    made = format_chats(turns, "conv_id")
    read = made.select("conv_id", "layout", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\2\\\3', 'g') AS body FROM said
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(body) + 13) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def op2_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels.where(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumns({"probability": F.round("probability", 6), "overlap": F.round("overlap", 6)})


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.withColumn("rate", F.round("rate", 9))


OP4_SQL = """
WITH size AS (
  SELECT coalesce(source, '') AS source, sum(coalesce(length(text), 0)) AS size FROM documents GROUP BY 1
), rated AS (
  SELECT source, CASE WHEN size = 0 THEN 1.0 ELSE sqrt(size::DOUBLE) * sum(size) OVER () / sum(sqrt(size::DOUBLE)) OVER () / size END AS rate FROM size
), stepped AS (
  SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
  FROM rated, LATERAL (SELECT unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 24) AS INT))) AS k)
), spread AS (
  SELECT source, rate, list(c ORDER BY k) AS cdf
  FROM (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM stepped) GROUP BY ALL
), counted AS (
  SELECT d.*, s.rate, len(list_filter(s.cdf, lambda c: c <= ('0x' || substr(md5('17:' || d.doc_id), 1, 13))::BIGINT / 4503599627370496.0)) AS copies
  FROM documents d JOIN spread s ON coalesce(d.source, '') = s.source
), copied AS (SELECT *, unnest(generate_series(1, copies)) AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS rate, CAST(copies AS INT) AS copies, CAST(copy AS INT) AS copy,
       ('0x' || substr(md5('18:' || doc_id || ':' || copy), 1, 13))::BIGINT / 4503599627370496.0 AS shuffle_key
FROM copied
"""


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_gear_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), inside=True)


def op7_itq_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (SELECT vec_id, vec_id AS r FROM e UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON reach.r = link.a)
SELECT vec_id, (SELECT count(*) FROM link WHERE link.a = vec_id) AS n_links, min(r) AS component_id, min(r) = vec_id AS kept FROM reach GROUP BY vec_id
"""


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_greedy_tiling_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), both_sets AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM both_sets JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a)
SELECT reach.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id, min(r) = reach.doc_id AS kept
FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id
"""

def op11_l2ap_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(scaled(rows.withColumn("label", moved)))


OP11_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x::DOUBLE[], b.x::DOUBLE[]) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank,
         s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT * FROM n WHERE rank <= 5
"""


def op12_nra_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_lexical(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT count(*) FILTER (len(words) > 0) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM d),
p AS (SELECT doc_id, any_value(len(words)) AS n, term, count(*) AS tf FROM (SELECT doc_id, words, unnest(words) AS term FROM d) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM b JOIN w USING (term) JOIN p USING (term), c GROUP BY item_id, doc_id)
SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 10
"""


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP13_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(generate_series(0, len(h) // 2 - 200)) AS i, h FROM d WHERE len(h) >= 400),
s AS (SELECT doc_id, i, md5(h[2 * i + 1:2 * i + 400]) AS k FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM s) WHERE n > 1),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM r),
t AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k),
e AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM t),
p AS (SELECT d.doc_id, any_value(h) AS h, sum(b - a) AS removed, count(a) AS n, coalesce(string_agg(h[2 * before + 1:2 * a], '' ORDER BY a), '') AS head, coalesce(max(b), 0) AS tail FROM d LEFT JOIN e ON d.doc_id = e.doc_id GROUP BY d.doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, n AS n_spans, sha256(unhex(head || h[2 * tail + 1:])) AS kept_sha256 FROM p
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_subword_quality,
        op3_license_scan,
        op4_poisson_mixing,
        op5_html_main_text,
        op6_gear_chunk_dedup,
        op7_itq_embedding_dedup,
        op8_secret_scan,
        op9_greedy_tiling_decontamination,
        op10_minhash_near_dedup,
        op11_l2ap_hard_negatives,
        op12_nra_ranked_search,
        op13_suffix_array_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": OP1_SQL,
    "op4_poisson_mixing": OP4_SQL,
    "op7_itq_embedding_dedup": OP7_SQL,
    "op10_minhash_near_dedup": OP10_SQL,
    "op11_l2ap_hard_negatives": OP11_SQL,
    "op12_nra_ranked_search": OP12_SQL,
    "op13_suffix_array_dedup": OP13_SQL,
}
