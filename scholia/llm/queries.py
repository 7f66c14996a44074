"""The thirteen named queries over the provided tables, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import (bpe, embedding_dedup, importance, language_model, mixing, order_minhash, pii, recompression, secrets, sharding, simhash, spelling,
                         toxicity)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.vocabulary_path())


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shards_of(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_sensitivity(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(table(spark, sf_dir, "documents"))
    return (mixed.select("doc_id", "size", "source_size", "target", "taken", "epochs", F.get("positions", F.lit(0)).alias("position"))
            .orderBy(F.col("position").asc_nulls_last(), "doc_id"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = recompression.without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_bpe, op3_sharding, op4_simhash, op5_language_model, op6_order_minhash, op7_secrets,
                            op8_mixing, op9_embedding_dedup, op10_pii, op11_spelling, op12_importance, op13_recompression)}

MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS rank FROM documents
), s AS (
  SELECT *, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS weight FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS kind FROM d GROUP BY source)
), w AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(3 * source_size) OVER (
             ORDER BY 3 * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS left_,
         CAST(sum(weight) OVER (ORDER BY 3 * source_size / weight, source ASC NULLS LAST
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weight_left FROM s
), f AS (
  SELECT left_ AS open_left, weight_left AS open_weight FROM w WHERE NOT 3 * source_size * weight_left < left_ * weight
  ORDER BY 3 * source_size / weight, left_, weight_left LIMIT 1
), t AS (
  SELECT source, source_size, kind, CASE WHEN 3 * source_size * weight_left < left_ * weight THEN CAST(3 * source_size AS DOUBLE)
         ELSE CAST(open_left AS DOUBLE) * weight / open_weight END AS target FROM w, f
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.kind, t.target, CAST(round(t.target) AS BIGINT) AS wanted,
         coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.rank, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS supply
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS full_ FROM p
), r AS (
  SELECT *, full_ * size + greatest(0, least(size, wanted - full_ * source_size - supply)) AS taken FROM q
), v AS (
  SELECT *, CASE kind WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS ramp,
         least(1.0::DOUBLE, supply / CAST(wanted AS DOUBLE)) AS demand FROM r
)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CAST(CASE WHEN size > 0 THEN ceil(taken / CAST(size AS DOUBLE)) ELSE 0 END AS INTEGER) AS epochs,
       CASE WHEN taken > 0 THEN least(1.0::DOUBLE, 2 * demand / greatest(
         ramp + sqrt(greatest(0.0::DOUBLE, ramp * ramp + 4 * (1 - ramp) * demand)), 1e-12::DOUBLE)) END AS position
FROM v
"""


def _crc_step(nibble: int) -> int:
    for _ in range(4):
        nibble = nibble >> 1 ^ (0xEDB88320 if nibble & 1 else 0)
    return nibble


def sql_crc32(text: str) -> str:
    """crc32 of the UTF-8 bytes of a SQL string, half a byte at a time."""
    steps = ", ".join(str(_crc_step(i)) for i in range(16))
    halves = (f"list_transform(range(0, CAST(len(hex(encode({text}))) AS BIGINT)), lambda i: "
              f"instr('0123456789ABCDEF', substr(hex(encode({text})), i + 2 - 2 * (i % 2), 1)) - 1)")
    return (f"xor(list_reduce({halves}, lambda a, b: xor(a >> 4, [{steps}][CAST((xor(a, b) & 15) + 1 AS INT)]), "
            f"CAST(4294967295 AS BIGINT)), 4294967295)")


SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SPELLING_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all({SQL_LOWER.format("coalesce(text, '')")}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT *, {sql_crc32("concat(doc_id, ':', run)")} AS h FROM runs
), vocabulary AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word,
         CAST(sum(times) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(times) >= 2
), cut AS (
  SELECT word, i, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest
  FROM (SELECT word, unnest(range(0, length(word))) AS i FROM vocabulary)
), near AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, v.word FROM cut c JOIN vocabulary v ON v.word = c.rest
  UNION SELECT v.word, c.word FROM cut c JOIN vocabulary v ON v.word = c.rest
), ranked AS (
  SELECT near.word, near.near, v.n AS near_n, count(*) OVER (PARTITION BY near.word) AS n_near,
         row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, near.near) AS place
  FROM near JOIN vocabulary v ON v.word = near.near
), formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form,
         CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n
  FROM vocabulary v LEFT JOIN ranked r ON r.word = v.word AND place = 1
), path AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT path.word, formed.form FROM path JOIN formed ON formed.word = path.root WHERE formed.form IS NOT NULL
)
SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n
FROM formed f JOIN path p ON p.word = f.word JOIN formed g ON g.word = p.root AND g.form IS NULL
"""

IMPORTANCE_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({SQL_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), dw AS (SELECT doc_id, unnest(words) AS word FROM d
), bw AS (
  SELECT unnest(regexp_extract_all({SQL_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), buckets AS (
  SELECT word, {sql_crc32("word")} % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw)
), s AS (SELECT bucket, count(*) AS s FROM dw JOIN buckets USING (word) GROUP BY 1
), t AS (SELECT bucket, count(*) AS t FROM bw JOIN buckets USING (word) GROUP BY 1
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM dw) + 10000)
         / (CAST(s + 1 AS DOUBLE) * ((SELECT count(*) FROM bw) + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)
), w AS (
  SELECT doc_id, CAST(sum(gain) AS BIGINT) AS total, count(*) AS n FROM dw JOIN buckets USING (word) JOIN gain USING (bucket) GROUP BY 1
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
         CAST('0x' || substr(sha256(concat('2024:', doc_id)), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN w USING (doc_id)
), full_ AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored
), drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 10 * count(*) OVER () // 100 AS places FROM full_ WHERE n_features >= 20
)
SELECT f.doc_id, f.n_features, CAST(f.weight AS BIGINT) AS weight, CAST(f.score AS BIGINT) AS score, r.rank
FROM full_ f LEFT JOIN (SELECT * FROM drawn WHERE rank <= places) r ON r.doc_id = f.doc_id
"""

RECOMPRESSION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, start, array_to_string(words[start:start + 19], ' ') AS content
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS start FROM d)
), repeated AS (
  SELECT doc_id, start FROM windows QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id NULLS LAST, start) > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS place FROM repeated
), placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text FROM placed ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

SQL: dict[str, str] = {"op8_mixing": MIXING_SQL, "op11_spelling": SPELLING_SQL, "op12_importance": IMPORTANCE_SQL, "op13_recompression": RECOMPRESSION_SQL}
