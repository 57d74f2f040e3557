"""One query for each operator, over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import decontam, divergence, embdedup, langid, mixing, preference, quality, repair, simhash, tokcount, tokenstore, topk, toxicity
from cohortry.llm.common import fold, labelled_sample, table

#: Labelled rows a classifier is fitted on, at most (about).
QUALITY_ROWS = 20_000
TOXIC_ROWS = 12_000


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs made from every conversation with an answer; digests of the formatted texts."""
    chosen, rejected = preference.answer_pairs(table(spark, sf_dir, "conversations"))
    p = preference.format_pairs(chosen, rejected)
    cols = [F.col("pair_id"), F.col("prompt_turns"), F.length("prompt").alias("prompt_chars"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5")]
    for side in ("chosen", "rejected"):
        text, spans = F.col(f"{side}.text"), F.col(f"{side}.spans")
        learned = F.aggregate(spans, F.lit(0), lambda n, s: n + s["end"] - s["start"])
        first = F.when(F.size(spans) > 0, spans[0]["start"])
        cols += [F.md5(text.cast("binary")).alias(f"{side}_md5"), F.length(text).alias(f"{side}_chars"), learned.alias(f"{side}_learned"), F.size(spans).alias(f"{side}_spans"), first.alias(f"{side}_first")]
    return p.select(*cols)


OP1_SQL = """
WITH t AS (SELECT conv_id, turn, role, text FROM conversations),
last AS (SELECT conv_id, turn AS cut, text AS answer FROM t WHERE role = 'assistant'
         QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) = 1),
chosen AS (SELECT t.* FROM t JOIN last USING (conv_id)),
rejected AS (SELECT t.* FROM t JOIN last USING (conv_id) WHERE t.turn < last.cut
             UNION ALL
             SELECT a.conv_id, a.cut, 'assistant', b.answer FROM last a JOIN last b ON b.conv_id = a.conv_id + 1),
numbered AS (SELECT 'c' AS side, *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM chosen
             UNION ALL
             SELECT 'r', *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) FROM rejected),
differ AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.n, b.n) AS n,
                  a.role IS NOT NULL AND b.role IS NOT NULL AND a.role = b.role AND a.text = b.text AS same
           FROM (SELECT * FROM numbered WHERE side = 'c') a
           FULL JOIN (SELECT * FROM numbered WHERE side = 'r') b ON a.conv_id = b.conv_id AND a.n = b.n),
prefix AS (SELECT conv_id, coalesce(min(n) FILTER (NOT same) - 1, max(n)) AS k FROM differ GROUP BY conv_id),
written AS (SELECT side, conv_id, n, n <= k AS shared, role, k,
                   '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line,
                   length(role) + 5 AS head FROM numbered JOIN prefix USING (conv_id)),
placed AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY side, conv_id, shared ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM written)
SELECT conv_id AS pair_id, any_value(k)::INT AS prompt_turns,
  coalesce(sum(length(line)) FILTER (side = 'c' AND shared), 0)::INT AS prompt_chars,
  md5(coalesce(string_agg(line, '' ORDER BY n) FILTER (side = 'c' AND shared), '')) AS prompt_md5,
  md5(coalesce(string_agg(line, '' ORDER BY n) FILTER (side = 'c' AND NOT shared), '')) AS chosen_md5,
  coalesce(sum(length(line)) FILTER (side = 'c' AND NOT shared), 0)::INT AS chosen_chars,
  coalesce(sum(length(line) - head) FILTER (side = 'c' AND NOT shared AND role = 'assistant'), 0)::INT AS chosen_learned,
  (count(*) FILTER (side = 'c' AND NOT shared AND role = 'assistant'))::INT AS chosen_spans,
  (min(pos + head) FILTER (side = 'c' AND NOT shared AND role = 'assistant'))::INT AS chosen_first,
  md5(coalesce(string_agg(line, '' ORDER BY n) FILTER (side = 'r' AND NOT shared), '')) AS rejected_md5,
  coalesce(sum(length(line)) FILTER (side = 'r' AND NOT shared), 0)::INT AS rejected_chars,
  coalesce(sum(length(line) - head) FILTER (side = 'r' AND NOT shared AND role = 'assistant'), 0)::INT AS rejected_learned,
  (count(*) FILTER (side = 'r' AND NOT shared AND role = 'assistant'))::INT AS rejected_spans,
  (min(pos + head) FILTER (side = 'r' AND NOT shared AND role = 'assistant'))::INT AS rejected_first
FROM placed GROUP BY conv_id
"""


def op2_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(labelled_sample(docs, labels, "quality", fold(F.col("key"), 5) != 0, QUALITY_ROWS))
    out = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), quality.score(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(labelled_sample(docs, labels, "toxic", fold(F.col("key"), 3) != 1, TOXIC_ROWS))
    text = F.col("text")
    out = docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), toxicity.judge(model, text).alias("j"))
    spans = F.col("j.offending")
    out = out.select("doc_id", "held_out", F.col("j.score").alias("score"), F.size(spans).alias("n_offending"), F.when(F.size(spans) > 0, spans[0]["start"]).alias("first_start"), F.when(F.size(spans) > 0, spans[0]["end"]).alias("first_end"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold(F.col("doc_id"), 4) != 2)
    p = docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), langid.predict(model, F.col("text")).alias("p"))
    return p.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokcount.count_tokens(table(spark, sf_dir, "documents"), _path("word_bpe_49k.json"))


def op7_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the times it is read at weights half way to equal entropy."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cuts, _ = mixing.mix(docs, entropy=0.5)
    return mixing.with_copies(docs, cuts).select("doc_id", "source", "copies")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"), n=3, max_bits=3)
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.round_trip(table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best integer inner products of every row whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP11_SQL = """
WITH r AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings),
v AS MATERIALIZED (
  SELECT row, vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS d FROM r
  WHERE embedding IS NOT NULL AND NOT list_bool_or([x IS NULL OR isnan(x::DOUBLE) OR isinf(x::DOUBLE) for x in embedding] || [false])),
ok AS MATERIALIZED (
  SELECT row, vec_id, [x::BIGINT for x in d] AS c FROM v WHERE coalesce(list_sum([x * x for x in d]), 0) < 4611686018427387904.0),
s AS (
  SELECT q.row AS qrow, q.vec_id AS query_id, x.vec_id, x.row AS xrow,
         coalesce(list_sum([q.c[i] * x.c[i] for i in range(1, len(q.c) + 1)]), 0)::BIGINT AS score
  FROM ok q JOIN ok x ON x.row <> q.row AND len(x.c) = len(q.c)
  WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qrow ORDER BY score DESC, vec_id ASC NULLS LAST, xrow) AS rank FROM s)
WHERE rank <= 5
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults and its cheapest repair."""
    return repair.repair(table(spark, sf_dir, "conversations"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source against the others of its language, and its most over-represented terms."""
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=10, top_terms=10)


OP13_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
tok AS MATERIALIZED (
  SELECT id, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS u(t)),
kept AS (SELECT lang, term FROM tok GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS V FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS c FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(cnt.c), 0) AS N FROM g LEFT JOIN cnt USING (lang, source) GROUP BY ALL),
lc AS (SELECT lang, term, sum(c) AS c FROM cnt GROUP BY ALL),
ln AS (SELECT lang, sum(c) AS N FROM lc GROUP BY ALL),
gp AS (SELECT g.lang, g.source, kept.term, coalesce(cnt.c, 0) AS c,
              1 + (1000000000::HUGEINT * (coalesce(cnt.c, 0) + 2)) // (n.N + 2 * v.V) AS p
       FROM g JOIN v USING (lang) JOIN kept USING (lang) JOIN n USING (lang, source) LEFT JOIN cnt USING (lang, source, term)),
lp AS (SELECT kept.lang, kept.term, 1 + (1000000000::HUGEINT * (coalesce(lc.c, 0) + 2)) // (coalesce(ln.N, 0) + 2 * v.V) AS q
       FROM kept JOIN v USING (lang) LEFT JOIN ln USING (lang) LEFT JOIN lc USING (lang, term)),
ps AS (SELECT a.lang, a.source AS sa, b.source AS sb, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
       FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(ps.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN ps ON ps.lang = a.lang AND ps.sa = a.source AND ps.sb = b.source),
terms AS (SELECT gp.lang, gp.source, 'term' AS part, gp.term AS item, ((gp.p - lp.q) * (gp.p - lp.q) // (gp.p + lp.q))::BIGINT AS value
          FROM gp JOIN lp USING (lang, term) WHERE gp.c > 0 AND gp.p > lp.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_preference_format, op2_quality_score, op3_toxicity_mil, op4_language_id, op5_decontamination, op6_token_counts,
        op7_temperature_mix, op8_simhash, op9_token_store, op10_embedding_dedup, op11_exact_topk, op12_conversation_repair, op13_source_divergence, pipeline,
    )
}
ORACLES = {"op1_preference_format": OP1_SQL, "op11_exact_topk": OP11_SQL, "op13_source_divergence": OP13_SQL}
