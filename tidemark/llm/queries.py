"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chat import digests, formatted
from tidemark.llm.exact import exact_groups
from tidemark.llm.infill import fill_in_middle, restored
from tidemark.llm.jaccard import similar_groups
from tidemark.llm.language import identify
from tidemark.llm.mixing import mixed
from tidemark.llm.negatives import hard_negatives
from tidemark.llm.packing import packed_sequences
from tidemark.llm.perplexity import quality_rules
from tidemark.llm.quality import quality
from tidemark.llm.substrings import remove_repeats
from tidemark.llm.toxicity import toxicity
from tidemark.llm.warc import archive_folder, read_archive, write_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op2_ngram_jaccard", oracle=r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a WHERE r.c < l.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE a = d.doc_id)::BIGINT AS component_id
FROM d LEFT JOIN n USING (doc_id)""")
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query("op3_substring_dedup", oracle=r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i:i + 12], ' ')) AS least FROM p),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM g, (SELECT unnest(range(13)) AS j) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) FILTER (WHERE x.i IS NULL) AS t, count(*) AS n, count(x.i) AS r
  FROM words LEFT JOIN gone x USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op4_exact_dedup", oracle="""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).drop("probe")


@query("op9_mixing", oracle=r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS w FROM d GROUP BY source),
t AS (SELECT 0 AS step, source, n, w, false AS capped, (SELECT sum(n) * 1.5::DOUBLE FROM s) AS rest, (SELECT sum(w) FROM s) AS rest_w FROM s
  UNION ALL
  SELECT step + 1, source, n, w, c, sum_all - coalesce(sum(CASE WHEN c THEN 2 * n END) OVER (), 0), sum(CASE WHEN NOT c THEN w END) OVER ()
  FROM (SELECT *, capped OR rest * w > 2 * n * rest_w AS c, (SELECT sum(n) * 1.5::DOUBLE FROM s) AS sum_all FROM t WHERE step < 40)),
target AS (SELECT source, n AS source_size, CASE WHEN capped THEN 2.0::DOUBLE * n ELSE rest * w / rest_w END AS target FROM t WHERE step = 40),
b AS (SELECT *, floor(target / source_size) AS times, target - floor(target / source_size) * source_size AS budget FROM target),
h AS (SELECT source, place, sum(size) AS here, sum(sum(size)) OVER (PARTITION BY source ORDER BY place) AS upto FROM d GROUP BY source, place),
x AS (
  SELECT h.source, h.place, CASE WHEN upto <= budget THEN 1 WHEN upto - here <= budget AND upto - budget <= budget - (upto - here) THEN 1 ELSE 0 END AS extra
  FROM h JOIN b ON h.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * (times + CASE WHEN times < 2 THEN extra ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.place = x.place""")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_warc", oracle="""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
o AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS owner FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN owner <> page_id THEN owner END AS refers_to FROM o""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = archive_folder(pages)
    return read_archive(write_archive(pages, folder), folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_curve_packing")
def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(documents(spark, sf_dir), tokenizer_path(), with_ids=False)


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


@query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("sentences")


@query("op6_perplexity_rules")
def op6_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


@query("op11_chat_format", oracle=r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
c AS (
  SELECT *, len(regexp_extract_all(text, x)) AS hits, len(regexp_extract_all(role, x)) AS role_hits
  FROM t, (SELECT '<\\*(?:/?s>)|\[\\*(?:/?(?:SYS|INST|TEXT)\]|(?:ANS|ROLE)\])' AS x)),
f AS (
  SELECT *, length(text) + hits + CASE role WHEN 'system' THEN 6 + 7 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 6 + 5 ELSE 7 + length(role) + role_hits + 8 + 8 END AS chars FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(chars))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id""")
def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.sql("SELECT -1L AS conv_id, i AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(i, r)")
    return digests(formatted(turns.unionByName(planted))).drop("valid")


@query("op12_hard_negatives", oracle="""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS s
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
g AS (SELECT * FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (
  SELECT g.a, g.b, g.s, p.b AS nb, p.s AS ns, row_number() OVER (PARTITION BY g.a, g.b ORDER BY p.s DESC, p.b) AS k
  FROM g JOIN p ON p.a = g.a AND NOT p.same AND 80 * g.s <= 100 * p.s AND p.s <= g.s)
SELECT a AS anchor_id, b AS positive_id, k::INTEGER AS rank, nb AS negative_id, s AS positive_score, ns AS negative_score FROM n WHERE k <= 5""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives(vectors, label, F.col("vec_id") % 100 == 0)


@query("op13_fill_in_middle", oracle=r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(l[1:a], ''), '') AS pre, coalesce(array_to_string(l[a + 1:b], ''), '') AS mid, coalesce(array_to_string(l[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, len(l)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p""")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(documents(spark, sf_dir))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
