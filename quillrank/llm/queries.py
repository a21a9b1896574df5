"""The queries of the training-data operators, and SQL where it can express them.

Each applies its operator, with production parameters, to its whole table and
derives the columns of its result from the operator's.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm import crf_language, decontamination, divergence, importance, line_join, mixing, order_minhash, piece_bpe, secret_novelty, sentence_spans, simhash, token_shards, whitening
from quillrank.llm.common import table

QUERIES = {}
ORACLE = {}
TOKENIZER = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents", list(columns))


# The word class of the contract, written out for RE2 over A-Z lowered text.
_WORDS = r"""regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + 9], ' ') AS grams
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS grams
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, item_id, i, size FROM doc_windows JOIN item_windows USING (size, grams)),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT doc_id, i, size FROM hits)),
words AS (SELECT doc_id, count(*) AS n_hit FROM covered GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op1_decontamination", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that benchmark windows cover, and the items."""
    found = decontamination.find_leaks(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark", ["item_id", "text"]), ["doc_id"])
    n_hit = decontamination.hit_words()
    return found.select(
        "doc.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query("op2_source_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all sources takes of each document."""
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    mixture, rows = mixing.mixture_rows(docs, F.array("source"))
    # One row a source, of which the operator checks the number.
    plan = spark.createDataFrame([(s, mixture.sizes[s], mixture.targets[s]) for s in mixture.sizes], "source string, source_size long, target double")
    plan = plan.select(F.to_json(F.array("source")).alias("pattern"), "source_size", "target")
    joined = rows.join(F.broadcast(plan), "pattern")
    return joined.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op3_simhash_components")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and their components at up to 2 bits."""
    return simhash.simhash_components(documents(spark, sf_dir, "doc_id", "text"))


@query("op4_sentence_spans")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences removed from each document, and the text without them."""
    found = sentence_spans.with_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc.doc_id", "n_sentences", "n_removed", F.to_json("removed").alias("removed"), "text")


@query("op5_importance_resampling")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log importance weight of each document and whether it is sampled."""
    labels = table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    return importance.resample(documents(spark, sf_dir, "doc_id", "text"), labels)


@query("op6_line_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that equal or resemble an earlier line."""
    marked = line_join.mark_lines(documents(spark, sf_dir, "doc_id", "text"))
    return marked.select(F.col("id").alias("doc_id"), "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


@query("op7_crf_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document; a quarter of the ids is held out of learning."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    found = crf_language.identify_languages(docs, ~held_out, ["doc_id"])
    rows = found.select("doc.doc_id", "lang_pred", "score")
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op8_order_minhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash fingerprints of each document and its edited text."""
    return order_minhash.fingerprints(documents(spark, sf_dir, "doc_id", "text"))


@query("op9_token_shards")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document stands in the shards, as read back from them."""
    return token_shards.token_output(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path(TOKENIZER))


@query("op10_secret_novelty")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document by the base patterns and by novelty."""
    found = secret_novelty.find_secrets(documents(spark, sf_dir, "doc_id", "text"), ["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] != "novel")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc.doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))



@query("op11_piece_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document by the merge-type model, and the text decoded from them."""
    found = piece_bpe.encode_pieces(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path(PIECE_MODEL), ["doc_id"])
    return found.select(
        "doc.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


# Shares are exact HUGEINT divisions; // on integers is the floor here, as all operands are positive.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
numbered AS (SELECT row_number() OVER () AS row, * FROM d),
words AS (SELECT row, lang, source, unnest(w) AS term FROM numbered),
kept AS (SELECT lang, term, count(*) AS lang_count FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
vocabulary AS (SELECT lang, count(*) AS v, sum(lang_count) AS lang_n FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT lang, source, coalesce((SELECT sum(n) FROM cells c WHERE c.lang = g.lang AND c.source = g.source), 0) AS n FROM groups g),
shares AS (
  SELECT k.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (t.n + 2 * v.v)::HUGEINT AS p
  FROM kept k JOIN totals t USING (lang) JOIN vocabulary v USING (lang) LEFT JOIN cells c ON c.lang = k.lang AND c.source = t.source AND c.term = k.term),
distances AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN distances x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
overall AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (lang_count + 2)) // (lang_n + 2 * v)::HUGEINT AS q FROM kept JOIN vocabulary USING (lang)),
terms AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value
  FROM shares s JOIN overall o ON o.lang = s.lang AND o.term = s.term WHERE s.n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""


@query("op12_source_divergence", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms typical of each."""
    return divergence.audit(documents(spark, sf_dir, "text", "lang", "source"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of each usable vector."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), ["vec_id"])
    return found.select("doc.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
