"""Set-based table operations replacing per-row lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Storage DECIMAL types of the stored feature table.
STORAGE_DECIMALS = {
    "meanWordLength": "decimal(3,1)",
    "meanSentLength": "decimal(4,1)",
    "reading_ease": "decimal(7,3)",
    "grade_level": "decimal(5,3)",
    "ColemanLiauIndex": "decimal(5,3)",
    "GunningFogIndex": "decimal(7,3)",
    "ARI": "decimal(7,3)",
    "SMOGIndex": "decimal(5,3)",
    "score": "decimal(4,2)",
}
STORAGE_INTS = ["nChars", "nImages", "nLinks", "nSections", "nSents", "nRefs", "nWordsSummary", "pageId",
                "revisionId", "flags"]


def new_pages(candidates: DataFrame, stored: DataFrame, key: str = "page_id", stored_key: str = "pageId",
              title: str | None = None, stored_title: str = "title") -> DataFrame:
    """Candidates that are not stored yet (anti joins, no per-row lookup).

    A candidate is looked up by its key, or, if it has none and the column
    ``title`` is given, by its title. A page under a new key is new whatever
    its title; a candidate with neither is new.
    """
    known = stored.select(F.col(stored_key).alias("_k")).where(F.col("_k").isNotNull())
    if title is None:
        return candidates.join(known, F.col(key) == F.col("_k"), "left_anti")
    titles = stored.select(F.col(stored_title).alias("_t")).where(F.col("_t").isNotNull())
    by_key = candidates.where(F.col(key).isNotNull()).join(known, F.col(key) == F.col("_k"), "left_anti")
    by_title = candidates.where(F.col(key).isNull()).join(titles, F.col(title) == F.col("_t"), "left_anti")
    return by_key.unionByName(by_title)


def key_copies(stored: DataFrame, key: str = "pageId") -> DataFrame:
    """Rows per key in the stored table; a hot key is pre-aggregated per task."""
    return stored.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("n_copies"))


def existence_report(ids: DataFrame, stored: DataFrame, key: str = "page_id", stored_key: str = "pageId") -> DataFrame:
    """Every id with its copy count and ``least(1, count)`` presence flag."""
    counts = key_copies(stored, stored_key)
    j = ids.join(counts, F.col(key) == F.col("_k"), "left").drop("_k")
    n = F.coalesce(F.col("n_copies"), F.lit(0)).cast("long")
    return j.select(key, n.alias("n_copies"), F.least(F.lit(1), n).cast("int").alias("in_table"))


def existing_pages(ids: DataFrame, stored: DataFrame, key: str = "page_id", stored_key: str = "pageId") -> DataFrame:
    """Only the ids present in the stored table (semi join: no duplication)."""
    return ids.join(stored.select(F.col(stored_key).alias("_k")), F.col(key) == F.col("_k"), "left_semi")


def dedup_first(table: DataFrame, key: str = "pageId", order: str = "id") -> DataFrame:
    """Keep the first row (smallest ``order``) per key; every null-key row stays.

    Implemented as ``min_by(struct(row), order)`` per key: partial aggregation
    keeps one row per key per task before the shuffle, so a key holding a third
    of all rows moves as one row per task, never as one giant group. Null keys
    bypass the aggregation (a union, no shuffle).
    """
    cols = table.columns
    keyed = table.where(F.col(key).isNotNull())
    firsts = (keyed.groupBy(key)
              .agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(order)).alias("_r"))
              .select("_r.*"))
    return firsts.unionByName(table.where(F.col(key).isNull()))


def lookup_by_title(phrases: DataFrame, stored: DataFrame, phrase_col: str = "title", title_col: str = "title",
                    id_col: str = "id", case_insensitive: bool = False) -> DataFrame:
    """The first stored row (smallest id) whose title equals each phrase.

    Stored titles are pre-aggregated to one row per title (partial
    aggregation absorbs a hot title), so a phrase meets at most one row and no
    pairs are emitted. ``case_insensitive`` compares lower-cased titles (the
    original inherited whatever collation the column had).
    """
    norm = (lambda c: F.lower(c)) if case_insensitive else (lambda c: c)
    d = (stored.groupBy(norm(F.col(title_col)).alias("_t"))
         .agg(F.min(id_col).alias("doc_id"), F.count(F.lit(1)).alias("n_same_title")))
    return phrases.join(d, norm(phrases[phrase_col]) == d["_t"]).drop("_t")


def remeasure_update(stored: DataFrame, remeasured: DataFrame, key: str = "pageId") -> DataFrame:
    """New grade_level / reading_ease for labelled pages, others untouched.

    A null new grade leaves the row unchanged; a null new ease keeps only the
    old ease. ``remeasured`` must have one row per key (de-duplicate first).
    """
    r = remeasured.select(F.col(key).alias("_k"), F.col("grade_level").alias("_g"), F.col("reading_ease").alias("_e"))
    j = stored.join(r, F.col(key) == F.col("_k"), "left")
    labelled = F.col("featured") | F.col("flagged")
    take = labelled & F.col("_k").isNotNull() & F.col("_g").isNotNull()
    return (j.withColumn("updated", F.coalesce(take, F.lit(False)))
             .withColumn("grade_level", F.when(F.col("updated"), F.col("_g")).otherwise(F.col("grade_level")))
             .withColumn("reading_ease", F.when(F.col("updated"), F.coalesce(F.col("_e"), F.col("reading_ease")))
                         .otherwise(F.col("reading_ease")))
             .drop("_k", "_g", "_e"))


def to_storage_types(table: DataFrame) -> DataFrame:
    """C4: the DECIMAL/INT storage view. 'NA' and unconvertible values become
    null (``try_cast``; ANSI ``cast`` would raise on overflow)."""
    out = []
    for f in table.schema.fields:
        c = F.col(f.name)
        if f.dataType.simpleString() == "string":
            c = F.nullif(c, F.lit("NA"))
        if f.name in STORAGE_DECIMALS:
            c = c.try_cast(STORAGE_DECIMALS[f.name])
        elif f.name in STORAGE_INTS:
            c = c.try_cast("int")
        elif f.name in ("flagged", "featured"):
            c = c.cast("int")
        out.append(c.alias(f.name))
    return table.select(*out)


def score_rule(featured: Column, flagged: Column, features: list[Column], model_score: Column) -> Column:
    """Featured ⇒ 1.0; else flagged ⇒ 0.0; else any null/NaN feature ⇒ 0.0; else the model."""
    missing = F.lit(False)
    for f in features:
        missing = missing | f.isNull() | F.isnan(f.cast("double"))
    # Flags may arrive as booleans or as stored 0/1 integers: both mean the same.
    return (F.when(F.coalesce(featured.cast("boolean"), F.lit(False)), F.lit(1.0))
             .when(F.coalesce(flagged.cast("boolean"), F.lit(False)), F.lit(0.0))
             .when(missing, F.lit(0.0))
             .otherwise(model_score.cast("double")))


def rescore_candidates(table: DataFrame) -> DataFrame:
    """Pages that are neither featured nor flagged (labelled pages keep their fixed score)."""
    return table.where(~F.coalesce(F.col("featured").cast("boolean"), F.lit(False))
                       & ~F.coalesce(F.col("flagged").cast("boolean"), F.lit(False)))


def standin_score(reading_ease: Column) -> Column:
    """A transparent stand-in for the model probability (used where a check
    needs a SQL-reproducible score): reading ease / 100 clamped to [0, 1], 0 without one."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), reading_ease / F.lit(100.0)))
    return F.when(reading_ease.isNull() | F.isnan(reading_ease), F.lit(0.0)).otherwise(clamped)
