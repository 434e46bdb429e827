"""Profiles, vocabulary and word-count vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplenet.functions.text import MIN_WORD_LENGTH, word_tokens
from ripplenet.operators.ordering import assign_ids, ordered_running
from ripplenet.operators.sampling import sample_exact
from ripplenet.operators.skew import ROWS_PER_SALT, hot_keys, join_split
from ripplenet.storage import materialize

# Fixed values of the published feature construction.
MIN_WORD_COUNT = 3
MIN_TOPIC_COUNT = 3
FIRST_WORD_ID = 100
LABELLED_PERCENT = 36
EXTERNAL_SAMPLE = 40_000

# Bytes of text whose words one task counts: words of a user rarely repeat, so a task holds some 13 bytes for each.
TASK_BYTES = 32_000_000

# A profile longer than this is stored in several segments, so that no single row grows with the data.
SEGMENT_CHARS = 16_000_000


def profiles(
    texts: DataFrame, order: str, text: Column | None = None, segment_chars: int = SEGMENT_CHARS
) -> DataFrame:
    """Texts of a user joined by blanks in ``order``: ``(v, segment, profile)``.

    Ordinary users have the one segment 0 and their texts are moved once. A user of more than ``segment_chars`` becomes
    many bounded rows, with every text in exactly one of them: running lengths decide, over keys and lengths alone. Texts
    with one place are ordered by themselves.
    """
    body = F.coalesce(F.col("text") if text is None else text, F.lit(" "))
    rows = texts.select("v", F.col(order).alias("_o"), body.alias("_body"))
    chars = (F.length("_body") + 1).cast("bigint").alias("_chars")
    sizes = rows.select("v", chars).groupBy("v").agg(F.sum("_chars").alias("_n"))
    large = materialize(sizes.where(F.col("_n") > segment_chars).select("v"), "large-profiles")
    placed = rows.withColumn("segment", F.lit(0).cast("bigint"))
    if not large.isEmpty():
        keyed = rows.join(large, "v", "left_semi").withColumn("_h", F.xxhash64("_body"))
        keys = keyed.select("v", "_o", "_h", chars).groupBy("v", "_o", "_h").agg(F.sum("_chars").alias("_chars"))
        measured = ordered_running(materialize(keys, "profile-keys"), ["v"], ["_o", "_h"], sums={"_upto": "_chars"})
        segment = F.floor((F.col("_upto") - F.col("_chars")) / F.lit(segment_chars)).cast("bigint")
        # Joined by place and hash, as a user with a third of all texts is one key; the struct lets null places meet.
        at = F.struct("_o", "_h").alias("_at")
        spread = keyed.withColumn("_at", at).join(measured.select("v", at, segment.alias("segment")), ["v", "_at"]).drop("_at")
        placed = placed.join(large, "v", "left_anti").unionByName(spread.drop("_h"))
    gathered = placed.groupBy("v", "segment").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_o").alias("o"), F.col("_body").alias("t")))).alias("_parts")
    )
    return gathered.select("v", "segment", F.array_join(F.transform("_parts", lambda p: p["t"]), " ").alias("profile"))


def drop_stop_words(words: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Rows of ``words(word, ...)`` that are not in ``stop_words(value)``."""
    return words.join(stop_words.select(F.col("value").alias("word")), "word", "left_anti")


def _dealt_out(texts: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``texts`` in parts of about ``task_bytes``; those that fill no more than one part for each core stay where they are."""
    whole = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-whole // task_bytes)
    return texts.repartition(parts, "v", "text") if parts > texts.sparkSession.sparkContext.defaultParallelism else texts


def profile_words(
    texts: DataFrame, stop_words: DataFrame | None = None, longer_than: int = MIN_WORD_LENGTH, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """Word counts per user ``(v, word, n)`` over all of a user's ``texts(v, text)``.

    This is the profile in the form everything downstream needs; the concatenated text is never built. A task counts the
    words of about ``task_bytes`` of text, however large the files are.
    """
    words = _dealt_out(texts.select("v", "text"), task_bytes).select("v", F.explode(word_tokens(F.col("text"), longer_than)).alias("word"))
    counts = words.groupBy("v", "word").agg(F.count(F.lit(1)).alias("n"))
    return counts if stop_words is None else drop_stop_words(counts, stop_words)


def word_counts(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(
    words: DataFrame, more_than: int = MIN_WORD_COUNT, longer_than: int = MIN_WORD_LENGTH, base: int = FIRST_WORD_ID
) -> DataFrame:
    """``(word, id)``: frequent words in alphabetical order, numbered from ``base``."""
    frequent = word_counts(words).where((F.col("n") > more_than) & (F.length("word") > longer_than))
    return assign_ids(frequent, "word", base=base)


def word_vectors(words: DataFrame, vocab: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """``(v, ids, counts, tokens, distinct)``: a user's known words as parallel arrays in id order.

    ``words`` is a written table. Its most frequent words are split by salts in the join. Counts are aggregated before
    they are collected, so an array is never longer than the vocabulary.
    """
    salts = hot_keys(words, "word", words.count(), rows_per_salt)
    known = join_split(words, vocab, "word", salts, "v").groupBy("v").agg(
        F.sort_array(F.collect_list(F.struct("id", "n"))).alias("_pairs"),
        F.sum("n").alias("tokens"),
        F.count(F.lit(1)).alias("distinct"),
    )
    return known.select(
        "v",
        F.col("_pairs.id").alias("ids"),
        F.col("_pairs.n").alias("counts"),
        "tokens",
        "distinct",
    )


def training_vectors(words: DataFrame, vocab: DataFrame, more_than: int = MIN_TOPIC_COUNT) -> DataFrame:
    """Users with more than ``more_than`` known tokens."""
    return word_vectors(words, vocab).where(F.col("tokens") > more_than)


def scoring_vectors(words: DataFrame, vocab: DataFrame, more_than: int = MIN_TOPIC_COUNT) -> DataFrame:
    """Users with more than ``more_than`` different known words."""
    return word_vectors(words, vocab).where(F.col("distinct") > more_than)


def ignored_users(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row ``(ignored, available)``: users left out and kept by ``scoring_vectors``."""
    users = words.select("v").distinct().join(vectors.select("v", F.lit(1).alias("kept")), "v", "left")
    return users.agg(F.sum(F.when(F.col("kept").isNull(), 1).otherwise(0)).alias("ignored"), F.count("kept").alias("available"))


def vector_text(vectors: DataFrame) -> DataFrame:
    """``(v, features)``: ``id:count`` pairs separated by blanks."""
    pairs = F.zip_with("ids", "counts", lambda i, n: F.concat(i.cast("string"), F.lit(":"), n.cast("string")))
    return vectors.select("v", F.array_join(pairs, " ").alias("features"))


def external_sample(users: DataFrame, n: int = EXTERNAL_SAMPLE, label: str = "external") -> DataFrame:
    """``n`` users of an external corpus, without replacement."""
    return sample_exact(users.select("v").distinct(), "v", n, label)


def training_set(
    labels: DataFrame, seeds: DataFrame, external: DataFrame, percent: int = LABELLED_PERCENT, label: str = "external"
) -> DataFrame:
    """``(v, label)``: seeds and label 1 positive; label 0 and sampled external users negative.

    So many external users are drawn that the labelled ones make up ``percent`` of a hundred parts to them.
    """
    positive = seeds.select("v").union(labels.where(F.col("label") == 1).select("v")).distinct()
    negative = labels.where(F.col("label") == 0).select("v").join(positive, "v", "left_anti").distinct()
    known = materialize(
        positive.withColumn("label", F.lit(1)).unionByName(negative.withColumn("label", F.lit(0))), "known"
    )
    wanted = int(100.0 / percent * known.count())
    fresh = external.select("v").distinct().join(known, "v", "left_anti")
    return known.unionByName(sample_exact(fresh, "v", wanted, label).withColumn("label", F.lit(0)))
