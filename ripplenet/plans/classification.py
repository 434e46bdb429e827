"""Labelling the users that a snowball reaches: profiles, vocabulary, training set, forest, waves, scores, table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplenet.operators import classify, profiles, traversal
from ripplenet.storage import materialize


def classify_snowball(
    texts: DataFrame,
    links: DataFrame,
    seeds: DataFrame,
    labels: DataFrame,
    previous: DataFrame,
    external: DataFrame,
    stop_words: DataFrame | None = None,
    percent: int = profiles.LABELLED_PERCENT,
) -> DataFrame:
    """``(v, label, part)``: new wave-two users by the classifier, kept wave-one users and seeds as ``1.0``.

    Wave one are the friends of ``seeds(v)`` in ``links(src, dst)``; those among them that ``previous(v)`` found positive
    are kept and lead to wave two. The forest is trained on ``labels(v, label)``, the seeds and so many ``external(v)`` users
    that the labelled ones make up ``percent`` of a hundred parts to them, over the words of these users' ``texts(v, text)``.
    A user of wave two with too few known words, or without texts, has no row.
    """
    training = materialize(profiles.training_set(labels, seeds, external, percent), "training")
    kept, wave_two = traversal.snowball(links, seeds, previous)
    kept, wave_two = materialize(kept, "kept"), materialize(wave_two, "wave-two")
    wanted = training.select("v").unionByName(wave_two).distinct()
    words = materialize(profiles.profile_words(texts.join(wanted, "v", "left_semi"), stop_words), "words")
    known = words.join(training.select("v"), "v", "left_semi")
    vocab = materialize(profiles.vocabulary(known), "vocabulary")
    size = profiles.FIRST_WORD_ID + vocab.count()
    taught = profiles.training_vectors(materialize(known, "training-words"), vocab).join(training, "v")
    # A user of wave two may be a training user as well; the classifier scores all of wave two.
    asked = profiles.scoring_vectors(materialize(words.join(wave_two, "v", "left_semi"), "wave-words"), vocab)
    model = classify.fit_labels(
        classify.as_features(taught.withColumn("label", F.col("label").cast("double")), size)
    )
    scored = model.transform(classify.as_features(asked, size))
    table = classify.prediction_table(scored.select("v", "predictedLabel"), kept, seeds)
    marks = kept.withColumn("part", F.lit("kept")).unionByName(seeds.select("v").withColumn("part", F.lit("seed")))
    return table.join(marks, "v", "left").select("v", "label", F.coalesce("part", F.lit("scored")).alias("part"))
