"""A vocabulary of capabilities that grows while proposals are matched against it, in order of arrival.

A proposal that is a known word keeps its slug. Else the most similar known word
decides: from .85 on the proposal gets its slug and is a known word for what comes
after; below that it is a candidate, near to that word from .6 on. So a word is known
from one arrival on, and which one depends on when the words like it became known.

That is not folded row by row. Words that are similar are found by one join. When
each becomes known is a fixed point over those links: the first arrival after a linked
word is known. What a word is linked to at that time is then one pointer a word, and
pointers are followed to their slugs by doubling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from batonflow import fixed
from batonflow.functions.scalars import normalize_capability
from batonflow.operators.resolve import similar_pairs
from batonflow.staging import clear, stage, staged

#: Before any arrival: when the words of the vocabulary itself were known.
ALWAYS = -(1 << 62)


def confirmed(spark: SparkSession, words: list[str] = fixed.CAPABILITIES) -> DataFrame:
    """A vocabulary of these slugs, confirmed and without synonyms: what a new tenant starts with."""
    rows = spark.createDataFrame([(w,) for w in words], "slug string")
    return rows.select("slug", F.array().cast("array<string>").alias("synonyms"), F.lit("confirmed").alias("status"), F.lit(None).cast("string").alias("suggested"))


def _known_words(vocabulary: DataFrame) -> DataFrame:
    """(word, slug) of confirmed rows; a word of several slugs is the least one's."""
    words = F.explode(F.array_append(F.coalesce("synonyms", F.array().cast("array<string>")), F.col("slug")))
    return vocabulary.where("status = 'confirmed'").select("slug", words.alias("word")).where("word IS NOT NULL").groupBy("word").agg(F.min("slug").alias("slug"))


def _settled(asked: DataFrame, known: DataFrame, links: DataFrame, max_rounds: int) -> DataFrame:
    """(word, since): when each word is known. `links`: word, other, from .85 on, in both orders."""
    since = stage(known.select("word", F.lit(ALWAYS).alias("since")), "since")
    moved = since
    for _ in range(max_rounds):
        # The first arrival of a word after one that it is linked to is known; only what moved in the last round can move others.
        reached = moved.select(F.col("word").alias("other"), F.col("since").alias("_from")).join(links, "other").join(asked.select("word", "seq"), "word").where("seq > _from")
        first = reached.groupBy("word").agg(F.min("seq").alias("new"))
        moved = stage(first.join(since, "word", "left").where("since IS NULL OR new < since").select("word", F.col("new").alias("since")), "moved")
        if moved.isEmpty():
            return since
        since = stage(since.join(moved.select("word"), "word", "left_anti").union(moved), "since")
    raise RuntimeError("the vocabulary did not settle")


def resolve_in_order(proposals: DataFrame, vocabulary: DataFrame, max_rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """(resolutions, vocabulary): every proposal in order of `seq`, and what the vocabulary has become.

    `proposals`: seq (unique), proposed. `vocabulary`: slug, synonyms, status, suggested;
    only confirmed rows are matched. resolutions: seq, proposed, slug, how (exact, linked
    or candidate), near (of a candidate: the slug of the nearest known word from .6 on).
    The vocabulary has the linked words as further synonyms, in order of arrival, and a
    row of status candidate for each word that was one at first, with what it was near
    to then; rows that are there are left alone. Ties in similarity go to the smaller
    word. Null proposals are passed over.
    """
    spark, mark = proposals.sparkSession, staged()
    asked = stage(proposals.where("proposed IS NOT NULL").select("seq", "proposed", normalize_capability(F.col("proposed")).alias("word")), "asked")
    known = stage(_known_words(vocabulary), "known")
    words = asked.select("word").union(known.select("word")).distinct()
    pairs = similar_pairs(words, fixed.NEAR_NAME, "word")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), "similarity").union(pairs.select("b", "a", "similarity"))
    both = stage(both, "similar")
    since = _settled(asked.join(known.select("word"), "word", "left_anti"), known, both.where(F.col("similarity") >= fixed.SAME_NAME).select("word", "other"), max_rounds)

    # Of each word, the nearest known one from each time on that a nearer one became known.
    ahead = both.join(since.select(F.col("word").alias("other"), F.col("since").alias("at")), "other")
    rank = F.struct((-F.col("similarity")).alias("s"), F.col("other").alias("w"))
    before = Window.partitionBy("word").orderBy("at", "s_w")
    steps = ahead.withColumn("s_w", rank).withColumn("best", F.min("s_w").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    steps = steps.where("best IS NULL OR s_w < best").select("word", "at", "other", "similarity")
    # Several at one time: the last of them is the best. It holds until the next.
    steps = steps.groupBy("word", "at").agg(F.min_by(F.struct("other", "similarity"), F.struct(-F.col("similarity"), "other")).alias("m"))
    steps = stage(steps.select("word", "at", "m.*", F.lead("at").over(Window.partitionBy("word").orderBy("at")).alias("until")), "steps")

    # A word that became known at an arrival points to what was nearest just before it.
    learnt = since.where(F.col("since") > ALWAYS).join(steps.where(F.col("similarity") >= fixed.SAME_NAME), "word").where("at < since AND (until IS NULL OR until >= since)")
    ends = known.select("word", "slug", F.lit(None).cast("string").alias("to")).union(learnt.select("word", F.lit(None).cast("string"), F.col("other")))
    ends = stage(ends, "ends")
    for _ in range(max_rounds):
        if ends.where("slug IS NULL").isEmpty():
            break
        its = ends.select(F.col("word").alias("to"), F.col("slug").alias("its"), F.col("to").alias("further"))
        ends = stage(ends.join(its, "to", "left").select("word", F.coalesce("slug", "its").alias("slug"), F.when(F.coalesce("slug", "its").isNull(), F.col("further")).alias("to")), "ends")
    else:
        raise RuntimeError("links of words did not settle")
    slug_of = ends.select("word", F.col("slug").alias("known_slug"))

    told = asked.join(since, "word", "left").join(slug_of, "word", "left")
    exact, linked = F.coalesce(F.col("seq") > F.col("since"), F.lit(False)), F.coalesce(F.col("seq") == F.col("since"), F.lit(False))
    told = told.withColumn("how", F.when(exact, "exact").when(linked, "linked").otherwise("candidate"))
    near = steps.join(slug_of.select(F.col("word").alias("other"), F.col("known_slug").alias("near")), "other").select(F.col("word").alias("_word"), "at", "until", "near")
    open_ = told.where("how = 'candidate'").join(near, (F.col("word") == F.col("_word")) & (F.col("at") < F.col("seq")) & (F.col("until").isNull() | (F.col("until") >= F.col("seq"))), "left")
    done = told.where("how <> 'candidate'").select("seq", "proposed", "word", F.col("known_slug").alias("slug"), "how", F.lit(None).cast("string").alias("near"))
    resolved = stage(done.union(open_.select("seq", "proposed", "word", F.col("word").alias("slug"), "how", "near")), "resolved")

    added = resolved.where("how = 'linked'").groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "word"))), lambda x: x["word"]).alias("added"))
    none = F.array().cast("array<string>")
    grown = vocabulary.join(added, "slug", "left").withColumn("synonyms", F.when(F.col("status") == "confirmed", F.concat(F.coalesce("synonyms", none), F.coalesce("added", none))).otherwise(F.col("synonyms")))
    grown = grown.select("slug", "synonyms", "status", "suggested")
    fresh = resolved.where("how = 'candidate'").groupBy("slug").agg(F.min_by("near", "seq").alias("suggested")).join(vocabulary.select("slug"), "slug", "left_anti")
    grown = stage(grown.union(fresh.select("slug", none.alias("synonyms"), F.lit("candidate").alias("status"), "suggested")), "vocabulary")
    out = stage(resolved.drop("word"), "resolutions")
    clear(spark, mark, keep=2)
    return out, grown
