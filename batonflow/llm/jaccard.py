"""N-gram Jaccard join by vertical partitioning.

Every document's shingles are put in one global order and cut into fragments by
their hash. Fragments of the documents' prefixes are joined on their own: each
counts the overlap of the pairs that meet in it, and the counts are summed per
pair. Pairs whose sum can still reach the threshold are verified over fragments
of the whole sets, again with partial overlaps summed per pair.

The order puts shingles that a sample of documents shows to be frequent last and
is by hash otherwise. Any order gives the same result; this one keeps frequent
shingles out of most prefixes. Documents that have them in their prefix all the
same are nearly all common text: families of near copies. Their links are found
from the family's most central document outward, and what is still apart is
compared in blocks until it is one component or proven apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from batonflow.llm.bits import bit_set, holds, parted, place, row_hash
from batonflow.llm.text import LOWER, bounds, in_batches, mix, shingles, slices, word_hashes
from batonflow.operators.graph import connected_components
from batonflow.staging import stage

WORDS, SHARE = 5, 75
#: One document of so many is sampled for the global order, and a shingle of so many of them is frequent.
SAMPLE, FREQUENT, MOST_FREQUENT = 16, 3, 1 << 17
#: A shingle with more documents than this is joined as a frequent one.
LARGE = 256
FRAGMENTS = 8
#: Pairs that a task makes at a time; of four times as many the counts are then added up.
PAIRS = 1 << 18
#: Shingles of one block of a family, before it meets another block.
BLOCK = 250_000


def set_of(data: np.ndarray, words: int = WORDS) -> np.ndarray:
    data = LOWER[data]
    starts, ends = bounds(data)
    return shingles(word_hashes(data, starts, ends), words)


def set_key(grams: np.ndarray) -> int:
    """A set's 64-bit fingerprint; 0 for the empty set."""
    if not len(grams):
        return 0
    total = grams.sum(keepdims=True) * np.uint64(3) + np.uint64(len(grams))
    return int(mix(np.bitwise_xor.reduce(mix(grams), keepdims=True) ^ total)[0].view(np.int64))


def prefix_length(n: int, share: int = SHARE) -> int:
    """Sets of Jaccard similarity `share` % or more meet in their first so many shingles, in any one order."""
    return n - -(-share * n // 100) + 1


def needed(na, nb, share: int = SHARE):
    """The least overlap of linked sets of these sizes."""
    return -(-share * (na + nb) // (100 + share))


def _sample(words: int):
    def run(batches):
        for batch in batches:
            found = [set_of(x, words) for x in slices(batch[0])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64))], names=["gram"])

    return run


def _sketch(words: int, share: int, frequent):
    schema = pa.schema([("doc_id", pa.int64()), ("set_id", pa.int64()), ("n", pa.int32()), ("rare", pa.list_(pa.int64())), ("common", pa.list_(pa.int64()))])

    def run(batches):
        last, seen = frequent.value, set()
        for batch in batches:
            ids, sets, sizes, rare, common = batch[0], [], [], [], []
            for data in slices(batch[1]):
                grams = set_of(data, words)
                n = len(grams)
                key = set_key(grams)
                sets.append(key)
                sizes.append(n)
                if not n or key in seen:  # equal sets of one task need their prefix once
                    rare.append([])
                    common.append([])
                    continue
                seen.add(key)
                p = prefix_length(n, share)
                known = np.isin(grams, last, assume_unique=True) if len(last) else np.zeros(n, bool)
                first = grams[~known][:p]
                rare.append(first.view(np.int64))
                common.append(grams[known][: p - len(first)].view(np.int64))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, t.type) for v, t in zip((sets, sizes, rare, common), list(schema)[1:], strict=True))], schema=schema)

    return run


def _meet(share: int, large: int):
    """Pairs of one task's fragment and their overlap in it (gram 0), or rows of shingles that too many share (b, c 0)."""
    names = ["a", "na", "b", "nb", "c", "gram"]

    def pack(a, na, b, nb, c, gram):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((a, na, b, nb, c, gram), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=names)

    def run(batches):
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not parts:
            return
        gram, doc, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        own, number = np.unique(doc, return_inverse=True)
        sizes = np.zeros(len(own), np.int32)
        sizes[number] = size
        order = np.lexsort((number, gram))
        gram, number = gram[order], number[order]
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (number[1:] != number[:-1])
        gram, number = gram[fresh], number[fresh]
        start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        length = np.diff(np.append(start, len(gram)))
        keys, held = [], 0
        pairs, counts = np.empty(0, np.int64), np.empty(0, np.int64)

        def merged():
            """`pairs`, ascending, and `counts`, with those of `keys`."""
            k, c = np.unique(np.concatenate(keys), return_counts=True)
            keys.clear()
            at = np.searchsorted(pairs, k)
            old = at < len(pairs)
            old[old] = pairs[at[old]] == k[old]
            counts[at[old]] += c[old]
            return np.insert(pairs, at[~old], k[~old]), np.insert(counts, at[~old], c[~old])

        for g in np.unique(length[(length > 1) & (length <= large)]):
            i, j = np.triu_indices(g, 1)
            at, step = start[length == g], max(1, PAIRS // len(i))
            for s in range(0, len(at), step):
                rows = number[at[s : s + step, None] + np.arange(g)]
                a, b = rows[:, i].ravel(), rows[:, j].ravel()
                near = np.minimum(sizes[a], sizes[b]) * 100 >= share * np.maximum(sizes[a], sizes[b])
                keys.append(a[near] * len(own) + b[near])
                if (held := held + len(keys[-1])) > 4 * PAIRS:
                    (pairs, counts), held = merged(), 0
        if keys:
            pairs, counts = merged()
        for s in range(0, len(pairs), PAIRS):
            a, b, c = pairs[s : s + PAIRS] // len(own), pairs[s : s + PAIRS] % len(own), counts[s : s + PAIRS]
            yield pack(own[a], sizes[a], own[b], sizes[b], c, np.zeros(len(c), np.int64))
        many = np.repeat(length > large, length)
        if many.any():
            n = number[many]
            zero = np.zeros(len(n), np.int64)
            yield pack(own[n], sizes[n], zero, zero, zero, gram[many])

    return run


def _fragments(words: int, bits):
    schema = pa.schema([("set_id", pa.int64()), ("n", pa.int32()), ("fragment", pa.int32()), ("grams", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            want = holds(bits.value, batch[0].to_numpy())
            keys, sizes, parts = [], [], []
            for data, wanted in zip(slices(batch[1]), want, strict=True):
                if wanted:
                    grams = set_of(data, words)
                    cuts = np.searchsorted(grams, np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(61))
                    keys.append(set_key(grams))
                    sizes.append(len(grams))
                    parts += [x.view(np.int64) for x in np.split(grams, cuts)]
            each = (np.repeat(np.array(keys, np.int64), FRAGMENTS), np.repeat(np.array(sizes, np.int32), FRAGMENTS), np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(keys)))
            yield pa.RecordBatch.from_arrays([*map(pa.array, each), pa.array(parts, schema[3].type)], schema=schema)

    return run


def _verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The linked ones of `pairs` (a, b): partial overlaps of the fragments, summed per pair."""
    # Each side's shuffle has only the sets that are on that side of a pair, and the bits' few false hits.
    own = lambda c: parted(sets, pairs.select(F.col(c).alias("set_id")).distinct(), "set_id")[1]
    left = pairs.select("a", "b").join(own("a").select(F.col("set_id").alias("a"), F.col("n").alias("na"), "fragment", F.col("grams").alias("ga")), "a")
    both = left.join(own("b").select(F.col("set_id").alias("b"), F.col("n").alias("nb"), "fragment", F.col("grams").alias("gb")), ["b", "fragment"])
    return (
        both.groupBy("a", "b", "na", "nb").agg(F.sum(F.size(F.array_intersect("ga", "gb"))).alias("overlap"))
        .where(F.col("overlap") * 100 >= (F.col("na") + F.col("nb") - F.col("overlap")) * share).select("a", "b")
    )


def _apart(share: int):
    """Links inside one block of a family between sets that are still in different components.

    Shingles that only one set of the block has are in no overlap and are left out.
    Every outsider is counted against all others through the lists of who has its
    shingles. A link joins two components, so a block
    gives fewer rows than it has sets.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys, first, number = np.unique(group["set_id"].to_numpy(), return_index=True, return_inverse=True)
        m, of, n = len(keys), group["component"].to_numpy()[first], group["n"].to_numpy()[first].astype(np.int64)
        out = group["out"].to_numpy()[first]
        lengths = group["grams"].map(len).to_numpy()
        gram, who = np.concatenate([*group["grams"], np.empty(0, np.int64)]), np.repeat(number, lengths)
        order = np.argsort(gram, kind="stable")
        gram, who = gram[order], who[order]
        start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        length = np.diff(np.append(start, len(gram)))
        which = np.repeat(np.arange(len(start)), length)
        shared = length[which] > 1
        by_set = np.argsort(who[shared], kind="stable")
        lists = which[shared][by_set]
        cuts = np.searchsorted(who[shared][by_set], np.arange(m + 1))
        _, label = np.unique(of, return_inverse=True)
        a, b = [], []
        for x in np.flatnonzero(out):
            mine = lists[cuts[x] : cuts[x + 1]]
            times = length[mine]
            at = np.repeat(start[mine] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            overlap = np.bincount(who[at], minlength=m)
            linked = (overlap * (100 + share) >= share * (n + n[x])) & (label != label[x])
            for y in np.flatnonzero(linked):
                if label[y] != label[x]:
                    label[label == label[y]] = label[x]
                    a.append(keys[x])
                    b.append(keys[y])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def jaccard_components(docs: DataFrame, words: int = WORDS, share: int = SHARE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id.

    Two rows are linked when their sets of shingles have a Jaccard similarity of
    `share` % or more; component_id is the smallest doc_id reachable by links.
    Null text and text without words have no shingles, no links and their own id
    as component. Repeated rows are linked to each other; a null id is passed over
    in minima. An empty table gives an empty result. Other columns are not read.
    Sets are told apart by 64-bit fingerprints.
    """
    return _components(docs, words, share, key, text).select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, words: int, share: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Components, with set_id and the `first` (doc_id, set_id) of each; a row without words has no first."""
    spark = docs.sparkSession
    texts = in_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sampled = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(_sample(words), "gram long")
    top = sampled.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "gram").limit(MOST_FREQUENT)
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in top.collect()], np.int64).view(np.uint64)))
    sketch = stage(texts.mapInArrow(_sketch(words, share, frequent), "doc_id long, set_id long, n int, rare array<long>, common array<long>"), "sketch")

    meet = sketch.select(F.explode("rare").alias("gram"), "set_id", "n").repartition("gram")
    met = stage(meet.mapInArrow(_meet(share, LARGE), "a long, na int, b long, nb int, c int, gram long"), "met")
    p = lambda n: n - F.ceil(n * share / 100) + 1
    summed = met.where("c > 0").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.sum("c").alias("c"), F.max(F.col("na") + F.col("nb")).alias("both"), F.max(F.greatest("na", "nb")).alias("most"), F.max(F.least("na", "nb")).alias("least")
    )
    rest = F.greatest(F.col("most") - p(F.col("most")), F.col("least") - p(F.col("least")))
    rare_pairs = stage(summed.where((F.col("c") + rest) * (100 + share) >= F.col("both") * share).select("a", "b"), "pairs")

    # Frequent shingles in prefixes: to the most central holder, the one with the largest part of its prefix common.
    common = sketch.where(F.size("common") > 0).select(F.explode("common").alias("gram"), "set_id", (F.size("common") * 1000 / p(F.col("n"))).cast("int").alias("central"))
    late = met.where("c = 0").select("gram", F.col("a").alias("set_id"), F.lit(0).alias("central"))
    holders = stage(common.unionByName(late), "holders")
    centre = holders.groupBy("gram").agg(F.max(F.struct("central", "set_id")).alias("m")).select("gram", F.col("m.set_id").alias("b"))
    star = stage(holders.join(centre, "gram").where("set_id <> b").select(F.least("set_id", "b").alias("a"), F.greatest("set_id", "b").alias("b")).distinct(), "star")

    first = rare_pairs.union(star)
    wanted = first.select(F.col("a").alias("set_id")).union(first.select(F.col("b"))).distinct()
    known = sketch.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    chosen = stage(known.join(wanted, "set_id", "left_semi").select("doc_id"), "chosen")
    words_of_bits = bit_set(chosen, "doc_id")
    bits = spark.sparkContext.broadcast(words_of_bits)
    made = texts.select(place(F.col("doc_id"), len(words_of_bits) * 64).alias("at"), "text").mapInArrow(_fragments(words, bits), "set_id long, n int, fragment int, grams array<long>")
    # Sets of the bits' few false hits are there too, and no pair asks for them.
    sets = stage(made.where("n > 0").dropDuplicates(["set_id", "fragment"]), "sets")

    links = stage(_verified(stage(first.distinct(), "candidates"), sets, share), "links")
    families = connected_components(star, "a", "b").withColumnRenamed("component", "family")
    links = stage(links.union(_blocks(families, connected_components(links, "a", "b"), sets, share)), "links")

    nodes = connected_components(links, "a", "b").select(F.col("node").alias("set_id"), F.col("component").alias("root"))
    rows = sketch.select("doc_id", "n", "set_id").join(nodes, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = rows.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "set_id"))).alias("first"))
    return rows.join(least, "root", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        "set_id", F.when(F.col("n") > 0, F.col("first")).alias("first"),
    )


def without_near_duplicates(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """`docs` (doc_id, text and any others): of each group of near duplicates the document with the smallest id.

    Rows of one id are documents of their own: those that aren't near duplicates all
    stay, of a group with several of its smallest id one does, the first by a hash
    of its shingles and then of the row. Rows without words are in no group, but of
    an id's one stays; rows without an id can't be named by their group and stay too.
    """
    found = stage(_components(docs.select("doc_id", "text"), words, share), "components")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    again = stage(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"), "again")
    once, many = docs, None
    if not again.isEmpty():
        once, many = parted(docs, again, "doc_id")
        once = once.union(many.join(again, "doc_id", "left_anti").select(*docs.columns))
        # Merged: the shuffle keeps parted() and _keyed out of one task, which would hold a Python worker for each.
        many = _firsts(many.join(again.hint("merge"), "doc_id", "left_semi").select(*docs.columns), found.join(again, "doc_id", "left_semi"), words)
    sure, may = parted(once, gone, "doc_id")
    kept = sure.union(may.join(gone, "doc_id", "left_anti").select(*docs.columns))
    return kept if many is None else kept.union(many)


def _keyed(words: int):
    def run(batches):
        for batch in batches:
            sets = pa.array([set_key(set_of(data, words)) for data in slices(batch["text"])], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sets], names=[*batch.schema.names, "_set"])

    return run


def _firsts(many: DataFrame, found: DataFrame, words: int) -> DataFrame:
    """Of `many`, rows of repeated ids: one of each id and set that is first in its group or has no words."""
    keep = found.where(F.col("first").isNull() | (F.col("first") == F.struct("doc_id", "set_id"))).select("doc_id", F.col("set_id").alias("_set")).distinct()
    schema = ", ".join(f"`{c}` {kind}" for c, kind in [*many.dtypes, ("_set", "long")])
    keyed = in_batches(many).mapInArrow(_keyed(words), schema).withColumn("_hash", row_hash(many))
    rows = stage(keyed.join(keep, ["doc_id", "_set"], "left_semi"), "repeated")
    least = rows.groupBy("doc_id", "_set").agg(F.min("_hash").alias("_hash"))
    return rows.join(least, ["doc_id", "_set", "_hash"], "left_semi").dropDuplicates(["doc_id", "_set"]).select(*many.columns)


def _blocks(families: DataFrame, components: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links between the parts of a family that are still apart, found in blocks of a bounded number of shingles.

    The largest component of a family is its main part, the rest are outsiders. What
    is missing has an outsider at one end at least: blocks of outsiders meet blocks of
    the main part and each other, and the main part's blocks never meet.
    """
    members = families.withColumnRenamed("node", "set_id").join(components.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    members = members.join(sets.where("fragment = 0").select("set_id", "n"), "set_id")
    parts = members.groupBy("family", "component").agg(F.sum("n").alias("size"))
    split = parts.groupBy("family").agg(F.max(F.struct("size", "component")).alias("m"), F.sum("size").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda size: F.greatest(F.lit(1), F.ceil(size / BLOCK)).cast("int")
    split = split.select("family", F.col("m.component").alias("main"), blocks(F.col("m.size")).alias("mains"), blocks(F.col("all") - F.col("m.size")).alias("outs"))
    members = stage(members.join(split, "family").withColumn("out", F.col("component") != F.col("main")), "members")
    spread = lambda n: F.sequence(F.lit(0), n - 1)
    at = lambda n: F.pmod(F.xxhash64("set_id", F.lit(7)), n).cast("int")
    pick = ["family", "i", "j", "out", "set_id", "component", "n"]
    outs = members.where("out").withColumn("own", at(F.col("outs")))
    # (i, j): outsiders of block i and the main part's block j, or, j below 0, outsiders of block -1 - j.
    there = outs.withColumn("j", F.explode(spread(F.col("mains")))).withColumn("i", F.col("own"))
    among = outs.withColumn("other", F.explode(spread(F.col("outs")))).withColumn("i", F.least("own", "other")).withColumn("j", -1 - F.greatest("own", "other"))
    mains = members.where("NOT out").withColumn("j", at(F.col("mains"))).withColumn("i", F.explode(spread(F.col("outs"))))
    dealt = there.select(pick).union(among.select(pick)).union(mains.select(pick))
    rows = dealt.join(sets.select("set_id", "grams"), "set_id")
    return rows.groupBy("family", "i", "j").applyInPandas(_apart(share), "a long, b long")
