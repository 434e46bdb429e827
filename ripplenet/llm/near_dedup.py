"""Near-duplicate groups of weighted word shingles by ProbMinHash, banding and exact verification.

Every distinct shingle of a text sends arrivals of a Poisson process whose rate is its number of occurrences; each
arrival falls on a random register, and a register keeps the shingle that arrived first. Two texts agree in a register
with the probability Jaccard similarity of their weighted shingles. Shingles whose next arrival lies behind the last
register's first one stop early, so long texts cost little more than one arrival for each shingle.

Texts with equal word sequences collapse to one representative first. Bands of registers then propose pairs of
representatives, in three steps that each see less than the one before. First every text meets the lead of the few
smallest of its buckets, and verified links form components. Then all buckets are looked at as components, one row for each
component in a bucket and none for its members: a bucket of one component is settled, in another the components' leads
meet. Only buckets that still hold several components and more than two texts are opened: all pairs of different
components where it has up to ``ALL_PAIRS`` texts; in a larger one each text meets the lead of a random part of it, then the
hubs of the bucket, the texts with most links, and what is outside the main component after that is compared with all others
in blocks, so that no pair that shares a band is left out. Every proposal is verified on whole shingle sets or lies inside a
component. Groups are connected components, found by label passing between written tables.

The link is the Jaccard similarity of the distinct shingles, at least ``SIMILARITY``. A pair of that similarity shares
no band of the unit rates with probability (1 - 0.8 ** ROWS) ** BANDS, about 5e-5.

Nulls and edge cases: texts without a word (null and empty ones too) join no group. A text of one to four words has its
word sequence as its only shingle. Rows that repeat an id are one document: the groups of
their texts are one group, and where their texts differ the greatest shingle set stands for them in verification. Rows
with a null ``doc_id`` are documents of their own, one for each different text, and sort last; a group without any other
row has a null ``class_id``. An empty table gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplenet.llm.common import greatest_id, whole_text, with_identity
from ripplenet.storage import materialize

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
# Buckets of each text whose leads are verified first.
FIRST_BUCKETS = 3
ALL_PAIRS, PART = 32, 16
HUB_ROUNDS, BLOCK = 2, 64
# Ids whose texts are wanted are sent to all executors up to this number, 8 MB; beyond it they are joined by shuffle.
BROADCAST_IDS = 1_000_000
# Characters that one vectorised step takes together, and words whose hashes a worker keeps.
STEP_CHARS, MAX_WORDS = 2_000_000, 500_000
_WORDS = re.compile(r"\w+").findall
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_hashes = WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, shingle hash, occurrences)`` of the distinct shingles of several texts, ordered by text and hash."""
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((_hashes[w] for one in words for w in one), np.uint64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    length = np.minimum(sizes, SHINGLE)
    made = np.where(sizes > 0, np.maximum(sizes - SHINGLE + 1, 1), 0)
    text = np.repeat(np.arange(len(words)), made)
    first = np.arange(int(made.sum())) - np.repeat(np.cumsum(made) - made, made) + starts[text]
    value = length[text].astype(np.uint64)
    for k in range(SHINGLE):
        inside = k < length[text]
        value[inside] = _mix(value[inside] * _BASE + flat[first[inside] + k])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.append(at, len(value)))


def signatures(n_texts: int, text: np.ndarray, value: np.ndarray, weight: np.ndarray, registers: int) -> np.ndarray:
    """ProbMinHash: the shingle that arrives first at each register of each text; texts without shingles keep zeros."""
    first = np.full(n_texts * registers, np.inf)
    winner = np.zeros(n_texts * registers, np.uint64)
    time, rate, step = np.zeros(len(value)), weight.astype(float), np.zeros(1, np.uint64)
    while len(value):
        step += np.uint64(1)
        draw = _mix(value + step * _BASE)
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / rate
        place = text * registers + (_mix(draw) % np.uint64(registers)).astype(np.int64)
        ahead = np.flatnonzero(time < first[place])
        ahead = ahead[np.argsort(-time[ahead], kind="stable")]  # the earliest is written last and stays
        first[place[ahead]] = time[ahead]
        winner[place[ahead]] = value[ahead]
        go_on = time < first.reshape(n_texts, registers).max(1)[text]
        text, value, rate, time = text[go_on], value[go_on], rate[go_on], time[go_on]
    return winner.reshape(n_texts, registers)


def band_keys(winners: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of each signature; the band's number is part of its key."""
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(winners), bands)).copy()
    for k in range(rows):
        keys = _mix(keys * _BASE + winners.reshape(len(winners), bands, rows)[:, :, k])
    return keys.view(np.int64)


def text_keys(n_texts: int, text: np.ndarray, value: np.ndarray, weight: np.ndarray, bands: int, rows: int) -> list[np.ndarray]:
    """The distinct band keys of each text: of its shingles at rate 1, and of their occurrences where a shingle repeats.

    Both sets have the same band numbers, as without repeats they are the same.
    """
    unit = band_keys(signatures(n_texts, text, value, np.ones(len(value)), bands * rows), bands, rows)
    repeats = np.zeros(n_texts, bool)
    repeats[text[weight > 1]] = True
    some = repeats[text]
    number = np.cumsum(repeats) - 1
    weighted = band_keys(
        signatures(int(repeats.sum()), number[text[some]], value[some], weight[some], bands * rows), bands, rows
    )
    return [np.union1d(u, weighted[number[i]]) if repeats[i] else u for i, u in enumerate(unit)]


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    """Slices of a batch whose texts have some ``STEP_CHARS`` characters, with their words."""
    start, size, words = 0, 0, []
    texts = batch.column("text")
    for i in range(batch.num_rows):
        text = texts[i].as_py().lower()
        words.append(_WORDS(text))
        size += len(text)
        if size >= STEP_CHARS or i + 1 == batch.num_rows:
            yield batch.slice(start, i + 1 - start), words
            start, size, words = i + 1, 0, []


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(_id, _c1, _c2, bands)`` for each row of ``docs (_id, text)`` with words.

    These are a 128-bit hash of its word sequence, and its band keys.
    """

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in _steps(batch):
                some = np.array([bool(w) for w in words])
                own = [k for k, w in zip(text_keys(len(words), *shingles(words), bands, rows), words, strict=True) if w]
                codes = np.frombuffer(
                    b"".join(xxhash.xxh3_128_digest(" ".join(w)) for w in words if w), np.int64
                ).reshape(-1, 2)
                keys = np.concatenate(own) if own else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id").filter(pa.array(some)), pa.array(codes[:, 0]), pa.array(codes[:, 1]),
                        _lists(keys, np.array([len(k) for k in own], np.int64)),
                    ],
                    ["_id", "_c1", "_c2", "bands"],
                )

    texts = docs.select("_id", whole_text().alias("text"))
    return texts.mapInArrow(sketched, "_id bigint, _c1 bigint, _c2 bigint, bands array<bigint>")


def band_rows(classes: DataFrame, first: int | None = None) -> DataFrame:
    """``(rep, _key)``: the buckets of each of ``classes (rep, bands)``, or the ``first`` of them in order of their keys."""
    bands = F.col("bands") if first is None else F.slice(F.array_sort("bands"), 1, first)
    return classes.select(*[c for c in classes.columns if c != "bands"], F.explode(bands).alias("_key"))


def lead_pairs(keys: DataFrame) -> DataFrame:
    """``(a, b)``: every other text of a bucket of ``keys (rep, _key)`` with the smallest one, its lead."""
    leads = keys.groupBy("_key").agg(F.min("rep").alias("a"), F.max("rep").alias("_last")).where("a < _last")
    return keys.join(leads.select("_key", "a"), "_key").where("a < rep").select("a", F.col("rep").alias("b")).distinct()


def labelled(rows: DataFrame, labels: DataFrame, name: str = "rep") -> DataFrame:
    """``rows`` with the ``label`` of ``name`` in ``labels (v, label)``; a text without links is its own component."""
    found = rows.join(labels.select(F.col("v").alias(name), "label"), name, "left")
    return found.withColumn("label", F.coalesce("label", name))


def bucket_components(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """``(_key, lead, _lead, _n)``: the components of each bucket that holds several, by their smallest texts.

    ``_lead`` is the bucket's smallest text and ``_n`` its number of texts. Members are counted before the shuffle.
    """
    parts = band_rows(labelled(classes, labels)).groupBy("_key", "label").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("_n"))
    parts = materialize(parts, "band-components")
    several = parts.groupBy("_key").agg(F.min("lead").alias("_lead"), F.max("lead").alias("_last"), F.sum("_n").alias("_n"))
    several = several.where("_lead < _last").drop("_last")
    return materialize(parts.select("_key", "lead").join(several, "_key"), "divided-buckets")


def open_buckets(parts: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """``(_key, rep, label, _n, _lead)``: the members of buckets of ``parts`` with more than two texts that are still divided."""
    named = labelled(parts.where("_n > 2").select("_key", "lead", "_n", "_lead"), labels, "lead")
    still = named.groupBy("_key").agg(
        F.min("label").alias("_low"), F.max("label").alias("_high"), F.first("_n").alias("_n"), F.first("_lead").alias("_lead")
    )
    still = materialize(still.where("_low < _high").select("_key", "_n", "_lead"), "open-buckets")
    return materialize(labelled(band_rows(classes).join(still, "_key"), labels), "band-members")


def opened_pairs(members: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of different components: all in a bucket of up to ``ALL_PAIRS`` texts, part leads in a larger one."""
    small = members.where(F.col("_n") <= ALL_PAIRS).groupBy("_key").agg(F.sort_array(F.collect_set(F.struct("rep", "label"))).alias("m"))
    one = small.select(F.posexplode("m").alias("i", "x"), "m")
    pairs = one.select("x", F.explode(F.expr("filter(slice(m, i + 2, size(m)), y -> y.label <> x.label)")).alias("y"))
    part = F.pmod(F.xxhash64("rep", "_key"), F.ceil(F.col("_n") / PART)).alias("_part")
    large = members.where(F.col("_n") > ALL_PAIRS).select("_key", part, "rep", "label")
    heads = large.groupBy("_key", "_part").agg(F.min(F.struct("rep", "label")).alias("_head"))
    parts = large.join(heads, ["_key", "_part"]).where("label <> _head.label").select(F.col("_head.rep").alias("a"), F.col("rep").alias("b"))
    return pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).unionByName(parts).distinct()


def divided(large: DataFrame, labels: DataFrame) -> DataFrame:
    """``(_key, rep, _lead, label)``: the members of ``large (_key, rep, _lead)`` whose bucket holds several components."""
    named = labelled(large, labels)
    ends = named.groupBy("_key").agg(F.min("label").alias("_low"), F.max("label").alias("_high"))
    return materialize(named.join(ends.where("_low < _high"), "_key", "left_semi"), "divided")


def hub_pairs(members: DataFrame, links: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)`` of each divided bucket's hub with its members in other components, and the hubs ``(_key, rep)``.

    The hub is the member with most links so far that is not in ``used``: the text that others were copied from has many,
    while its copies may be too far from each other.
    """
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("_links"))
    free = members.join(used, ["_key", "rep"], "left_anti").join(ends, "rep")
    best = free.groupBy("_key").agg(F.max(F.struct("_links", (-F.col("rep")).alias("_r"), "label")).alias("_b"))
    hubs = materialize(best.select("_key", (-F.col("_b._r")).alias("_hub"), F.col("_b.label").alias("_of")), "hubs")
    met = members.join(hubs, "_key").where(F.col("label") != F.col("_of"))
    pairs = met.select(F.least("_hub", "rep").alias("a"), F.greatest("_hub", "rep").alias("b")).distinct()
    return pairs, hubs.select("_key", F.col("_hub").alias("rep"))


def remaining_links(members: DataFrame, sets: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` between members of divided buckets in different components, by exact comparison in blocks.

    Buckets that share texts form a region, so a text is compared once and not once for each band. The members outside the
    region's main component meet all members, a block of each at a time; a task indexes one block's shingles and
    counts what the texts of the other share with it. No pair leaves a task unless it is a link.
    """
    if "_lead" not in members.columns:
        members = members.join(members.groupBy("_key").agg(F.min("rep").alias("_lead")), "_key")
    led = members.select("rep", F.col("_lead").alias("b")).distinct()
    first = led.groupBy("rep").agg(F.min("b").alias("a"))
    # Leads that share a text belong together; a region is named by its smallest lead.
    joined = led.join(first, "rep").where("a <> b").select("a", "b").distinct()
    named = components(joined).select(F.col("v").alias("a"), "label")
    regions = first.join(named, "a", "left").select("rep", F.coalesce("label", "a").alias("_region"))
    texts = materialize(members.select("rep", "label").distinct().join(regions, "rep"), "region-texts")
    counts = texts.groupBy("_region", "label").agg(F.count(F.lit(1)).alias("_n")).groupBy("_region").agg(
        F.sum("_n").alias("_all"), F.max(F.struct("_n", "label")).alias("_main")
    )
    blocks = lambda n: F.ceil(n / F.lit(block)).cast("int")
    sized = counts.select(
        "_region", F.col("_main.label").alias("_main"), blocks(F.col("_all")).alias("_of_all"),
        blocks(F.col("_all") - F.col("_main._n")).alias("_of_out"),
    )
    row = F.collect_list(F.struct("rep", "label", "shingles"))
    held = texts.join(sized, "_region").join(sets.select(F.col("_id").alias("rep"), "shingles"), "rep")
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n).cast("bigint")).cast("int")
    key = ["_region", "_o", "_c"]
    partners = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = held.where(F.col("label") != F.col("_main")).withColumn("_o", part("_of_out"))
    outside = outside.groupBy("_region", "_o", "_of_all").agg(row.alias("_x")).withColumn("_c", partners("_of_all"))
    everyone = held.withColumn("_c", part("_of_all")).groupBy("_region", "_c", "_of_out").agg(row.alias("_y"))
    everyone = everyone.where("_of_out > 0").withColumn("_o", partners("_of_out"))
    both = outside.select(*key, "_x").join(everyone.select(*key, "_y"), key).select("_x", "_y")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for x, y in zip(batch.column("_x"), batch.column("_y"), strict=True):
                found += block_links(x.values, y.values, similarity)
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return both.mapInArrow(compared, "a bigint, b bigint").distinct()


def block_links(x: pa.StructArray, y: pa.StructArray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of a text of ``x`` and one of ``y`` in different components with at least that Jaccard similarity."""
    ids, labels = (x.field(n).to_numpy() for n in ("rep", "label"))
    sets = x.field("shingles")
    sizes = np.diff(sets.offsets.to_numpy())
    flat = sets.values.to_numpy()[sets.offsets[0].as_py() : sets.offsets[-1].as_py()]
    order = np.argsort(flat, kind="stable")
    index, owner = flat[order], np.repeat(np.arange(len(ids)), sizes)[order]
    out = []
    for other in y:
        own = other["shingles"].values.to_numpy()
        low, high = np.searchsorted(index, own, "left"), np.searchsorted(index, own, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        shared = np.bincount(owner[at], minlength=len(ids))
        fits = (shared >= similarity * (sizes + len(own) - shared)) & (labels != other["label"].as_py()) & (shared > 0)
        rep = other["rep"].as_py()
        out += [(min(i, rep), max(i, rep)) for i in ids[fits].tolist()]
    return out


def shingle_sets(docs: DataFrame, ids: DataFrame, few: bool = False) -> DataFrame:
    """``(_id, shingles)`` for the documents listed in ``ids (_id)``: sorted distinct shingle hashes.

    ``few`` ids go to all executors.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in _steps(batch):
                text, value, _ = shingles(words)
                sizes = np.bincount(text, minlength=len(words))
                yield pa.RecordBatch.from_arrays([part.column("_id"), _lists(value.view(np.int64), sizes)], ["_id", "shingles"])

    # Building on the ids keeps the texts unsorted.
    texts = docs.select("_id", whole_text().alias("text"))
    texts = texts.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "_id", "left_semi")
    sets = texts.mapInArrow(listed, "_id bigint, shingles array<bigint>")
    return sets.groupBy("_id").agg(F.max("shingles").alias("shingles"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The ``(a, b)`` whose shingle sets have at least that Jaccard similarity."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("_x"), batch.column("_y"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("_id").alias("a"), F.col("shingles").alias("_x"))
    right = sets.select(F.col("_id").alias("b"), F.col("shingles").alias("_y"))
    sized = F.size("_x").cast("double"), F.size("_y").cast("double")
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    both = both.where(F.least(*sized) >= similarity * F.greatest(*sized))
    return both.mapInArrow(checked, "a bigint, b bigint")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(v, label)`` for each vertex of ``links (a, b)``: the smallest vertex of its component.

    Labels pass along links and then jump to their own label's label; every round is a written table. With ``known``, the
    labels of earlier links, only the components that the new ``links`` join take part, and the vertices of both are labelled.
    """
    if known is not None:
        return _joined_components(links, known)
    both = links.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("u")))
    both = materialize(both, "links")
    labels = materialize(both.groupBy("v").agg(F.least("v", F.min("u")).alias("label")), "labels")
    while True:
        of = labels.select(F.col("v").alias("u"), F.col("label").alias("_near"))
        near = both.join(of, "u").groupBy("v").agg(F.min("_near").alias("_near"))
        passed = labels.join(near, "v").select("v", F.least("label", "_near").alias("_new"), "label")
        jump = labels.select(F.col("v").alias("_new"), F.col("label").alias("_next"))
        after = passed.join(jump, "_new", "left").select(
            "v", F.least("_new", F.coalesce("_next", "_new")).alias("label"), F.col("label").alias("_old")
        )
        after = materialize(after, "labels")
        labels = after.select("v", "label")
        if after.where("label <> _old").isEmpty():
            return labels


def _joined_components(links: DataFrame, known: DataFrame) -> DataFrame:
    """``known (v, label)`` after the components at the ends of ``links`` became one, and the vertices that only ``links`` have."""
    ends = labelled(links.select("a", "b"), known, "a").select(F.col("label").alias("x"), "b")
    ends = labelled(ends, known, "b").select(F.least("x", "label").alias("a"), F.greatest("x", "label").alias("b"))
    joins = materialize(ends.where("a < b").distinct(), "component-links")
    if joins.isEmpty():
        return known
    joined = components(joins)
    renamed = joined.select(F.col("v").alias("label"), F.col("label").alias("_new"))
    renamed = known.join(renamed, "label", "left").select("v", F.coalesce("_new", "label").alias("label"))
    return materialize(renamed.unionByName(joined.join(known, "v", "left_anti").select("v", "label")), "labels")


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(_id, _class)`` for each identity of ``docs (_id, text)`` that is not the smallest of its group, and that smallest."""
    sketch = materialize(sketches(docs), "sketches")
    code = ["_c1", "_c2"]
    classes = materialize(sketch.groupBy(code).agg(F.min("_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    memberships = sketch.select("_id", *code).join(classes.select(*code, "rep"), code).select("_id", "rep").distinct()
    memberships = materialize(memberships, "memberships")
    several = memberships.groupBy("_id").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    one_id = memberships.join(several.select("_id", "a"), "_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    sets = None
    tested: list[DataFrame] = []

    def want(ids: DataFrame) -> None:
        """Makes the shingle sets of those ``ids (_id)`` that have none yet."""
        nonlocal sets
        ids = materialize(ids if sets is None else ids.join(sets.select("_id"), "_id", "left_anti"), "texts-wanted")
        n = ids.count()
        if n or sets is None:
            made = materialize(shingle_sets(docs, ids, n <= BROADCAST_IDS), "shingle-sets")
            sets = made if sets is None else sets.unionByName(made)

    def test(pairs: DataFrame) -> DataFrame:
        """The links among those ``pairs (a, b)`` that were not tested yet."""
        if tested:
            pairs = pairs.join(_all(tested), ["a", "b"], "left_anti")
        pairs = materialize(pairs, "proposals")
        tested.append(pairs)
        want(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct())
        return materialize(verified(pairs, sets, similarity), "links")

    links = test(lead_pairs(band_rows(classes.select("rep", "bands"), FIRST_BUCKETS))).unionByName(one_id)
    labels = components(links)
    parts = bucket_components(classes.select("rep", "bands"), labels)
    fresh = test(parts.where("_lead < lead").select(F.col("_lead").alias("a"), F.col("lead").alias("b")).distinct())
    links, labels = links.unionByName(fresh), components(fresh, labels)
    opened = open_buckets(parts, classes.select("rep", "bands"), labels)
    fresh = test(opened_pairs(opened))
    links, labels = links.unionByName(fresh), components(fresh, labels)
    large = opened.where(F.col("_n") > ALL_PAIRS).select("_key", "rep", "_lead")
    members = divided(large, labels)
    used = members.select("_key", "rep").limit(0)
    for _ in range(HUB_ROUNDS):
        if members.isEmpty():
            break
        hubs, chosen = hub_pairs(members, links, used)
        used, fresh = used.unionByName(chosen), test(hubs)
        if fresh.isEmpty():
            break
        links, labels = links.unionByName(fresh), components(fresh, labels)
        members = divided(large, labels)
    if not members.isEmpty():
        want(members.select(F.col("rep").alias("_id")).distinct())
        labels = components(materialize(remaining_links(members, sets, similarity), "links"), labels)
    named = memberships.join(labels.select(F.col("v").alias("rep"), "label"), "rep", "left")
    members = named.groupBy("_id").agg(F.min(F.coalesce("label", "rep")).alias("_class"))
    return members.where(F.col("_id") != F.col("_class"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, class_id, kept)`` for each row: the smallest id of its group, and whether the row has that id."""
    greatest = greatest_id(docs)
    rows = with_identity(docs.select("doc_id", "text"), greatest)
    out = rows.select("doc_id", "_id").join(copies(rows.select("_id", "text"), similarity), "_id", "left")
    found = F.coalesce("_class", "_id")
    # Identities of rows with a null id lie behind the greatest id.
    return out.select(
        "doc_id", F.when(F.col("doc_id").isNotNull() | (found <= greatest), found).alias("class_id"),
        (found == F.col("_id")).alias("kept"),
    )
