"""Finding benchmark items, exact or edited, inside training texts.

Benchmark items are taken in blocks of bounded size; each block's n-gram seeds are broadcast and every whole text is
scanned for them. What a hit leaves behind is a short window of words around it, so texts are never shuffled. The seeds'
frequency over all windows of the corpus tells the rare ones: a window goes on if it holds two different seeds of the
item, or one that is rare for it. Smith-Waterman alignment of the item with the window then gives the score: matching
words count 2, replaced, added and missing ones -1, as a share of the best possible score. A link needs a share of
``MIN_SCORE``, or, however long the item is, the score of an exact run of ``MIN_RUN`` words, so that a passage from a long
item is found as well. Shorter passages that are also less than half of their item are left alone.

With three-word seeds every copy of an item has a seed if up to a quarter of its words were replaced, since among that
many replacements at least one run of three words stays whole.

Nulls and edge cases: null or empty texts and items match nothing, nor do items of fewer than three words. Rows that
repeat a document's or an item's id are one document or item, null ids too. Ties between places of equal score go to the
first. Empty tables give an empty result. Other columns of the inputs are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplenet.llm.common import whole_text
from ripplenet.storage import materialize

SEED = 3
MIN_SCORE, MIN_RUN = 0.5, 50
MATCH, MISS = 2, -1
# Words of the benchmark in one block: its broadcast takes some 50 MB at most.
BLOCK_WORDS = 500_000
_WORD = re.compile(r"\w+")
_BASE, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_WINDOWS = "doc_id bigint, item int, seeds array<int>, words array<string>, starts array<int>, ends array<int>"
_LINKS = "doc_id bigint, item_id bigint, score double, start int, end int"


@dataclass
class Block:
    """Some benchmark items: their words as numbers, and their seeds as sorted codes with the items that hold them."""

    item_ids: list[int | None]
    items: list[list[str]]
    numbers: dict[str, int]
    codes: np.ndarray
    owners: list[np.ndarray]


def _codes(numbers: np.ndarray) -> np.ndarray:
    """A code for each run of ``SEED`` word numbers; 0 where a word is unknown. Alignment settles any collision."""
    n = len(numbers) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    code, known = np.ones(n, np.uint64), np.ones(n, bool)
    for k in range(SEED):
        part = numbers[k : n + k]
        known &= part > 0
        code = (code * _BASE + part.astype(np.uint64)) * _FOLD
        code ^= code >> np.uint64(29)
    return np.where(known, code | np.uint64(1), np.uint64(0))


def make_block(rows: list[tuple[int | None, str]]) -> Block:
    items = [_WORD.findall(text.lower()) for _, text in rows]
    numbers: dict[str, int] = {}
    for words in items:
        for w in words:
            numbers.setdefault(w, len(numbers) + 1)
    coded = [_codes(np.array([numbers[w] for w in words], np.int64)) for words in items]
    code = np.concatenate([np.zeros(0, np.uint64), *coded])
    owner = np.repeat(np.arange(len(items)), [len(c) for c in coded])
    codes, inverse = np.unique(code, return_inverse=True)
    order = np.lexsort((owner, inverse))
    cuts = np.flatnonzero(np.diff(inverse[order])) + 1
    owners = [np.unique(x) for x in np.split(owner[order], cuts)] if len(code) else []
    return Block([i for i, _ in rows], items, numbers, codes, owners)


def find_windows(text: str, block: Block) -> list[tuple[int, list[int], list[str], list[int], list[int]]]:
    """(item, seeds, words, starts, ends) around each group of hits of an item in the text."""
    number = block.numbers.get
    words = _WORD.findall(text.lower())
    codes = _codes(np.array([number(w, 0) for w in words], np.int64))
    at = np.flatnonzero(codes)
    if not len(at) or not len(block.codes):
        return []
    place = np.minimum(np.searchsorted(block.codes, codes[at]), len(block.codes) - 1)
    hit = block.codes[place] == codes[at]
    hits: dict[int, list[tuple[int, int]]] = {}
    for pos, seed in zip(at[hit].tolist(), place[hit].tolist(), strict=True):
        for item in block.owners[seed].tolist():
            hits.setdefault(item, []).append((pos, seed))
    if not hits:
        return []
    spots = [m.span() for m in _WORD.finditer(text)]
    if len(spots) != len(words):  # lower case changed the words: offsets then come from the lowered text
        spots = [m.span() for m in _WORD.finditer(text.lower())]
    out = []
    for item, found in hits.items():
        length = len(block.items[item])
        groups = [[found[0]]]
        for one in found[1:]:
            if one[0] - groups[-1][-1][0] > 2 * length:
                groups.append([])
            groups[-1].append(one)
        for group in groups:
            low, high = max(0, group[0][0] - length), min(len(words), group[-1][0] + SEED + length)
            spans = spots[low:high]
            seeds = sorted({seed for _, seed in group})
            out.append((item, seeds, words[low:high], [a for a, _ in spans], [b for _, b in spans]))
    return out


def align(item: list[str], words: list[str]) -> tuple[float, int, int]:
    """Best Smith-Waterman score as a share of a full match, and the first and last word of the aligned part.

    One row for each word of the item. Within a row, gaps run on through a running maximum; ``origin`` carries the word
    at which the best alignment ending at a cell began.
    """
    numbers = {w: i for i, w in enumerate(dict.fromkeys(item))}
    row_of = np.array([numbers.get(w, -1) for w in words])
    n = len(words)
    steps = np.arange(n + 1) * -MISS
    score, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, first, last = 0, 0, 0
    for w in item:
        diagonal = score[:-1] + np.where(row_of == numbers[w], MATCH, MISS)
        above = score[1:] + MISS
        take = diagonal >= above
        cell = np.concatenate([[0], np.maximum(np.where(take, diagonal, above), 0)])
        begun = np.concatenate([[0], np.where(take, origin[:-1], origin[1:])])
        begun = np.where(cell == 0, np.arange(n + 1), begun)
        lifted = cell + steps
        top = np.maximum.accumulate(lifted)
        holder = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        score = top - steps
        origin = np.where(score > 0, begun[holder], np.arange(n + 1))
        end = int(np.argmax(score))
        if score[end] > best:
            best, first, last = int(score[end]), int(origin[end]), end - 1
    return best / (MATCH * len(item)) if item else 0.0, first, last


def _scan(docs: DataFrame, shared) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = ["doc_id", "item", "seeds", "words", "starts", "ends"]
        for batch in batches:
            rows = [
                (doc.as_py(), *window)
                for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True)
                for window in find_windows(text.as_py(), block)
            ]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")).mapInArrow(scan, _WINDOWS)


def rare_seeds(block: Block, frequency: dict[int, int]) -> list[set[int]]:
    """For each item, its seeds that no more windows hold than its median seed; seeds without a window count 0."""
    seeds: list[list[int]] = [[] for _ in block.items]
    for seed, owners in enumerate(block.owners):
        for item in owners.tolist():
            seeds[item].append(seed)
    out = []
    for own in seeds:
        counts = sorted(frequency.get(s, 0) for s in own)
        out.append({s for s in own if frequency.get(s, 0) <= counts[(len(counts) - 1) // 2]})
    return out


def _aligned(windows: DataFrame, shared, rare: list[set[int]], min_score: float, min_run: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            rows = []
            for w in batch.to_pylist():
                if len(w["seeds"]) < 2 and not rare[w["item"]].intersection(w["seeds"]):
                    continue
                item = block.items[w["item"]]
                score, first, last = align(item, w["words"])
                if score >= min_score or round(score * MATCH * len(item)) >= MATCH * min_run:
                    rows.append((w["doc_id"], block.item_ids[w["item"]], score, w["starts"][first], w["ends"][last]))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "score", "start", "end"]
            )

    return windows.mapInArrow(run, _LINKS)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS, min_run: int = MIN_RUN
) -> DataFrame:
    """``(doc_id, item_id, score, start, end)``: each document and item that align, with the best place in characters."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), whole_text().alias("text"))
    words = items.agg(F.sum(F.regexp_count("text", F.lit(r"\w+")))).first()[0] or 0
    n_blocks = max(1, math.ceil(words / block_words))
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    found = []
    for number in range(n_blocks):
        rows = [tuple(r) for r in items.where(block_of == number).collect()]  # some block_words words
        shared = spark.sparkContext.broadcast(make_block(sorted(rows, key=lambda r: (r[0] is None, r))))
        windows = materialize(_scan(docs, shared), "benchmark-windows")
        counts = windows.select(F.explode("seeds").alias("seed")).groupBy("seed").count().collect()  # seeds of a block
        rare = rare_seeds(shared.value, {r[0]: r[1] for r in counts})
        found.append(_aligned(windows, shared, rare, min_score, min_run))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    best = links.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("score", (-F.col("start")).alias("_at"), (-F.col("end")).alias("_to"))).alias("b")
    )
    return best.select(
        "doc_id", "item_id", "b.score", (-F.col("b._at")).alias("start"), (-F.col("b._to")).alias("end")
    )
