"""Toxic spans and document scores from a linear-chain conditional random field.

Labels exist for documents only. Token labels come from them by evidence: a word of a toxic document is a toxic token if
the word, or one of its beginnings or endings, is found in toxic documents so much more often than in others that chance
does not explain it; copies of a text count once. A two-state chain is then fitted to these tokens by gradient descent on
its likelihood, with hashed word and affix features. A chain is a line, or ``CHAIN`` words of a longer one: no transition is
learnt or passed on between such pieces, nor between lines. Scoring takes whole texts: forward-backward marginals give
each token's chance of being toxic, and these combine to the document's score and to the offending character ranges.

The fit takes a bounded sample of labelled rows (``MAX_ROWS`` and ``MAX_CHARS`` for each label, in hash order of the
ids) and is trained on every chain of them, a batch at a time; all documents are scored in parallel with the broadcast model of some 2 MB.

Nulls and edge cases: null and empty texts have no tokens and get the lowest score. Labels without a text, with a null
label or id are not used; if rows repeat an id, any toxic one makes it toxic. Without labels of both kinds every score is 0. Rows
that repeat an id are scored one by one. An empty table gives an empty result. Only ``doc_id`` and the text are read.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplenet.llm.common import whole_text
from ripplenet.storage import small_table

MAX_ROWS = {1: 2000, 0: 4000}
MAX_CHARS = {1: 7_000_000, 0: 14_000_000}
# Tokens in a chain; a longer line is cut. Longest and shortest affixes that are features.
CHAIN = 64
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7), (3, 4)
SLOTS = 1 << 18
EVIDENCE, PRECISION = 10.0, 0.95
# Texts of one label that agree in this many smallest five-word hashes, of either of two sets, are copies.
COPY_HASHES = 3
# Texts, copies counted once, whose words are looked at together.
COPY_GROUPS = 250
# Padded tokens of one step of the fit.
BATCH_TOKENS = 100_000
STEPS, RATE, PENALTY = 60, 0.3, 1e-4
STEP_CHARS, MAX_WORDS = 2_000_000, 300_000
_WORD = re.compile(r"\w+")


def features(word: str) -> list[int]:
    """Slots of a lower-case word: itself and its affixes."""
    names = [f"w{word}"]
    names += [f"p{word[:n]}" for n in PREFIXES if len(word) > n]
    names += [f"s{word[-n:]}" for n in SUFFIXES if len(word) > n]
    return [xxhash.xxh32_intdigest(x) % SLOTS for x in names]


def chains(text: str) -> list[list[str]]:
    """The words of each line, in pieces of at most ``CHAIN``."""
    out = []
    for line in text.lower().split("\n"):
        words = _WORD.findall(line)
        out += [words[i : i + CHAIN] for i in range(0, len(words), CHAIN)]
    return out


def _lift(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log-odds that reach the next token from log-odds ``x``, under the transition scores ``t[from, to]``."""
    return np.logaddexp(x + t[1, 1], t[0, 1]) - np.logaddexp(x + t[1, 0], t[0, 0])


def messages(scores: np.ndarray, mask: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds of each token; ``scores`` and ``mask`` are (chain, place)."""
    forward, backward = scores.copy(), np.zeros_like(scores)
    for k in range(1, scores.shape[1]):
        forward[:, k] += _lift(forward[:, k - 1], t)
    for k in range(scores.shape[1] - 2, -1, -1):
        behind = _lift(scores[:, k + 1] + backward[:, k + 1], t.T)
        backward[:, k] = np.where(mask[:, k + 1], behind, 0.0)
    return forward, backward


def _odds(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    transitions: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def word_score(self, word: str) -> float:
        return self.bias + float(self.weights[features(word)].sum())


class WordScores(dict):
    """Word -> its score, filled as words are met; starts anew when full."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = value = self.model.word_score(word)
        return value


def _padded(lengths: np.ndarray) -> np.ndarray:
    return np.arange(int(lengths.max()))[None, :] < lengths[:, None]


def _marginals(model: Model, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Chance of each token being toxic, for chains laid end to end."""
    out = np.zeros(len(scores))
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    for some in np.array_split(order, max(1, math.ceil(len(order) / 4096))):  # chains of similar length together
        if not len(some):
            continue
        mask = _padded(lengths[some])
        place = np.minimum(starts[some][:, None] + np.arange(mask.shape[1])[None, :], len(scores) - 1)
        forward, backward = messages(np.where(mask, scores[place], 0.0), mask, model.transitions)
        out[place[mask]] = _odds(forward + backward)[mask]
    return out


def document_odds(text_of: np.ndarray, chances: np.ndarray, n_texts: int) -> np.ndarray:
    """Log-odds that a text holds a toxic token. Chances are squared, so many tiny ones in a long text stay tiny."""
    clean = np.bincount(text_of, np.log1p(-np.minimum(chances, 1 - 1e-9) ** 2), n_texts)
    return np.log(np.maximum(-np.expm1(clean), 1e-12)) - clean


def score_texts(model: Model, known: WordScores, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Log-odds of each text before calibration, and its offending character ranges."""
    parts = [chains(t) for t in texts]
    lengths = np.array([len(c) for p in parts for c in p], np.int64)
    if not len(lengths):
        return document_odds(np.zeros(0, np.int64), np.zeros(0), len(texts)), [[] for _ in texts]
    scores = np.fromiter((known[w] for p in parts for c in p for w in c), float, int(lengths.sum()))
    chances = _marginals(model, scores, lengths)
    sizes = np.array([sum(map(len, p)) for p in parts])
    text_of = np.repeat(np.arange(len(texts)), sizes)
    ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
    ends = np.cumsum(sizes)
    for i in np.unique(text_of[chances >= 0.5]).tolist():
        marked = np.flatnonzero(chances[ends[i] - sizes[i] : ends[i]] >= 0.5).tolist()
        places = [m.span() for m in _WORD.finditer(texts[i])]
        if len(places) != sizes[i]:  # lower case changed the words
            places = [m.span() for m in _WORD.finditer(texts[i].lower())]
        for k in marked:
            if ranges[i] and k and places[k - 1][1] == ranges[i][-1][1]:
                ranges[i][-1] = (ranges[i][-1][0], places[k][1])
            else:
                ranges[i].append(places[k])
    return document_odds(text_of, chances, len(texts)), ranges


def _evidence(hits: np.ndarray, misses: np.ndarray, share: float) -> np.ndarray:
    """Log-likelihood ratio of hits among toxic texts against their share, where precision is high enough; else 0."""
    n = hits + misses
    precision = hits / np.maximum(n, 1)
    safe = np.clip(precision, 1e-9, 1 - 1e-9)
    gain = hits * np.log(safe / share) + misses * np.log((1 - safe) / (1 - share))
    even = precision / share / np.maximum(precision / share + (1 - precision) / (1 - share), 1e-12)
    return np.where(even >= PRECISION, gain, 0.0)


@dataclass
class Text:
    """A labelled text: its word numbers, laid end to end, and the length of each chain."""

    words: np.ndarray
    lengths: np.ndarray
    label: int


class Sample:
    """Labelled texts as numbers, with each word's feature slots (padded with -1) and the copies among the texts."""

    def __init__(self, rows: list[tuple[str, int]]):
        numbers: dict[str, int] = {}
        slots, width = array("i"), 1 + len(PREFIXES) + len(SUFFIXES)
        self.texts: list[Text] = []
        self.group_of: list[int] = []
        seen: dict[tuple, int] = {}
        for text, label in dict.fromkeys(rows):
            parts = chains(text)
            words = [w for c in parts for w in c]
            if not words:
                continue
            for w in words:
                if w not in numbers:
                    numbers[w] = len(numbers)
                    own_slots = features(w)
                    slots.extend(own_slots + [-1] * (width - len(own_slots)))
            own = np.fromiter((numbers[w] for w in words), np.int32, len(words))
            self.texts.append(Text(own, np.array([len(c) for c in parts]), label))
            self.group_of.append(len(self.group_of))
            for half in _copy_keys(words):
                self.group_of[self._root(-1)] = self._root(seen.setdefault((label, half), len(self.texts) - 1))
        self.table = np.frombuffer(slots, np.int32).reshape(-1, width) if slots else np.zeros((0, width), np.int32)

    def _root(self, i: int) -> int:
        i %= len(self.group_of)
        while self.group_of[i] != i:
            self.group_of[i] = i = self.group_of[self.group_of[i]]
        return i

    def toxic_words(self) -> np.ndarray:
        """Whether each word counts as toxic in a toxic text; copies of a text count once for a label."""
        roots, group = np.unique([self._root(i) for i in range(len(self.texts))], return_inverse=True)
        toxic = np.array([self.texts[i].label for i in roots])
        order = np.argsort(group, kind="stable")
        ends = np.append(np.arange(0, len(roots), COPY_GROUPS), len(roots))
        hits, misses = np.zeros(SLOTS), np.zeros(SLOTS)
        for some in np.split(order, np.searchsorted(group[order], ends[1:-1])):  # all copies of a text are in one part
            own = [np.unique(self.texts[i].words) for i in some]
            text_of, word = np.repeat(group[some], [len(x) for x in own]), np.concatenate(own)
            for k in range(self.table.shape[1]):
                slot = self.table[word, k]
                has = slot >= 0
                key = np.unique(text_of[has] * SLOTS + slot[has])
                label = toxic[key // SLOTS]
                hits += np.bincount(key[label == 1] % SLOTS, minlength=SLOTS)
                misses += np.bincount(key[label == 0] % SLOTS, minlength=SLOTS)
        share = float(np.clip(toxic.mean(), 1e-3, 1 - 1e-3))
        strong = np.append(_evidence(hits, misses, share) >= EVIDENCE, False)
        return strong[self.table].any(axis=1)


def _copy_keys(words: list[str]) -> tuple[tuple, tuple]:
    runs = (" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4)))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64)
    least = [int((hashes * np.uint64(2 * k + 1) ^ (hashes >> np.uint64(31 + k))).min()) for k in range(2 * COPY_HASHES)]
    return tuple(least[:COPY_HASHES]), tuple(least[COPY_HASHES:])


def fit(rows: list[tuple[str, int]], share: float) -> Model | None:
    """The model of the labelled texts ``(text, label)``; ``share`` is the share of toxic ones among all labels."""
    return fitted(Sample(rows), share)


def fitted(sample: Sample, share: float) -> Model | None:
    """``fit`` without the texts, which the sample does not keep."""
    if len({t.label for t in sample.texts}) < 2:
        return None
    bad = sample.toxic_words()
    word = np.concatenate([t.words for t in sample.texts])
    toxic = np.repeat([t.label == 1 for t in sample.texts], [len(t.words) for t in sample.texts])
    model = _train(word, bad[word] & toxic, np.concatenate([t.lengths for t in sample.texts]), sample.table)
    by_word = model.bias + np.append(model.weights, 0.0)[sample.table].sum(1)
    odds = []
    for i in range(0, len(sample.texts), 200):
        part = sample.texts[i : i + 200]
        chances = _marginals(model, by_word[np.concatenate([t.words for t in part])], np.concatenate([t.lengths for t in part]))
        odds.append(document_odds(np.repeat(np.arange(len(part)), [len(t.words) for t in part]), chances, len(part)))
    model.slope, model.shift = _calibrate(np.concatenate(odds), np.array([t.label for t in sample.texts]), share)
    return model


def _batches(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Chains of similar length together, in batches of at most ``BATCH_TOKENS`` places."""
    order = np.argsort(lengths, kind="stable")
    while len(order):
        sized = lengths[order] * np.arange(1, len(order) + 1)
        n = max(1, int(np.searchsorted(sized, BATCH_TOKENS, "right")))
        yield order[:n]
        order = order[n:]


def _train(words: np.ndarray, marks: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> Model:
    """Likelihood ascent (Adam) over all chains, laid end to end; each step adds up the slopes of all batches."""
    starts = np.cumsum(lengths) - lengths
    batches = list(_batches(lengths))
    slots = np.where(table < 0, SLOTS, table)
    theta = np.zeros(SLOTS + 1 + 1 + 4)  # slots, a slot for padding, bias, transitions
    theta[SLOTS + 1] = -2.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        t = theta[SLOTS + 2 :].reshape(2, 2)
        by_word = np.full(len(slots), theta[SLOTS + 1])
        for k in range(slots.shape[1]):
            by_word += theta[slots[:, k]]
        slope = PENALTY * len(lengths) * theta
        per_word = np.zeros(len(slots))
        for some in batches:
            mask = _padded(lengths[some])
            place = np.minimum(starts[some][:, None] + np.arange(mask.shape[1])[None, :], len(words) - 1)
            word, label = words[place], np.where(mask, marks[place], False).astype(np.float32)
            scores = np.where(mask, by_word[word], 0.0)
            forward, backward = messages(scores, mask, t)
            wrong = np.where(mask, _odds(forward + backward) - label, 0.0)
            per_word += np.bincount(word[mask], wrong[mask], len(slots))
            a, b = forward[:, :-1], scores[:, 1:] + backward[:, 1:]
            joint = np.stack([np.full(a.shape, t[0, 0]), b + t[0, 1], a + t[1, 0], a + b + t[1, 1]])
            joint = np.exp(joint - joint.max(0))
            joint /= joint.sum(0)
            x, y = label[:, :-1], label[:, 1:]
            seen = np.stack([(1 - x) * (1 - y), (1 - x) * y, x * (1 - y), x * y])
            slope[SLOTS + 2 :] += ((joint - seen) * mask[:, 1:]).sum((1, 2))
        for k in range(slots.shape[1]):
            slope[: SLOTS + 1] += np.bincount(slots[:, k], per_word, SLOTS + 1)
        slope[SLOTS + 1] += per_word.sum()
        slope[SLOTS] = 0.0
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    theta[SLOTS] = 0.0
    return Model(theta[:SLOTS].astype(np.float32), float(theta[SLOTS + 1]), theta[SLOTS + 2 :].reshape(2, 2))


def _calibrate(odds: np.ndarray, toxic: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of a logistic fit with smoothed targets, moved from the sample's share to that of all labels."""
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
    target = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design = np.stack([np.clip(odds, -30, 30), np.ones(len(odds))], axis=1)
    beta = np.array([0.5, 0.0])
    for _ in range(50):
        p = _odds(design @ beta)
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(hessian, design.T @ (p - target) + 1e-3 * beta), -1, 1)
    prior = math.log(max(n1, 1) / max(n0, 1)) - math.log(share / (1 - share))
    return float(max(beta[0], 0.05)), float(beta[1] - prior)


def held_out(column: str = "doc_id"):
    """Rows that the fit never sees: crc32 of the id's text leaves no remainder by 5."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, int]], float]:
    """The bounded sample ``(text, label)`` and the share of toxic ones among all labels that may be learnt from."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = docs.where(F.length("text") > 0).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.sum(F.length("text")).alias("n")
    )
    sized = known.join(sizes, "doc_id")
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    ids = []
    for label, limit in MAX_ROWS.items():
        rows = sized.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
        room = MAX_CHARS[label]
        for r in rows:
            if r["n"] <= room:
                room -= r["n"]
                ids.append((r["doc_id"], label))
    if not ids:
        return [], 0.5
    wanted = small_table(docs.sparkSession, ["_id", "_label"], ids)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_id"), "text").join(F.broadcast(wanted), "_id")
    rows = sorted((r["_id"], r["text"], int(r["_label"])) for r in texts.where("text is not null").collect())
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    return [(t, y) for _, t, y in rows], min(max(n1 / max(n1 + n0, 1), 1e-3), 1 - 1e-3)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    rows, share = training_rows(docs, labels)
    sample = Sample(rows)
    del rows
    return fitted(sample, share)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``_score`` and ``_spans`` (code points, end exclusive) beside its columns."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        known = WordScores(fitted) if fitted else None
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            scores, spans, start, size = [], [], 0, 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= STEP_CHARS or i + 1 == len(texts):
                    part = texts[start : i + 1]
                    if fitted:
                        odds, ranges = score_texts(fitted, known, part)
                        scores += _odds(fitted.slope * np.clip(odds, -30, 30) + fitted.shift).tolist()
                        spans += [[{"start": a, "end": b} for a, b in r] for r in ranges]
                    else:
                        scores += [0.0] * len(part)
                        spans += [[]] * len(part)
                    start, size = i + 1, 0
            arrays = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(scores, pa.float64()), pa.array(spans, kind)], [*columns, "_score", "_spans"]
            )

    added = T.StructType.fromDDL("_score double, _spans array<struct<start:int,end:int>>")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted, spans)`` for each row of ``docs``."""
    texts = docs.select("doc_id", whole_text().alias("text"))
    out = scored(texts, train(docs, labels))
    return out.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"), F.col("_spans").alias("spans"),
    )
