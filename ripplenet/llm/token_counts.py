"""Exact token counts of every prefix of a text, by dynamic programming over byte-pair encodings.

A byte-pair encoding of a prefix ends in exactly one token, and the tokens before it are the encoding of the shorter
prefix. So the count of a prefix is one more than that of the prefix without its last token, and that token is the only
suffix in the vocabulary which encodes as a token of its own behind the previous one. Filling this table from left to
right gives the count of all prefixes of a piece at the cost of one pass; texts are cut into pieces by the tokenizer's
own pattern, and equal pieces share a table. Truncation and budget questions are look-ups in the stored counts.

The vocabulary file is opened by every Python worker at the given path, as tokenizer libraries are, and is not part of
this repository.

Nulls and edge cases: a null text counts as empty, with no tokens. The string of the special token counts as that one
token, as the library has it. Rows are handled one by one; a null ``doc_id`` and repeated rows pass through. An empty
table gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplenet.llm.common import positions, whole_text

LIMIT = 512
# Pieces whose counts a worker keeps, and pairs of tokens whose verdict it keeps: the first ones met, so mostly frequent.
MAX_PIECES, MAX_JOINTS = 1_000_000, 1_000_000
# Pieces whose whole table a worker keeps.
MAX_TABLES = 200_000
# The tokenizer's white space, its contractions and the pattern of its pieces.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_PIECE = (
    "|".join(_CONTRACTIONS)
    + rf"| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter(dict):
    """Piece of text -> number of its tokens, filled as pieces are asked for."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            loaded = json.load(file)
        letters = _byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.specials = [t["content"] for t in loaded["added_tokens"] if t["special"]]
        self.vocabulary = {as_bytes(t) for t in loaded["model"]["vocab"] if t not in set(self.specials)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in loaded["model"]["merges"])
        self.merges = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        # The merge that makes each token: its rank and its two parts.
        self.made = {a + b: (rank, a, b) for (a, b), rank in self.merges.items()}
        self.longest = max(map(len, self.vocabulary))
        self.joints: dict[tuple[bytes, bytes], bool] = {}
        self.tables: dict[str, tuple[int, ...]] = {}
        self.is_space = regex.compile(f"[{_SPACE}]").match
        self.find_pieces = regex.compile(_PIECE).findall
        self.next_pieces = regex.compile(_PIECE).finditer
        self.cut_specials = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")").split

    def _stays(self, before: bytes, token: bytes) -> bool:
        """Whether ``token`` directly behind the token ``before`` stays as it is when both are encoded together.

        The merges that made the two are undone from the last one back. A merge across the joint would have come first,
        and spoiled them, if it ranks before the merge undone; among equal ranks the left one comes first.
        """
        if not before:
            rank, left, right = self.made.get(token, (0, b"", token))
            return not left or (self._stays(b"", left) and self._stays(b"", right) and self._stays_below(left, right, rank))
        return self._stays_below(before, token, 1 << 60)

    def _stays_below(self, x: bytes, y: bytes, limit: int) -> bool:
        none = (-1, b"", b"")
        while True:
            if self.merges.get((x, y), limit) < limit:
                return False
            a, b = self.made.get(x, none), self.made.get(y, none)
            if a[0] < 0 and b[0] < 0:
                return True
            if a[0] > b[0]:
                limit, x = min(limit, a[0]), a[2]
            else:
                limit, y = min(limit, b[0] + 1), b[1]

    def _joins(self, key: tuple[bytes, bytes]) -> bool:
        known = self._stays(*key)
        if len(self.joints) < MAX_JOINTS:
            self.joints[key] = known
        return known

    def table(self, piece: bytes) -> list[int]:
        """Token count of each prefix of the piece, in bytes."""
        counts, last = [0], [b""]
        vocabulary, known, joins, longest = self.vocabulary, self.joints.get, self._joins, self.longest
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = piece[start:end]
                if token in vocabulary:
                    key = (last[start], token)
                    fits = known(key)
                    if joins(key) if fits is None else fits:
                        counts.append(counts[start] + 1)
                        last.append(token)
                        break
        return counts

    def __missing__(self, piece: str) -> int:
        count = self.table(piece.encode())[-1]
        if len(self) < MAX_PIECES and len(piece) <= 64:
            self[piece] = count
        return count

    def count(self, text: str) -> int:
        total, ask = 0, self.__getitem__
        for i, part in enumerate(self.cut_specials(text)):
            total += 1 if i % 2 else sum(map(ask, self.find_pieces(part)))
        return total

    def _piece_counts(self, piece: str) -> tuple[int, ...]:
        """Token count of each non-empty prefix of the piece, in characters."""
        known = self.tables.get(piece)
        if known is not None:
            return known
        counts, at, out = self.table(piece.encode()), 0, []
        for c in piece:
            at += len(c.encode())
            out.append(counts[at])
        if len(self.tables) < MAX_TABLES and len(piece) <= 64:
            self.tables[piece] = tuple(out)
        return tuple(out)

    def prefixes(self, text: str, budget: int | None = None) -> list[int]:
        """Token count of ``text[:k]`` for k from 0 to its length.

        White space at the end of a prefix is one piece whatever follows in the text, and a contraction cut short is no
        contraction; a special string cut short is plain text behind the last whole one. With a ``budget`` the list ends
        where no longer prefix can keep to it: whole pieces only add to the count.
        """
        out = [0]
        behind = 0  # where the text after the last special string begins
        for i, part in enumerate(self.cut_specials(text)):
            if budget is not None and out[-1] > budget and not self.is_space(text[len(out) - 2]):
                break
            if i % 2:
                tail, sure = text[behind : len(out) - 1], out[behind]
                out += [sure + self.count(tail + part[:k]) for k in range(1, len(part) + 1)]
                behind = len(out) - 1
                continue
            done = out[-1]
            space, at_space = "", done
            for m in self.next_pieces(part):
                piece = m.group()
                counts = [done + n for n in self._piece_counts(piece)]
                if piece in _CONTRACTIONS and len(piece) == 3:
                    counts[1] = done + self["'"] + self[piece[1]]
                for k, c in enumerate(piece):
                    if self.is_space(c):
                        if not space:
                            at_space = out[-1]
                        space += c
                        counts[k] = at_space + self[space]
                    else:
                        space = ""
                    out.append(counts[k])
                done += self[piece]
                if budget is not None and done > budget and not space:
                    return out
        return out

    def _pieces(self, text: str) -> Iterator[tuple[str, int]]:
        for i, part in enumerate(self.cut_specials(text)):
            if i % 2:
                yield part, 1
            else:
                for m in self.next_pieces(part):
                    piece = m.group()
                    yield piece, self[piece]

    def kept(self, text: str, budget: int) -> int:
        """Length of the longest prefix of ``text`` with at most ``budget`` tokens.

        Whole pieces are added up as long as they keep to it; the table of prefixes is filled from the last piece on behind
        which no white space could join what follows.
        """
        at = done = sure = fixed = 0
        for piece, n in self._pieces(text):
            if done + n > budget:
                counts = self.prefixes(text[fixed:], budget - sure)
                return fixed + next(k for k in range(len(counts) - 1, -1, -1) if counts[k] <= budget - sure)
            at, done = at + len(piece), done + n
            if not self.is_space(piece[-1]):
                fixed, sure = at, done
        return len(text)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.octet_length(whole_text()).cast("bigint").alias("n_bytes"), whole_text().alias("text"))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of each text, whole and without begin, end or padding tokens."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = counter(path)
        for batch in batches:
            counts = pa.array([ask.count(t.as_py()) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), counts], ["doc_id", "n_bytes", "n_tokens"]
            )

    rows = _rows(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def count_and_cut(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``count_tokens`` with ``n_chars_kept``: the characters of the longest prefix of at most ``limit`` tokens.

    It is looked up in the table of prefixes, which is filled as far as a prefix can keep to the limit. A text of no more
    tokens is kept whole.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = counter(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [ask.count(t) for t in texts]
            kept = [len(t) if n <= limit else ask.kept(t, limit) for t, n in zip(texts, counts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64()), pa.array(kept, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "n_chars_kept"],
            )

    rows = _rows(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, n_chars_kept bigint")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chars_kept")


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, counts)``: element k of ``counts`` is the token count of the first k characters of the text."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = counter(path)
        for batch in batches:
            counts = pa.array([ask.prefixes(t.as_py()) for t in batch.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts], ["doc_id", "counts"])

    rows = _rows(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(stored, f"doc_id {kind}, counts array<int>")


def longest_prefix(counts: Column, budget: Column) -> Column:
    """Length of the longest prefix with at most ``budget`` tokens, from the stored counts of its text."""
    return F.array_max(F.filter(positions(F.size(counts)), lambda k: F.get(counts, k) <= budget))
