"""SimHash fingerprints of documents, and the search for all fingerprints within a Hamming radius.

The terms of a text are its shingles of five words, weighted by their occurrences. Each term's 64-bit hash votes on every
bit with its weight, for or against; the signs are the fingerprint. Votes are counted two bits to a number, in 32 sums that
are combined before the shuffle, so a document leaves a task as one short row. The angle between two weighted term vectors
is about pi * h / 64 for a Hamming distance h, and the likeness of two fingerprints is its cosine, at least 0.

The search cuts the 64 bits into ``blocks`` parts. Two fingerprints that differ in at most ``radius`` bits agree in
``blocks - radius`` whole parts; there is a table for each such choice of parts, keyed by their bits, and a pair counts in the
first table that shows it. Equal fingerprints are one row with a count; keys with many rows are salted. No row is left out.

An edited text is a text whose last third of code points is replaced by as many from the beginning of the next document.
Who is next comes from ranks over ids and hashes; then texts move once, to their key, and the replaced thirds once more.

Nulls and edge cases: a null text is empty. A text of one to four words is one term; one without words has the fingerprint
0. Documents are in descending order of ``doc_id``, null ids last, rows with equal ids by the hash of their text; equal rows
follow each other. A lone document is the next one of itself. An empty table gives an empty result. Other columns of the
input are not looked at.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplenet.llm.common import whole_text
from ripplenet.operators.ordering import ordered_running
from ripplenet.operators.skew import ROWS_PER_SALT, hot_keys, join_split
from ripplenet.storage import materialize

SHINGLE = 5
RADIUS, BLOCKS = 3, 6
SEARCH_EVERY = 50
_PAIR_OF_BITS = 0x0000000100000001
_LANES = [f"_v{i}" for i in range(32)]
_KEY = ["_null", "_id", "_h1", "_h2"]


def words_of(text: Column) -> Column:
    """The words between white space, in lower case."""
    return F.array_remove(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), "")


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, copies, fingerprint)`` of ``texts (keys, text)``: the number of rows of a key, and its text's fingerprint."""
    words = texts.select(*keys, words_of(F.col("text")).alias("_w"))
    shifted = [F.slice("_w", k + 1, F.greatest(F.size("_w") - k, F.lit(0))) for k in range(SHINGLE)]
    fields = [f"_t{k}" for k in range(SHINGLE)]
    zipped = F.arrays_zip(*[s.alias(f) for s, f in zip(shifted, fields, strict=True)])
    terms = words.select(*keys, F.posexplode_outer(zipped).alias("_at", "_term"))
    terms = terms.select(*keys, "_at", *[F.col("_term").getField(f).alias(f) for i, f in enumerate(fields)])
    first = F.col("_at").isNull() | (F.col("_at") == 0)
    terms = terms.where(first | F.col(fields[-1]).isNotNull())
    hashed = terms.select(*keys, first.alias("_first"), F.when(F.col("_at").isNotNull(), F.xxhash64(*fields)).alias("_hash"))
    votes = [
        F.sum(F.shiftrightunsigned("_hash", i).bitwiseAND(F.lit(_PAIR_OF_BITS))).alias(lane) for i, lane in enumerate(_LANES)
    ]
    counted = hashed.groupBy(*keys).agg(
        F.count("_hash").alias("_n"), F.sum(F.col("_first").cast("bigint")).alias("copies"), *votes
    )
    bits = F.lit(0).cast("bigint")
    for i, lane in enumerate(_LANES):
        low, high = F.col(lane).bitwiseAND(F.lit(2**32 - 1)), F.shiftrightunsigned(lane, 32)
        for vote, bit in ((low, i), (high, i + 32)):
            bits = bits.bitwiseOR(F.when(vote * 2 > F.col("_n"), F.lit(_signed(1 << bit)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return counted.select(*keys, "copies", bits.alias("fingerprint"))


def hex_digits(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the angle that the Hamming distance of two fingerprints stands for, from 0 to 1."""
    distance = F.bit_count(a.bitwiseXOR(b))
    return F.when(distance == 0, 1.0).when(distance >= 32, 0.0).otherwise(F.cos(distance * F.lit(3.141592653589793 / 64)))


def block_masks(radius: int, blocks: int) -> list[int]:
    """The bits of every choice of ``blocks - radius`` parts."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError(f"need 0 <= radius < blocks <= 64, got {radius} and {blocks}")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def within_radius(
    queries: DataFrame, corpus: DataFrame, radius: int = RADIUS, blocks: int | None = None, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """``(q, c, distance)``: all pairs of ``queries (q)`` and ``corpus (c)`` that differ in at most ``radius`` bits.

    Both are distinct fingerprints; a pair appears once, equal ones too.
    """
    masks = [F.lit(_signed(m)).cast("bigint") for m in block_masks(radius, blocks or 2 * max(radius, 1))]

    def tables(side: DataFrame, name: str) -> DataFrame:
        keyed = F.array(*[F.struct(F.lit(t).alias("t"), F.col(name).bitwiseAND(m).alias("bits")) for t, m in enumerate(masks)])
        return side.select(name, F.explode(keyed).alias("_k")).select(name, F.xxhash64("_k.t", "_k.bits").alias("_key"), F.col("_k.t").alias(f"_{name}"))

    wanted, held = tables(queries.select("q"), "q"), tables(corpus.select("c"), "c")
    # The keys asked for are the few; where queries themselves crowd a key, the corpus side is the one that is split.
    rows = corpus.count() * len(masks)
    salts = hot_keys(held, "_key", rows, rows_per_salt) if rows > rows_per_salt else None
    met = join_split(held, wanted, "_key", salts, "c")
    differ = F.col("q").bitwiseXOR(F.col("c"))
    earliest = F.coalesce(*[F.when(differ.bitwiseAND(m) == 0, t) for t, m in enumerate(masks)])
    close = met.where((F.bit_count(differ) <= radius) & (earliest == F.col("_q")) & (F.col("_q") == F.col("_c")))
    return close.select("q", "c", F.bit_count(differ).cast("int").alias("distance"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return docs.select(
        F.col("doc_id").isNull().alias("_null"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("_id"),
        F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2"), text.alias("text"),
    )


def prints_of(docs: DataFrame) -> DataFrame:
    """``(_null, _id, _h1, _h2, n_chars, copies, fingerprint)``: one written row for each different row of ``docs (doc_id, text)``."""
    keyed = _keyed(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))
    return materialize(fingerprints(keyed, [*_KEY, "n_chars"]), "simhash-prints")


def with_next(prints: DataFrame) -> DataFrame:
    """``prints`` with the key, the fingerprint and the needed characters of its neighbours in the order of documents.

    Adds ``next_fingerprint``, and ``to_*`` and ``need``: the document that this one is next to, and how much of it that one takes.
    """
    backwards = prints.withColumn("_down", F.bitwise_not("_id"))
    ranked = ordered_running(backwards, [], ["_null", "_down", "_h1", "_h2"], rank="_rank")
    ranked = materialize(ranked.drop("_down"), "simhash-ranks")
    n = ranked.count()
    if n == 0:
        empty = ranked.select("*", F.col("fingerprint").alias("next_fingerprint"), *[F.col(k).alias(f"to{k}") for k in _KEY])
        return empty.withColumn("need", F.col("n_chars")).drop("_rank")
    after = ranked.select((F.pmod(F.col("_rank") - 2, F.lit(n)) + 1).alias("_rank"), F.col("fingerprint").alias("next_fingerprint"))
    before = ranked.select(
        (F.col("_rank") % n + 1).alias("_rank"), *[F.col(k).alias(f"to{k}") for k in _KEY], F.floor(F.col("n_chars") / 3).alias("need")
    )
    return materialize(ranked.join(after, "_rank").join(before, "_rank").drop("_rank"), "simhash-neighbours")


def edited(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """``(key, text, own)``: the edited text of each different row; ``own`` where a row is followed by its equal.

    ``linked`` is a written table of ``with_next``.
    """
    texts = _keyed(docs)
    repeats = not linked.where("copies > 1").isEmpty()
    if repeats:
        texts = texts.groupBy(*_KEY).agg(F.first("text").alias("text"))
    third = F.floor(F.char_length("text") / 3).cast("int")
    ends = linked.select(*_KEY, *[f"to{k}" for k in _KEY], F.col("need").cast("int").alias("need"))
    # One exchange of the texts by their key serves both sides of the join below.
    heads = texts.join(ends.hint("shuffle_hash"), _KEY).select(
        *[F.col(f"to{k}").alias(k) for k in _KEY], F.expr("left(text, need)").alias("_head")
    )
    kept = F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 3) as int))")
    out = texts.join(heads, _KEY).select(*_KEY, F.concat(kept, "_head").alias("text"), F.lit(False).alias("own"))
    if not repeats:
        return out
    again = linked.where("copies > 1").select(_KEY)
    alone = texts.join(again, _KEY, "left_semi").select(*_KEY, F.concat(kept, F.left("text", third)).alias("text"), F.lit(True).alias("own"))
    return out.unionByName(alone)


def edited_prints(docs: DataFrame, search_every: int = SEARCH_EVERY, radius: int = RADIUS) -> DataFrame:
    """The contract's rows: fingerprints of all documents and of their edited texts, and the likenesses between them.

    ``n_within`` counts, for ids divisible by ``search_every``, the documents within the radius, the document itself included.
    """
    linked = with_next(prints_of(docs))
    changed = edited(docs, linked)
    keys = [*_KEY, "own", "edited_sha256"]
    changed = changed.select(*_KEY, "own", F.sha2("text", 256).alias("edited_sha256"), "text")
    changed = fingerprints(changed, keys).select(*keys, F.col("fingerprint").alias("_edited"))
    rows = linked.join(changed, _KEY)
    rows = rows.withColumn("_times", F.when(F.col("own"), F.col("copies") - 1).otherwise(F.lit(1)))
    rows = rows.withColumn("_times", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))))
    asked = ~F.col("_null") & (F.col("_id") % search_every == 0)
    rows = rows.join(neighbour_counts(linked, linked.where(asked), radius), _KEY, "left")
    following = F.when(F.col("own"), F.col("fingerprint")).otherwise(F.col("next_fingerprint"))
    return rows.select(
        F.when(~F.col("_null"), F.col("_id")).alias("doc_id"), "n_chars", "edited_sha256",
        hex_digits(F.col("fingerprint")).alias("fingerprint"), hex_digits(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("fingerprint"), following).alias("near_next"), F.when(asked, F.col("_within")).alias("n_within"),
    )


def neighbour_counts(
    prints: DataFrame, asked: DataFrame, radius: int = RADIUS, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """``(key, _within)``: the rows of ``prints (key, fingerprint, copies)`` within the radius of each row of ``asked``.

    Equal fingerprints ask once; a fingerprint that many rows ask for is salted when its count goes back to them.
    """
    held = materialize(prints.groupBy(F.col("fingerprint").alias("c")).agg(F.sum("copies").alias("_rows")), "simhash-held")
    pairs = within_radius(asked.select(F.col("fingerprint").alias("q")).distinct(), held, radius)
    found = pairs.join(held, "c").groupBy(F.col("q").alias("fingerprint")).agg(F.sum("_rows").alias("_within"))
    salts = hot_keys(asked, "fingerprint", asked.count(), rows_per_salt)
    return join_split(asked.select(*_KEY, "fingerprint"), found, "fingerprint", salts, "_h1").select(*_KEY, "_within")
