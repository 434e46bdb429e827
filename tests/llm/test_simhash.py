"""Fingerprints, edited texts and the radius search against plain versions."""

import hashlib
import math
import random
import re

import pytest
import xxhash
from ripplenet.llm import simhash

SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def term_hash(words, seed=42):
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed


def plain_print(text):
    words = [w for w in SPLIT.split((text or "").lower()) if w]
    terms = [words[i : i + 5] for i in range(max(len(words) - 4, 1))] if words else []
    votes = [0] * 64
    for term in terms:
        value = term_hash(term)
        for b in range(64):
            votes[b] += 1 if value >> b & 1 else -1
    return sum(1 << b for b in range(64) if votes[b] > 0)


def plain_likeness(a, b):
    h = (a ^ b).bit_count()
    return 1.0 if h == 0 else 0.0 if h >= 32 else math.cos(math.pi * h / 64)


def plain_rows(rows, every=50, radius=3):
    def hashes(text):
        signed = lambda x: x - 2**64 if x >= 2**63 else x
        one = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)
        data = text.encode()
        return signed(xxhash.xxh64_intdigest(data, 42)), signed(xxhash.xxh64_intdigest(data, one))

    docs = sorted(((i is None, -(i or 0), *hashes(t or ""), i, t or "") for i, t in rows), key=lambda r: r[:4])
    docs = [d[4:] for d in docs]
    out = []
    for k, (i, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        m = len(text) // 3
        edited = text[: len(text) - m] + following[:m]
        own, changed, after = plain_print(text), plain_print(edited), plain_print(following)
        near = sum((own ^ plain_print(t)).bit_count() <= radius for _, t in docs)
        out.append((
            i, len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{own:016x}", f"{changed:016x}",
            round(plain_likeness(own, changed), 9), round(plain_likeness(own, after), 9),
            near if i is not None and i % every == 0 else None,
        ))
    return sorted(out, key=str)


def check(docs, **more):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = simhash.edited_prints(docs, **more).collect()
    got = sorted(((*r[:5], round(r[5], 9), round(r[6], 9), r[7]) for r in got), key=str)
    assert got == plain_rows(rows, every=more.get("search_every", 50))


def test_whole_table(documents):
    check(documents)
    found = simhash.edited_prints(documents).collect()
    assert sum(r["near_edited"] for r in found) > 0.5 * len(found) > 4 * sum(r["near_next"] for r in found)


def test_odd_rows(odd_documents, no_documents):
    check(odd_documents, search_every=1)
    assert simhash.edited_prints(no_documents).count() == 0


def test_rows_around_repeats(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(33))
    rows = [(7, a)] * 3 + [(7, b), (6, b), (6, b), (None, a), (None, a), (None, None), (-4, a + " x"), (2**63 - 1, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    check(docs, search_every=1)
    check(docs.limit(1), search_every=1)
    check(docs.where("doc_id = 7 and text like 'a%'"), search_every=1)


@pytest.mark.parametrize("radius, blocks, rows_per_salt", [(0, None, 10**6), (1, 2, 10**6), (3, None, 10**6), (3, 4, 50), (5, 8, 10**6)])
def test_search(spark, radius, blocks, rows_per_salt):
    draw = random.Random(radius)
    stems = [draw.getrandbits(64) for _ in range(12)]
    prints = {s ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 8))) for s in stems for _ in range(25)}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    corpus = spark.createDataFrame([(signed(p),) for p in prints], "c bigint")
    queries = spark.createDataFrame([(signed(s),) for s in stems], "q bigint")
    got = simhash.within_radius(queries, corpus, radius, blocks, rows_per_salt).collect()
    want = {(signed(s), signed(p), (s ^ p).bit_count()) for s in stems for p in prints if (s ^ p).bit_count() <= radius}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
