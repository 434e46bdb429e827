"""The trie against one that is built turn by turn from nested dictionaries."""

import hashlib
import random
import re
import zlib

import pytest
from ripplenet.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_trie(rows):
    convs = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(conv_id, []).append((turn is not None, turn or 0, digest, role, text))
    convs = {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}
    whole = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = convs.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    members, ends = {}, {}
    for c, turns in sorted(whole.items()):
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    below = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        kids = [below[k] for k in children.get(node, [])]
        below[node] = (sum(k[0] for k in kids) or 1, own + sum(k[1] for k in kids))
    return sorted(
        (
            (
                m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(children.get(node, [])), *below[node],
                hashlib.sha256(",".join(map(str, ends.get(node, []))).encode()).hexdigest(),
            )
            for node, m in members.items()
        ),
        key=lambda r: (r[1], r[0]),
    )


def check(spark, rows, **more):
    data = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = prefix_trie.rebuilt_trie(data, **more).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: (r[1], r[0])) == plain_trie(rows)


@pytest.mark.parametrize("block, rows_per_salt", [(1, 1_000_000), (4, 1_000_000), (3, 5)])
def test_random_conversations(spark, block, rows_per_salt):
    draw = random.Random(block)
    rows = []
    for c in list(range(45)) + [60, 61, 79, 105, -3, -20, 2**61]:
        stem, n = draw.choice([[], ["a b"], ["a b", "c"], ["a b", "c", "d d d", "e", "f"]]), draw.choice([1, 2, 3, 5, 9, 14])
        texts = (stem + [draw.choice(["x", "y y", "z z z"]) for _ in range(n)])[:n]
        rows += [(c, k * 2, draw.choice(["user", "user", "bot"]), text) for k, text in enumerate(texts)]
    draw.shuffle(rows)
    check(spark, rows, block=block, rows_per_salt=rows_per_salt)


def test_odd_rows(spark):
    long = "word " * 50_000
    rows = [
        (None, 1, "user", "left out"), (1, None, None, None), (1, None, None, None), (1, 0, "user", ""), (2, 0, "", None),
        (2, 0, "", ""), (3, 0, "us", "er a"), (3, 0, "user", " a"), (23, 5, "user", long), (23, 5, "user", long),
        (43, 5, "user", long), (0, 1, "user", "a\x1fb c\x0bd"), (0, 0, None, "first"), (19, 1, "bot", "tail"),
    ]
    check(spark, rows)


def test_many_equal_conversations_and_turnless_ones(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(200) for t in range(5)]
    check(spark, rows, rows_per_salt=50)
    check(spark, [(c, 0, "user", "one") for c in (21, 22, 23, 24, 25)])
    check(spark, [(None, 0, "user", "one")])


def test_no_rows(spark):
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).count() == 0
