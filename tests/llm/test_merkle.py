"""The manifest against a plain tree that keeps every node, for sizes around the strides and for odd rows."""

import hashlib
import zlib

import pytest
from ripplenet.llm import merkle
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, size int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    values = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(leaves):
    """The root, and for each leaf its siblings as (on the left, digest)."""
    paths, places, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, at in enumerate(places):
            other = at ^ 1
            if other < len(level):
                paths[k].append((at & 1, level[other]))
            else:
                paths[k].append(None)
            places[k] = at >> 1
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0] if level else None, paths


def plain_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(((r[0] is not None, r[0] or 0, plain_leaf(r), r) for r in rows if r[2] == lang), key=lambda t: t[:3])
        trees[lang] = own, *plain_tree([t[2] for t in own])
    root, upper = plain_tree([trees[lang][1] for lang in langs])
    out = []
    for lang, up in zip(langs, upper, strict=True):
        own, subroot, paths = trees[lang]
        for (_, _, leaf, row), path in zip(own, paths, strict=True):
            path = path + up
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = plain_leaf(row, 1) if changed else leaf
            for step in path:
                node = h(node) if step is None else h(step[1], node) if step[0] else h(node, step[1])
            proof = h(*[s[1] for s in path if s])
            out.append((row[0], leaf, subroot, root, proof, node, node == root))
    return sorted(out, key=str)


def check(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    changed = F.when(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0,
        merkle.row_digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS]),
    )
    got = merkle.checked(merkle.manifest(docs, changed=changed, **more)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_manifest(rows)


@pytest.mark.parametrize("stride", [1, 3])
def test_sizes_around_the_stride(spark, stride):
    rows = []
    for lang, n in (("en", 37), ("de", 8), ("es", 9), ("fr", 1), ("it", 2), (None, 5), ("", 3)):
        rows += [(len(rows) + k, "s", lang, k, f"text {lang} {k}") for k in range(n)]
    check(spark, rows, stride=stride)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (None, "a", "en", 1, "x"), (None, "a", "en", 1, "x"), (3, "", "en", 0, ""),
        (3, "", "en", 0, ""), (3, "b", "en", 7, "same id"), (-9, "ü", "ä", 2, "word " * 60_000), (2**62, "s", "en", None, " "),
    ]
    check(spark, rows)


def test_one_row_and_none(spark):
    check(spark, [(1, "s", "en", 1, "x")])
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.tampering(docs).count() == 0


def test_every_proof_leads_to_the_root_and_no_tampered_one_does(spark, documents):
    rows = merkle.tampering(documents).collect()
    assert len(rows) == documents.count() and len({r["root"] for r in rows}) == 1
    for r in rows:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0)
