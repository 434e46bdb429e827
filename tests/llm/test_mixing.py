"""Budgets against plain water filling, and drawn prefixes against plain running sums."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from ripplenet.llm import mixing
from ripplenet.llm.queries import MIX_SHARE, MIX_WEIGHTS

DOMAINS = {**dict.fromkeys("012", "web"), **dict.fromkeys("345", "books"), **dict.fromkeys("67", "code"), **dict.fromkeys("89", "talk")}


def fill(budget, members):
    """Shares of ``{name: (weight, supply)}``: rounds in which members that fall short leave with all they have."""
    given, left = {}, dict(members)
    while left:
        level = budget / sum(w for w, _ in left.values())
        short = [m for m, (w, s) in left.items() if s < w * level]
        if not short:
            return given | {m: w * level for m, (w, _) in left.items()}
        for m in short:
            given[m] = left.pop(m)[1]
            budget -= given[m]
    return given


def plain_mix(rows, share, weights, epochs):
    docs, leaf = [], Counter()
    for i, text, lang, source in rows:
        who = f"null:{hashlib.md5((text or '').encode()).hexdigest()}" if i is None else str(i)
        last = re.search("[0-9]$", source or "")
        domain = "other" if source is None else DOMAINS[last.group()] if last else "talk"
        name = (domain, "(none)" if lang is None else lang, "(none)" if source is None else source)
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        docs.append(((i, who), name, n))
        leaf[name] += n
    leaf = {k: n for k, n in leaf.items() if n}
    weight = lambda kind, name: weights.get(kind, {}).get(name, 1.0)
    supply = lambda prefix: epochs * sum(n for k, n in leaf.items() if k[: len(prefix)] == prefix)
    budgets = {(): share * sum(leaf.values())}
    for depth, kind in enumerate(("domain", "lang", "source")):
        following = {}
        for prefix, budget in budgets.items():
            children = {k[: depth + 1] for k in leaf if k[:depth] == prefix}
            following |= fill(budget, {c: (weight(kind, c[-1]), supply(c)) for c in children})
        budgets = following
    out, members = [], defaultdict(list)
    for i, name, n in docs:
        members[name].append((i, n))
    for name, own in members.items():
        if name not in leaf:
            continue
        full, rest = divmod(int(budgets[name] + 1e-6), leaf[name])
        place = lambda i: hashlib.md5(f"{mixing.SEED}:{full}:{i[1]}".encode()).hexdigest()  # noqa: E731, B023
        sums, total = {}, 0
        for at in sorted({place(i) for i, _ in own}):
            total += sum(n for i, n in own if place(i) == at)
            sums[at] = total
        for i, n in own:
            times = full + (rest > 0 and sums[place(i)] <= rest)
            if times:
                out.append((i[0], n, times))
    return Counter(out)


def drawn(docs, *args, **more):
    return Counter(tuple(r) for r in mixing.mix(docs, *args, **more).select("doc_id", "n_tokens", "n_epochs").collect())


def table(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]


def test_documents(documents):
    want = plain_mix(table(documents), MIX_SHARE, MIX_WEIGHTS, mixing.EPOCHS)
    assert want and drawn(documents, MIX_SHARE, MIX_WEIGHTS) == want
    assert drawn(documents, MIX_SHARE, MIX_WEIGHTS, range_rows=2) == want


def test_shortages_go_to_siblings_before_ancestors(spark):
    draw, rows = random.Random(1), []
    for source, lang, count in (("src1", "en", 2), ("src1", "de", 80), ("src2", "en", 40), ("src3", "en", 40), ("src6", "fr", 1)):
        rows += [(len(rows) + k, "w " * draw.randint(1, 30), lang, source) for k in range(count)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    for share in (0.0, 0.3, 1.0, 2.5, 10.0):
        assert drawn(docs, share, {"lang": {"en": 5.0}}, epochs=2, range_rows=7) == plain_mix(rows, share, {"lang": {"en": 5.0}}, 2)


def test_odd_and_empty_tables(odd_documents, no_documents):
    docs = odd_documents.withColumn("n_tokens", F.lit("x"))
    assert drawn(docs, 0.9, {}) == plain_mix(table(docs), 0.9, {}, mixing.EPOCHS)
    assert mixing.mix(no_documents, 0.5, {}).collect() == []


def test_documents_without_an_id_are_drawn_one_by_one(spark):
    rows = [(None, f"w{k} " * (1 + k % 7), "en", "src1") for k in range(400)] + [(None, "same text here", "en", "src1")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = mixing.mix(docs, 0.5, {}, epochs=1).collect()
    assert drawn(docs, 0.5, {}, epochs=1) == plain_mix(rows, 0.5, {}, 1)
    assert 150 < len(got) < 250 and [r["text"] for r in got].count("same text here") in (0, 3)


def test_columns_of_any_name_pass_through(documents):
    names = ["rest", "full", "ranges", "_end", "_cut", "_domain", "_lang", "_source", "_who", "n_epochs", "with.dot", "tick`"]
    docs = documents.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    rows = mixing.mix(docs, MIX_SHARE, MIX_WEIGHTS).collect()
    assert len(rows) == sum(drawn(documents, MIX_SHARE, MIX_WEIGHTS).values())
    assert all(r[n] == k for r in rows for k, n in enumerate(names) if n != "n_epochs")
