"""Seeds, windows and alignment against a plain dynamic programme."""

import random

from ripplenet.llm import decontamination


def plain_align(item, words):
    best, rows = 0, [[0] * (len(words) + 1)]
    for a in item:
        row = [0]
        for j, b in enumerate(words):
            row.append(max(0, rows[-1][j] + (2 if a == b else -1), rows[-1][j + 1] - 1, row[j] - 1))
        rows.append(row)
        best = max(best, *row)
    return best / (2 * len(item))


def test_alignment_scores():
    draw = random.Random(2)
    for _ in range(150):
        item = draw.choices("abcdef", k=draw.randint(1, 12))
        words = draw.choices("abcdefg", k=draw.randint(1, 20))
        score, first, last = decontamination.align(item, words)
        assert score == plain_align(item, words)
        if score:
            assert plain_align(item, words[first : last + 1]) == score


def sentence(draw, n):
    return ["".join(draw.choices("abcdefghij", k=5)) for _ in range(n)]


def fixture(spark):
    draw = random.Random(4)
    items = [sentence(draw, 30) for _ in range(12)]
    rows, want = [], set()
    for i in range(60):
        item, text = i % 12, sentence(draw, 80)
        copy = list(items[item])
        kind = i // 12
        if kind == 1:
            for k in range(3, 30, 6):
                copy[k] = "changed"
        elif kind == 2:
            del copy[7:10]
        elif kind == 3:
            copy[10:10] = ["put", "in"]
        elif kind == 4:
            copy = items[item][:6]
        if kind < 4:
            want.add((i, item))
        rows.append((i, " ".join(text[:40] + copy + text[40:])))
    docs = spark.createDataFrame(rows + [(None, None), (70, ""), (0, rows[0][1])], "doc_id bigint, text string")
    bench = [(i, " ".join(w).upper() + ".") for i, w in enumerate(items)] + [(20, None), (21, "a b"), (22, "")]
    return docs, spark.createDataFrame(bench, "item_id bigint, text string"), want


def test_exact_and_edited_copies(spark):
    docs, bench, want = fixture(spark)
    out = decontamination.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == want and len(out) == len(want)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    exact = {r["doc_id"]: r for r in out if r["score"] == 1.0}
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    assert len(exact) >= 12
    for i, r in exact.items():
        assert texts[i][r["start"] : r["end"]] + "." == items[r["item_id"]].lower()


def test_a_passage_of_a_long_item(spark):
    draw = random.Random(6)
    item = sentence(draw, 400)
    text = lambda part: " ".join(sentence(draw, 60) + part + sentence(draw, 60))
    edited = [w if k % 5 else "changed" for k, w in enumerate(item[200:350])]
    rows = [(1, text(item[100:250])), (2, text(item[340:390])), (3, text(edited)), (4, text(item[:20])), (5, text([]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontamination.contaminated(docs, bench).collect()}
    assert set(got) == {1, 2, 3} and got[1]["score"] == 0.375
    assert rows[0][1][got[1]["start"] : got[1]["end"]] == " ".join(item[100:250])


def test_blocks_give_the_same_links(spark):
    docs, bench, want = fixture(spark)
    out = decontamination.contaminated(docs, bench, block_words=100)
    assert {(r["doc_id"], r["item_id"]) for r in out.collect()} == want


def test_every_exact_copy_in_the_documents(spark, documents):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(documents, bench).collect()}
    texts = documents.select("doc_id", "text").collect()
    want = {(d, i) for i, t in bench.collect() for d, x in texts if t in x}
    assert want and want <= found


def test_odd_and_empty_tables(spark, odd_documents, no_documents):
    _, bench, _ = fixture(spark)
    assert decontamination.contaminated(no_documents, bench).count() == 0
    assert decontamination.contaminated(odd_documents, bench.limit(0)).count() == 0
    own = spark.createDataFrame([(None, "word word word word word"), (None, "A line of text")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(odd_documents, own).collect()}
    assert got == {(1, None), (None, None), (5, None), (6, None)}
