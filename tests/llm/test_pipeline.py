"""Each stage of the pipeline against a plain version of its decision, over what its predecessor kept."""

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
import pytest  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from ripplenet.llm import toxicity  # noqa: E402
from ripplenet.llm.line_dedup import dedup_lines  # noqa: E402
from test_mixing import plain_mix  # noqa: E402
from test_native import plain_dedup  # noqa: E402
from test_near_dedup import plain_groups  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]")
CLASHING = (
    "_id _n _row _doc _score _spans _text _class _key n_lines n_dropped dropped rep label rest full ranges _end _domain _lang "
    "_source _who with.dot tick`"
).split()
SMALL = "/root/testdata/sf0.001"


def test_stages(spark, documents, tmp_path):
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs, out
        assert name == "mixing" or out.schema == documents.schema
        docs = out
    before, after = kept["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
    clean = {r[0] for r in toxicity.scored(before, model).where("_score < 0.5").select("doc_id").collect()}
    assert {r["doc_id"]: r for r in after.collect()} == {r["doc_id"]: r for r in before.collect() if r["doc_id"] in clean}
    before, after = kept["line_dedup"]
    texts = dict(before.select("doc_id", "text").collect())
    want = {(i, digest) for i, _, _, digest in plain_dedup(list(texts.items()))}
    # Those that lose lines and have no word left go.
    cut = dict(dedup_lines(before).where("n_dropped > 0").select("doc_id", "text").collect())
    bare = {i for i, t in cut.items() if not WORD.search(t)}
    assert bare and all(WORD.search(texts[i]) for i in bare)
    want = {(i, digest) for i, digest in want if i not in bare}
    assert {tuple(r) for r in after.select("doc_id", F.sha2("text", 256)).collect()} == want
    assert after.where("n_chars <> char_length(text)").count() == 0
    before, after = kept["near_dedup"]
    groups = plain_groups([tuple(r) for r in before.select("doc_id", "text").collect()])
    assert {r["doc_id"] for r in after.collect()} == {i for i, g in groups.items() if i == g}
    before, after = kept["decontamination"]
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()}
    assert {r["doc_id"] for r in before.collect() if any(t in r["text"] for t in items)} <= gone
    assert len(gone) <= 0.1 * before.count()
    before, after = kept["mixing"]
    rows = [tuple(r) for r in before.select("doc_id", "text", "lang", "source").collect()]
    from ripplenet.llm.queries import MIX_SHARE, MIX_WEIGHTS

    want = plain_mix(rows, MIX_SHARE, MIX_WEIGHTS, 3)
    assert {(r["doc_id"], r["n_tokens"], r["n_epochs"]) for r in after.collect()} == set(want)


def test_odd_rows_pass_through_all_stages(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
            assert docs.columns[: len(columns)] == columns
        n = docs.count()
        assert n >= 0
    repeated = odd_documents.where("doc_id = 1")
    assert corpus_pipeline.keep_one_of_each_group(spark, repeated, SMALL).count() == 1


def test_rows_with_a_null_id_go_one_by_one(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("length(text) > 80").first()["text"]
    rows = [(5, a), (9, b), (None, a), (None, b + " end"), (None, c), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, SMALL).collect()
    assert {tuple(r) for r in kept} == {(5, a), (9, b), (None, c), (None, item)}
    clean = corpus_pipeline.drop_contaminated(spark, docs, SMALL).collect()
    assert {tuple(r) for r in clean} == set(rows[:-1])


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_columns_of_any_name_pass_through_each_stage(spark, documents, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    few = documents.where("doc_id < 60")
    docs = few.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    out = stage(spark, docs, SMALL)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in CLASHING)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in stage(spark, few, SMALL).collect()}
