"""File layouts written from the given tables and read back, and the plans that start from such files."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ripplenet.operators import agreement, classify
from ripplenet.sources import files
from ripplenet.storage import scratch_root
from workload import inputs as inp


def folder(spark, label):
    return f"{scratch_root(spark)}/layouts/{label}-{uuid.uuid4().hex}"


def timeline_file(spark, d):
    """Conversation turns as statuses; their line breaks must not split a row."""
    turns = inp.table(spark, d, "conversations")
    null, zero = F.lit("null"), F.lit(0)
    rows = turns.select(
        F.col("conv_id").cast("string").alias("user"), null.alias("c1"), null.alias("c2"), F.col("turn").alias("own"),
        zero.alias("n1"), null.alias("c3"), null.alias("c4"), zero.alias("n2"), zero.alias("n3"), F.col("role").alias("lang"),
        null.alias("c5"), F.length("role").alias("n4"), "text", (F.col("turn") % 2 == 0).alias("b1"), F.lit(False).alias("b2"),
    )
    path = folder(spark, "timeline")
    files.write_tsv(rows, path)
    return files.read_timeline(spark, path).select("user", "own_retweet_id", "lang", "retweets", "text", "sensitive")


def predictions_file(spark, d):
    path = folder(spark, "predictions")
    label = F.when(F.col("toxic") == 1, "1.0").otherwise("0.0")
    files.write_tsv(inp.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("v"), label.alias("label")), path)
    return files.read_predictions(spark, path)


def labels_file(spark, d):
    path = folder(spark, "labels")
    files.write_tsv(inp.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("v"), "quality"), path)
    return files.read_labels(spark, path)


def list_file(spark, d):
    path = folder(spark, "list")
    inp.table(spark, d, "customer").select("c_mktsegment").write.text(path)
    return files.read_list(spark, path)


def libsvm_file(spark, d):
    path = folder(spark, "libsvm")
    label = (F.col("p_size") % 2).alias("label")
    features = F.concat_ws(" ", F.concat(F.lit("1:"), F.col("p_partkey") + 1), F.concat(F.lit("3:"), F.col("p_size")))
    files.write_libsvm(inp.table(spark, d, "part").select(label, features.alias("features")), path)
    values = vector_to_array("features")
    read = files.read_libsvm(spark, path)
    return read.select("label", *[values[i].alias(f"f{i + 1}") for i in range(3)])


def location_lookup_file(spark, d):
    path = folder(spark, "locations")
    files.write_tsv(inp.table(spark, d, "customer").select("c_name", F.upper("c_mktsegment").alias("address")), path)
    return files.read_location_lookup(spark, path)


def state_lookup_file(spark, d):
    path = folder(spark, "states")
    files.write_tsv(inp.table(spark, d, "nation").select("n_name", F.substring("n_name", 1, 2).alias("short")), path)
    return files.read_state_lookup(spark, path)


def external_profiles_file(spark, d):
    """Two fields make a profile; lines with a third are malformed."""
    path = folder(spark, "profiles")
    third = F.when(F.col("s_nationkey") < 5, "x")
    inp.table(spark, d, "supplier").select(F.concat_ws("\t", F.col("s_suppkey").cast("string"), "s_name", third)).write.text(path)
    return files.read_external_profiles(spark, path)


def external_corpus_file(spark, d):
    path = folder(spark, "corpus")
    fourth = F.when(F.col("s_nationkey") >= 5, "x")
    inp.table(spark, d, "supplier").select(
        F.concat_ws("\t", F.col("s_suppkey").cast("string"), F.lit("en"), "s_name", fourth)
    ).write.text(path)
    return files.read_external_corpus(spark, path)


def results_file(spark, d):
    """Statistics of part prices by size, laid out as result rows of a cohort sweep."""
    price = F.col("p_retailprice")
    found = inp.table(spark, d, "part").groupBy(F.col("p_size").alias("wave")).agg(
        F.count(F.lit(1)).alias("lmsiAll"), F.count_distinct("p_brand").alias("lmsiDistinct"),
        *[F.round(f(price), 2).alias(n) for n, f in (("mean", F.max), ("lmin", F.min), ("lmax", F.max))],
    )
    same = ("medGraphDeg", "avgGraphDeg", "varianceOfBootStrapDegrees", "l1", "l2")
    rows = found.withColumns({"method": F.lit("pooled"), **{n: F.col("mean") for n in same}})
    path = folder(spark, "results")
    files.write_results(rows, path, "cohort")
    return files.read_results(spark, path)


def _other_layout(layout):
    """Order statistics by customer and status, laid out as result rows of a sweep over a network."""

    def query(spark, d):
        price = F.col("o_totalprice")
        found = inp.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("seed"), F.length("o_orderstatus").alias("wave")).agg(
            F.count(F.lit(1)).cast("double").alias("lmsiAll"), F.count_distinct("o_orderpriority").cast("double").alias("lmsiDistinct"),
            *[F.round(f(price), 2).alias(n) for n, f in (("mean", F.max), ("lmin", F.min), ("lmax", F.max))],
        )
        names = files.RESULT_COLUMNS[layout]
        texts = {"method": F.lit("pooled"), "vertices": F.col("seed") * 3_000_000_000, "bootCount": F.lit(1000), "bootSamplePercentage": F.lit(50)}
        rest = {n: texts.get(n, F.col("mean")) for n in names if n not in found.columns}
        path = folder(spark, f"results-{layout}")
        files.write_results(found.withColumns(rest), path, layout)
        return files.read_results(spark, path, layout)

    return query


def _rejecting(layout, table, line, *shown):
    """Lines of a layout made from a table, some of them malformed: the rows read and the lines set aside."""

    def query(spark, d):
        path = folder(spark, f"{layout}-rejects")
        inp.table(spark, d, table).select(line()).write.text(path)
        rows, rejected = files.read_with_rejects(spark, path, layout, max_rejected=10**9)
        good = rows.select(F.lit("row").alias("part"), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in shown]).alias("line"))
        good = good.withColumn("reason", F.lit(None).cast("string"))
        return good.unionByName(rejected.withColumn("part", F.lit("rejected")))

    return query


def _tabs(*fields):
    return F.concat_ws("\t", *[f.cast("string") for f in fields])


def _user_line():
    number = F.when(F.col("c_custkey") % 11 == 0, F.lit("many")).otherwise(F.col("c_custkey").cast("string"))
    fields = [F.lit("f"), "c_name", F.lit("null"), number, F.lit(2), F.lit("c"), F.lit("null"), F.lit("en"), F.lit(3), F.lit("w"), F.lit("t"), F.lit("b")]
    fields = [F.col(f) if isinstance(f, str) else f for f in fields]
    return F.when(F.col("c_custkey") % 7 == 0, _tabs(*fields)).otherwise(_tabs(*fields, F.lit("")))


def _status_line():
    number = F.when(F.col("turn") == 3, F.lit("1.5")).otherwise(F.col("turn").cast("string"))
    flag = F.when(F.col("conv_id") % 5 == 0, F.lit("perhaps")).otherwise(F.lit("true"))
    blank, zero = F.lit(""), F.lit(0)
    return _tabs(
        F.col("conv_id"), blank, blank, number, zero, blank, blank, zero, zero, F.col("role"), blank, F.length("role"),
        F.substring(F.regexp_replace("text", r"\p{Cntrl}+", " "), 1, 20), flag, F.lit("false"),
    )


def _label_line():
    label = F.when(F.col("doc_id") % 5 == 0, F.lit("yes")).otherwise(F.col("quality").cast("string"))
    return F.when(F.col("doc_id") % 7 == 0, _tabs(F.col("doc_id"), label, F.lit("more"))).otherwise(_tabs(F.col("doc_id"), label))


def _prediction_line():
    return F.when(F.col("doc_id") % 7 == 0, F.col("doc_id").cast("string")).otherwise(_tabs(F.col("doc_id"), F.lit("1.0")))


def _location_line():
    return F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")).otherwise(_tabs(F.col("c_name"), F.col("c_mktsegment")))


def _state_line():
    return F.when(F.col("n_regionkey") == 1, _tabs(F.col("n_name"), F.lit("X"), F.lit("Y"))).otherwise(_tabs(F.col("n_name"), F.col("n_regionkey")))


def annotators(spark, d):
    """Agreement from one vote file for each of three annotators; a line without a label is unsure."""
    labels = inp.table(spark, d, "labels")
    item = F.col("doc_id").cast("string")
    votes = []
    for number, label in enumerate((F.col("quality"), 1 - F.col("toxic"), F.col("doc_id") % 2)):
        path = folder(spark, f"annotator{number}")
        unsure = F.col("doc_id") % 7 == number
        line = F.when(unsure, F.concat(item, F.lit("\t"))).otherwise(F.concat_ws("\t", item, label.cast("string")))
        labels.select(line).write.text(path)
        votes.append(files.read_votes(spark, path))
    predictions = labels.select(item.alias("item"), F.col("quality").alias("predicted"))
    counts = agreement.label_counts(votes[0].unionByName(votes[1]).unionByName(votes[2]), predictions)
    return agreement.fleiss_kappa(counts).select("items", "raters", *inp.r6("observed", "expected", "kappa"))


def split_rows(spark, d):
    """Documents with a known quality train, all others are scored."""
    labels = inp.table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    rows = inp.table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left")
    training, scoring = classify.train_and_score(rows.select(F.col("doc_id").alias("v"), "label"))
    return training.select("v", F.lit("training").alias("part")).unionByName(scoring.select("v", F.lit("scoring").alias("part")))


QUERIES = {
    "a6_timeline_file": timeline_file,
    "a7_predictions_file": predictions_file,
    "a8_labels_file": labels_file,
    "a9_list_file": list_file,
    "a10_libsvm_file": libsvm_file,
    "a12_location_lookup_file": location_lookup_file,
    "a12_state_lookup_file": state_lookup_file,
    "a14_external_profiles_file": external_profiles_file,
    "a14_external_corpus_file": external_corpus_file,
    "a15_results_file": results_file,
    "a5_user_info_rejects": _rejecting("user_info", "customer", _user_line, "screen_name", "location", "followers", "statuses"),
    "a6_timeline_rejects": _rejecting("timeline", "conversations", _status_line, "user", "own_retweet_id", "lang", "text", "sensitive"),
    "a7_predictions_rejects": _rejecting("predictions", "labels", _prediction_line, "v", "label"),
    "a8_labels_rejects": _rejecting("labels", "labels", _label_line, "v", "label"),
    "a12_location_rejects": _rejecting("location_lookup", "customer", _location_line, "location", "address"),
    "a12_state_rejects": _rejecting("state_lookup", "nation", _state_line, "name", "abbreviation"),
    "a16_results_real": _other_layout("real"),
    "a16_results_lognormal": _other_layout("lognormal"),
    "a16_results_rmat": _other_layout("rmat"),
    "b15_train_and_score": split_rows,
    "l2_annotator_files": annotators,
}

def _other_layout_sql(layout):
    made = {
        "method": "'pooled'", "wave": "wave::int", "seed": "seed::int", "vertices": "(seed * 3000000000)::bigint", "bootCount": "1000::int",
        "bootSamplePercentage": "50::int", "lmsiAll": "n::double", "lmsiDistinct": "p::double", "lmin": "low",
    }
    columns = ", ".join(f'{made.get(c, "high")} AS "{c}"' for c in files.RESULT_COLUMNS[layout])
    return f"""SELECT {columns} FROM (SELECT o_custkey seed, length(o_orderstatus) wave, count(*) n, count(DISTINCT o_orderpriority) p,
      round(max(o_totalprice), 2)::double high, round(min(o_totalprice), 2)::double low FROM orders GROUP BY ALL)"""


def _rejects_sql(table, line, row, reason):
    return f"""SELECT CASE WHEN reason IS NULL THEN 'row' ELSE 'rejected' END AS part, CASE WHEN reason IS NULL THEN row ELSE line END AS line, reason
      FROM (SELECT {line} AS line, {row} AS row, {reason} AS reason FROM {table})"""


_TAB = "chr(9)"
_STATUS = "left(regexp_replace(text, '[\\x00-\\x1f\\x7f]+', ' ', 'g'), 20)"
ORACLES = {
    "a5_user_info_rejects": _rejects_sql(
        "customer",
        f"""concat_ws({_TAB}, 'f', c_name, 'null', CASE WHEN c_custkey % 11 = 0 THEN 'many' ELSE c_custkey::varchar END, '2', 'c', 'null', 'en', '3', 'w', 't', 'b')
        || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE {_TAB} END""",
        "concat_ws('|', c_name, '-', c_custkey::varchar, '-')",
        "CASE WHEN c_custkey % 7 = 0 THEN '12 fields in place of 13' WHEN c_custkey % 11 = 0 THEN 'followers is no int: many' END",
    ),
    "a6_timeline_rejects": _rejects_sql(
        "conversations",
        f"""array_to_string([conv_id::varchar, '', '', CASE WHEN turn = 3 THEN '1.5' ELSE turn::varchar END, '0', '', '', '0', '0', role, '',
        length(role)::varchar, {_STATUS}, CASE WHEN conv_id % 5 = 0 THEN 'perhaps' ELSE 'true' END, 'false'], {_TAB})""",
        f"concat_ws('|', conv_id::varchar, turn::varchar, role, {_STATUS}, 'true')",
        "CASE WHEN turn = 3 THEN 'own_retweet_id is no bigint: 1.5' WHEN conv_id % 5 = 0 THEN 'sensitive is no boolean: perhaps' END",
    ),
    "a7_predictions_rejects": _rejects_sql(
        "labels", f"CASE WHEN doc_id % 7 = 0 THEN doc_id::varchar ELSE doc_id || {_TAB} || '1.0' END", "doc_id || '|1.0'",
        "CASE WHEN doc_id % 7 = 0 THEN '1 fields in place of 2' END",
    ),
    "a8_labels_rejects": _rejects_sql(
        "labels", f"doc_id || {_TAB} || CASE WHEN doc_id % 5 = 0 THEN 'yes' ELSE quality::varchar END || CASE WHEN doc_id % 7 = 0 THEN {_TAB} || 'more' ELSE '' END",
        "doc_id || '|' || quality", "CASE WHEN doc_id % 7 = 0 THEN '3 fields in place of 2' WHEN doc_id % 5 = 0 THEN 'label is no int: yes' END",
    ),
    "a12_location_rejects": _rejects_sql(
        "customer", f"CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE c_name || {_TAB} || c_mktsegment END", "lower(c_name || '|' || c_mktsegment)",
        "CASE WHEN c_custkey % 7 = 0 THEN '1 fields in place of 2' END",
    ),
    "a12_state_rejects": _rejects_sql(
        "nation", f"CASE WHEN n_regionkey = 1 THEN concat_ws({_TAB}, n_name, 'X', 'Y') ELSE n_name || {_TAB} || n_regionkey END",
        "lower(n_name || '|' || n_regionkey)", "CASE WHEN n_regionkey = 1 THEN '3 fields in place of 2' END",
    ),
    "a16_results_real": _other_layout_sql("real"),
    "a16_results_lognormal": _other_layout_sql("lognormal"),
    "a16_results_rmat": _other_layout_sql("rmat"),
    "a6_timeline_file": r"""SELECT conv_id::varchar AS user, turn AS own_retweet_id, role AS lang, length(role)::int AS retweets,
      regexp_replace(text, '[\x00-\x1f\x7f]+', ' ', 'g') AS text, turn % 2 = 0 AS sensitive FROM conversations""",
    "a7_predictions_file": "SELECT doc_id::varchar AS v, CASE WHEN toxic = 1 THEN '1.0' ELSE '0.0' END AS label FROM labels",
    "a8_labels_file": "SELECT doc_id::varchar AS v, quality::int AS label FROM labels",
    "a9_list_file": "SELECT DISTINCT c_mktsegment AS value FROM customer",
    "a10_libsvm_file": """SELECT (p_size % 2)::double AS label, (p_partkey + 1)::double AS f1, 0::double AS f2, p_size::double AS f3 FROM part""",
    "a12_location_lookup_file": "SELECT lower(c_name) AS location, lower(c_mktsegment) AS address FROM customer",
    "a12_state_lookup_file": "SELECT lower(n_name) AS name, lower(left(n_name, 2)) AS abbreviation FROM nation",
    "a14_external_profiles_file": "SELECT s_suppkey::varchar AS v, s_name AS text FROM supplier WHERE s_nationkey >= 5",
    "a14_external_corpus_file": "SELECT s_suppkey::varchar AS v, s_name AS text FROM supplier WHERE s_nationkey >= 5",
    "a15_results_file": """SELECT 'pooled' AS method, p_size::int AS wave, count(*)::int AS "lmsiAll", count(DISTINCT p_brand)::int AS "lmsiDistinct",
      round(max(p_retailprice), 2) AS mean, round(max(p_retailprice), 2) AS "medGraphDeg", round(max(p_retailprice), 2) AS "avgGraphDeg",
      round(max(p_retailprice), 2) AS "varianceOfBootStrapDegrees", round(max(p_retailprice), 2) AS l1, round(max(p_retailprice), 2) AS l2,
      round(min(p_retailprice), 2) AS lmin, round(max(p_retailprice), 2) AS lmax FROM part GROUP BY p_size""",
    "b15_train_and_score": """SELECT doc_id AS v, CASE WHEN quality IN (0, 1) THEN 'training' ELSE 'scoring' END AS part
      FROM documents LEFT JOIN labels USING (doc_id)""",
    "l2_annotator_files": """WITH votes AS (
        SELECT doc_id item, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE quality END label FROM labels
        UNION ALL SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN 2 ELSE 1 - toxic END FROM labels
        UNION ALL SELECT doc_id, CASE WHEN doc_id % 7 = 2 THEN 2 ELSE doc_id % 2 END FROM labels),
      c AS (SELECT item, count(*) FILTER (label = 0) n0, count(*) FILTER (label = 1) n1, count(*) FILTER (label = 2) n2 FROM votes GROUP BY item),
      p AS (SELECT avg((n0 * n0 + n1 * n1 + n2 * n2 - 3) / 6.0::double) o, (sum(n0) / (3.0::double * count(*))) ** 2
        + (sum(n1) / (3.0::double * count(*))) ** 2 + (sum(n2) / (3.0::double * count(*))) ** 2 e, count(*) items FROM c)
      SELECT items, 3::bigint AS raters, round(o, 6) AS observed, round(e, 6) AS expected, round((o - e) / (1 - e), 6) AS kappa FROM p""",
}
