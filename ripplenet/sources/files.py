"""Readers and writers for the text layouts of the network and cohort data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplenet.operators.cleaning import clean_edges, mutual_edges
from ripplenet.storage import materialize, small_table

# Column layouts of the files.
USER_INFO = (
    "followed_user string, screen_name string, location string, followers int, friends int, created string, "
    "description string, lang string, listed int, withheld string, time_zone string, background string, statuses int"
)
TIMELINE = (
    "user string, contributors string, created string, own_retweet_id bigint, favourites int, geo string, "
    "reply_name string, reply_status bigint, reply_user bigint, lang string, place string, retweets int, text string, "
    "sensitive boolean, truncated boolean"
)
LAYOUTS = {
    "user_info": USER_INFO,
    "timeline": TIMELINE,
    "predictions": "v string, label string",
    "labels": "v string, label int",
    "location_lookup": "location string, address string",
    "state_lookup": "name string, abbreviation string",
}
RESULT_COLUMNS = {
    "real": "method wave seed lmsiAll lmsiDistinct mean medGraphDeg avgGraphDeg varianceOfBootStrapDegrees l1 muProxy "
    "l2 lmin lmax".split(),
    "cohort": "method wave lmsiAll lmsiDistinct mean medGraphDeg avgGraphDeg varianceOfBootStrapDegrees l1 l2 lmin "
    "lmax".split(),
    "lognormal": "wave mu sigma vertices seed bootCount bootSamplePercentage lmsiAll lmsiDistinct mean avgGraphDeg "
    "varianceOfBootStrapDegrees l1 muProxy l2 lmin lmax".split(),
    "rmat": "wave vertices seed bootCount bootSamplePercentage lmsiAll lmsiDistinct mean avgGraphDeg "
    "varianceOfBootStrapDegrees l1 muProxy l2 lmin lmax".split(),
}
# Types of result columns; those not named here are doubles.
RESULT_TYPES = {
    "method": "string", "wave": "int", "seed": "int", "vertices": "bigint", "bootCount": "int", "bootSamplePercentage": "int",
}
CLEANING = ("simple", "mutual", "raw")
# Lines a reader sets aside before it stops.
MAX_REJECTED = 10_000
# Files of the public networks, which of them are cleaned as simple graphs, and which keep mutual edges only.
NETWORK_FILES = {
    "epinions-value": "epinionsuser_ratingcleaned.txt",
    "dblp": "dblpgraph.txt",
    "facebook": "facebook-links.txt",
    "facebook-ego": "facebook_combined.txt",
    "enron": "Email-Enron.txt",
    "wiki-talk": "WikiTalk.txt",
    "wiki-vote": "Wiki-Vote.txt",
    "gowalla": "Gowalla_edges.txt",
    "kite": "Brightkite_edges.txt",
    "epinions": "soc-Epinions1.txt",
    "slashdot+": "slashdot-zoo-pos.txt",
    "slashdot-": "slashdot-zoo-neg.txt",
    "prosper": "prosper-loans.txt",
    "livemocha": "livemocha.txt",
    "douban": "out.douban",
    "libimseti": "out.libimseti",
    "digg-friends": "out.digg-friends",
    "actor-co": "out.actor-collaboration",
    "citeser": "out.citeseer",
    "dogster": "out.dogster",
    "catster": "out.catster",
    "hamster": "out.hamster",
    "chicago": "out.chicago",
    "california": "out.california",
    "texas": "out.texas",
    "jdk": "out.jdk",
    "jung": "out.jung",
    "linux": "out.linux",
    "patent": "cit-Patents.txt",
    "livejournal": "soc-LiveJournal1.txt",
    "as-skitter": "as-skitter.txt",
    "orkut": "com-orkut.ungraph.txt",
    "youtube": "com-youtube.ungraph.txt",
    "amazon": "com-amazon.ungraph.txt",
    "web-google": "web-Google.txt",
    "web-notredame": "web-NotreDame.txt",
    "web-berkeley": "web-BerkStan.txt",
    "web-stanford": "web-Stanford.txt",
    "Ca-CondMat": "CA-CondMat.txt",
    "CA-AstroPh": "CA-AstroPh.txt",
    "CA-GrQc": "CA-GrQc.txt",
    "CA-HepPh": "CA-HepPh.txt",
    "CA-HepTh": "CA-HepTh.txt",
}
SIMPLE_NETWORKS = ("facebook", "dblp", "gowalla", "kite")
MUTUAL_NETWORKS = ("enron", "wiki-talk", "epinions", "livejournal")


def read_edge_list(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Whitespace-separated ``src dst`` lines; blank lines and ``#`` comments are skipped.

    A line without two ids stops the job in FAILFAST mode and is left out in DROP mode.
    """
    if mode not in ("FAILFAST", "DROP"):
        raise ValueError(f"mode must be FAILFAST or DROP, got {mode!r}")
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    ids = lines.select(*[F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint").alias(n) for i, n in enumerate(("src", "dst"))], "value")
    broken = F.col("src").isNull() | F.col("dst").isNull()
    if mode == "DROP":
        ids = ids.where(~broken)
    else:
        stop = F.raise_error(F.concat(F.lit("not an edge: "), F.col("value"))).cast("bigint")
        ids = ids.withColumn("src", F.when(broken, stop).otherwise(F.col("src")))
    return ids.select("src", "dst")


@dataclass(frozen=True)
class Network:
    """Where a named network lies and how it is cleaned: ``simple``, ``mutual`` or ``raw``."""

    path: str
    clean: str = "simple"


def clean_mode(name: str) -> str:
    """Cleaning of the well-known networks; an unknown name is an error, never a substitute."""
    if name in SIMPLE_NETWORKS:
        return "simple"
    if name in MUTUAL_NETWORKS:
        return "mutual"
    raise ValueError(f"no cleaning rule for network {name!r}")


def network_catalog(folder: str, clean: Mapping[str, str] | None = None) -> dict[str, Network]:
    """The public networks with their files in ``folder``, as far as there is a rule for cleaning them.

    ``clean`` names the rule of a network that has none of its own, or takes the place of that; it may only name networks
    that are known. One without a rule is not in the catalog, so that loading it fails instead of guessing.
    """
    chosen = {name: clean_mode(name) for name in (*SIMPLE_NETWORKS, *MUTUAL_NETWORKS)} | dict(clean or {})
    unknown = sorted(set(chosen) - set(NETWORK_FILES))
    if unknown:
        raise ValueError(f"no such networks: {', '.join(unknown)}")
    wrong = {name: rule for name, rule in chosen.items() if rule not in CLEANING}
    if wrong:
        raise ValueError(f"clean must be one of {', '.join(CLEANING)}, got {wrong}")
    return {name: Network(f"{folder.rstrip('/')}/{NETWORK_FILES[name]}", rule) for name, rule in chosen.items()}


def load_network(spark: SparkSession, name: str, catalog: Mapping[str, Network]) -> DataFrame:
    """Read and clean a named network of the caller's ``catalog``."""
    if name not in catalog:
        raise ValueError(f"unknown network {name!r}; known: {', '.join(sorted(catalog))}")
    entry = catalog[name]
    edges = read_edge_list(spark, entry.path)
    if entry.clean == "simple":
        return clean_edges(edges)
    if entry.clean == "mutual":
        return mutual_edges(edges)
    if entry.clean == "raw":
        return edges
    raise ValueError(f"clean must be simple, mutual or raw, got {entry.clean!r}")


def inline_edges(spark: SparkSession, edges: Sequence[tuple[int, int]]) -> DataFrame:
    """The caller's own edges as a table."""
    return small_table(spark, ["src", "dst"], list(edges)).select(*[F.col(c).cast("bigint").alias(c) for c in ("src", "dst")])


def _tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated rows; a field that does not fit its type, or a line with too many or few, stops the job."""
    return spark.read.csv(path, schema=schema, sep="\t", quote="", enforceSchema=True, mode="FAILFAST")


def _as_read(table: DataFrame, layout: str) -> DataFrame:
    """What a layout's reader makes of its fields: missing user texts are null, lookups are in lower case."""
    text = [f.name for f in table.schema if f.dataType.simpleString() == "string"]
    if layout == "user_info":
        return table.replace("null", None, subset=text)
    if layout in ("location_lookup", "state_lookup"):
        return table.select(*[F.lower(c).alias(c) for c in text])
    return table


def read_with_rejects(
    spark: SparkSession, path: str, layout: str, max_rejected: int = MAX_REJECTED
) -> tuple[DataFrame, DataFrame]:
    """Rows of one of ``LAYOUTS``, and the lines that are none as a written table ``(line, reason)``.

    A line is rejected for its number of fields or for its first field that does not fit its type; empty fields are null and
    empty lines are skipped. More than ``max_rejected`` rejected lines stop the job: such a file has another layout.
    """
    fields = T.StructType.fromDDL(LAYOUTS[layout]).fields
    found = F.split("value", "\t", -1)
    raw = {f.name: F.nullif(F.get("_f", F.lit(i)), F.lit("")) for i, f in enumerate(fields)}
    kind = {f.name: f.dataType.simpleString() for f in fields}
    typed = {n: raw[n] if kind[n] == "string" else raw[n].try_cast(kind[n]) for n in kind}
    count = F.when(F.size("_f") != len(fields), F.format_string(f"%d fields in place of {len(fields)}", F.size("_f")))
    unfit = [
        F.when(raw[n].isNotNull() & typed[n].isNull(), F.concat(F.lit(f"{n} is no {kind[n]}: "), raw[n]))
        for n in kind if kind[n] != "string"
    ]
    lines = spark.read.text(path).where("value <> ''").withColumn("_f", found).withColumn("_reason", F.coalesce(count, *unfit, F.lit(None)))
    rejected = lines.where("_reason is not null").select(F.col("value").alias("line"), F.col("_reason").alias("reason"))
    rejected = materialize(rejected, "rejected")
    n = rejected.count()
    if n > max_rejected:
        raise ValueError(f"{n} lines of {path} are no {layout}, more than {max_rejected}; one of them: {rejected.first()['reason']}")
    rows = lines.where("_reason is null").select(*[c.alias(name) for name, c in typed.items()])
    return _as_read(rows, layout), rejected


def read_user_info(spark: SparkSession, path: str) -> DataFrame:
    """User table; the text ``null`` means missing."""
    return _as_read(_tsv(spark, path, USER_INFO), "user_info")


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, TIMELINE)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, LAYOUTS["predictions"])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, LAYOUTS["labels"])


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lines: stop words, seed names."""
    return spark.read.text(path).distinct()


def _fields(spark: SparkSession, path: str, arity: int, sep: str = "\t") -> DataFrame:
    """Lines with exactly ``arity`` fields, as the array ``f``; all others are malformed and skipped.

    Empty fields at the end of a line do not count as fields.
    """
    return _split_lines(spark, path, sep).where(F.size("f") == arity)


def _split_lines(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return spark.read.text(path).select(F.split(F.regexp_replace("value", f"{sep}+$", ""), sep).alias("f"))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Three-field rating lines as ``(user, topic)``; a line whose ids are no numbers stops the job."""
    return _fields(spark, path, 3).select(F.col("f")[1].cast("bigint").alias("user"), F.col("f")[2].cast("bigint").alias("topic"))


def read_external_profiles(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path, 2).select(F.col("f")[0].alias("v"), F.col("f")[1].alias("text"))


def read_external_corpus(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path, 4).select(F.col("f")[0].alias("v"), F.col("f")[2].alias("text"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path, 2, ":").select(F.col("f")[0].alias("word"), F.col("f")[1].cast("bigint").alias("id"))


def read_libsvm(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("libsvm").load(path)


def read_location_lookup(spark: SparkSession, path: str) -> DataFrame:
    return _as_read(_tsv(spark, path, LAYOUTS["location_lookup"]), "location_lookup")


def read_state_lookup(spark: SparkSession, path: str) -> DataFrame:
    return _as_read(_tsv(spark, path, LAYOUTS["state_lookup"]), "state_lookup")


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    """One annotator's votes ``(item, label)``; a line without a label, or with an empty one, counts as 2, unsure."""
    parts = _split_lines(spark, path)
    label = F.when(F.size("f") == 2, F.try_element_at("f", F.lit(2)).cast("int")).otherwise(F.lit(2))
    return parts.select(F.col("f")[0].alias("item"), label.alias("label"))


def result_schema(layout: str) -> str:
    return ", ".join(f"{c} {RESULT_TYPES.get(c, 'double')}" for c in RESULT_COLUMNS[layout])


def read_results(spark: SparkSession, path: str, layout: str | None = None) -> DataFrame:
    """Experiment rows with a header, in the types of their ``layout``; without one the types follow the few result rows."""
    if layout is None:
        return spark.read.csv(path, header=True, sep="\t", inferSchema=True)
    return spark.read.csv(path, header=True, sep="\t", schema=result_schema(layout), enforceSchema=False, mode="FAILFAST")


def write_tsv(df: DataFrame, path: str, header: bool = False, columns: Sequence[str] | None = None) -> None:
    """Tab-separated files in a folder, one per partition: written by the executors, never through the driver.

    Tabs, line breaks and other control characters inside a text become single spaces, so each row stays one line.
    """
    rows = df.select(*columns) if columns else df
    texts = {f.name: F.regexp_replace(f.name, r"\p{Cntrl}+", " ") for f in rows.schema if f.dataType.simpleString() == "string"}
    rows.withColumns(texts).write.csv(
        path, sep="\t", header=header, quote="", escape="", emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def write_results(results: DataFrame, path: str, layout: str) -> None:
    """Sweep rows in one of the four published layouts."""
    write_tsv(results, path, header=True, columns=RESULT_COLUMNS[layout])


def write_libsvm(vectors: DataFrame, path: str) -> None:
    """``(label, features)`` with textual features, as ``label id:count ...`` lines."""
    vectors.select(F.concat_ws(" ", F.col("label").cast("string"), "features")).write.text(path)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.select(F.concat_ws(":", "word", F.col("id").cast("string"))).write.text(path)
