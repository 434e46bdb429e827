"""Secret scanning with corpus-wide ownership frequency.

Patterns give candidate spans inside each text. The candidates' hashes are then counted over the whole corpus by distinct
repositories and owners: a value that many owners hold is a copied example, one that few hold looks live. Bare tokens
that no base pattern covers are added as spans only where the count makes them owner-specific.

Positions are code points: the pieces between matches and the matches themselves, laid end to end, give every offset.

Nulls and edge cases: a null or empty text has no spans. A null owner or repository counts as one owner or repository of
that name. Repeated rows count once for each owner and repository, and each gets its own result row. An empty table
gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplenet.llm.common import let, order_id, positions, whole_text
from ripplenet.storage import materialize

# Fixed patterns: kind -> (pattern, group of the value, least characters of the value).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (ASSIGN, 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "bare": (r"[A-Za-z0-9+/_-]{20,}", 0, 20),
}
BASE = ("assign", "access", "hex")
# A value held by this many owners, or in this many repositories, is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 6
_SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _spans(text: Column, kind: str) -> Column:
    """All spans of one kind, in order; matches that are too short take part in matching and go afterwards."""
    pattern, group, least = KINDS[kind]
    number = list(KINDS).index(kind)

    def placed(pieces: Column) -> Column:
        lengths = lambda i: F.char_length(F.get(pieces["gap"], i))
        folded = F.aggregate(
            positions(F.size(pieces["hit"])),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
            lambda a, i: F.struct(
                (a["at"] + lengths(i) + F.char_length(F.get(pieces["hit"], i))).alias("at"),
                F.array_append(a["starts"], a["at"] + lengths(i)).alias("starts"),
            ),
            lambda a: a["starts"],
        )

        def row(start: Column, i: Column) -> Column:
            stop = start + F.char_length(F.get(pieces["hit"], i))
            value = F.get(pieces["value"], i)
            return F.struct(start.alias("start"), F.lit(number).alias("kind"), stop.alias("stop"), value.alias("value"))

        return F.filter(F.transform(folded, row), lambda s: F.char_length(s["value"]) >= least)

    found = F.struct(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    return F.when(text.rlike(pattern), let(found, placed)).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def _outside(span: Column, others: Column) -> Column:
    return ~F.exists(others, lambda o: (o["start"] < span["stop"]) & (span["start"] < o["stop"]))


def candidates(docs: DataFrame, owner: str = "source", repository: Column | None = None) -> DataFrame:
    """``(doc_id, _id, _row, _owner, _repo, base, extra)``: the spans of each row of ``docs``.

    ``extra`` are bare tokens outside the base spans that hold a digit and letters of both cases.
    """
    repo = F.concat_ws("/", F.col(owner), F.col("lang")) if repository is None else repository
    rows = docs.select(
        "doc_id", order_id().alias("_id"), whole_text().alias("_text"), F.xxhash64(whole_text()).alias("_row"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"), F.coalesce(repo, F.lit("")).alias("_repo"),
    )
    text = F.col("_text")
    found = rows.select(
        "doc_id", "_id", "_row", "_owner", "_repo",
        F.sort_array(F.concat(*[_spans(text, k) for k in BASE])).alias("base"), _spans(text, "bare").alias("_bare"),
    )
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")
    extra = F.filter("_bare", lambda s: mixed(s) & _outside(s, F.col("base")))
    return found.select("doc_id", "_id", "_row", "_owner", "_repo", "base", extra.alias("extra"))


def ownership(found: DataFrame, owners: int = EXAMPLE_OWNERS, repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """``(_value, n_owners, n_repositories, example)`` for every candidate value of the corpus.

    Values are reduced to distinct (value, repository) rows before they meet, so a value copied a million times is a few
    rows by then.
    """
    each = found.select("_owner", "_repo", F.explode(F.concat("base", "extra")).alias("s"))
    pairs = each.select(F.sha2(F.col("s")["value"], 256).alias("_value"), "_owner", "_repo").distinct()
    per_owner = pairs.groupBy("_value", "_owner").agg(F.count(F.lit(1)).alias("_n"))
    total = per_owner.groupBy("_value").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("_n").alias("n_repositories")
    )
    example = (F.col("n_owners") >= owners) | (F.col("n_repositories") >= repositories)
    return total.withColumn("example", example)


def _listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def scan_secrets(docs: DataFrame, owner: str = "source", repository: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: base spans, all spans, and how many candidates look live or like copied examples."""
    found = materialize(candidates(docs, owner, repository), "secret-spans")
    some = F.size("base") + F.size("extra") > 0
    key = ["_id", "_row"]
    spans = found.where(some).dropDuplicates(key).select(*key, F.explode(F.concat("base", "extra")).alias("s"))
    judged = spans.withColumn("_value", F.sha2(F.col("s")["value"], 256)).join(ownership(found), "_value")
    count = lambda c: F.count(F.when(c, 1))
    verdicts = judged.groupBy(key).agg(
        F.collect_list(F.when(~F.col("example"), F.col("s"))).alias("_live"),
        count(~F.col("example")).alias("n_live"), count(F.col("example")).alias("n_example"),
    )
    out = found.join(verdicts, key, "left")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == list(KINDS).index(k))).cast("bigint")
    bare = F.filter(
        F.coalesce("_live", F.array().cast(_SPAN)), lambda s: s["kind"] == list(KINDS).index("bare")
    )
    return out.select(
        "doc_id", *[of_kind(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.sort_array(F.concat("base", bare))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )
