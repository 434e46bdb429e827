"""The registered queries over the given tables, with production parameters, and the SQL that mirrors them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ripplenet.llm import (
    decontamination, digests_sql, licenses, line_dedup, merkle, mixing, near_dedup, pii, prefix_trie, quality, secrets,
    simhash, token_counts, toxicity,
)
from ripplenet.llm.common import table

PSEUDONYM_KEY = "training-corpus-key-1"
# Tokens wanted, as a share of all there are, and the weights of the tree's nodes; a node that is not named weighs 1.
MIX_SHARE = 0.5
MIX_WEIGHTS = {
    "domain": {"web": 4.0, "books": 3.0, "code": 2.0, "talk": 1.0},
    "lang": {"en": 3.0, "de": 1.0, "fr": 1.0, "es": 2.0},
    "source": {"src0": 0.5},
}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    return quality.quality(table(spark, directory, "documents"))


def op2_pii(spark: SparkSession, directory: str) -> DataFrame:
    return pii.pseudonyms(table(spark, directory, "documents"), PSEUDONYM_KEY)


def op3_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    return decontamination.contaminated(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


def op4_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    return toxicity.toxicity(table(spark, directory, "documents"), table(spark, directory, "labels"))


def op5_mixing(spark: SparkSession, directory: str) -> DataFrame:
    drawn = mixing.mix(table(spark, directory, "documents"), MIX_SHARE, MIX_WEIGHTS)
    return drawn.select("doc_id", "lang", "source", "n_tokens", "n_epochs")


def op6_licenses(spark: SparkSession, directory: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, directory, "documents"))


def op7_line_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, directory, "documents"))


def op8_token_counts(spark: SparkSession, directory: str) -> DataFrame:
    return token_counts.count_and_cut(table(spark, directory, "documents"), tokenizer_path())


def op9_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, directory, "documents"))


def op10_secrets(spark: SparkSession, directory: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, directory, "documents"))


def op11_simhash(spark: SparkSession, directory: str) -> DataFrame:
    return simhash.edited_prints(table(spark, directory, "documents"))


def op12_prefix_trie(spark: SparkSession, directory: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, directory, "conversations"))


def op13_merkle(spark: SparkSession, directory: str) -> DataFrame:
    return merkle.tampering(table(spark, directory, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_pii, op3_decontamination, op4_toxicity, op5_mixing, op6_licenses, op7_line_dedup,
        op8_token_counts, op9_near_dedup, op10_secrets, op11_simhash, op12_prefix_trie,
        op13_merkle,
    )
}

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"



def _case(column: str, weights: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1.0 END"


def _level_sql(name: str, source: str, family: str, member: str, weights: dict[str, float]) -> str:
    """CTEs that share each family's budget among the members of ``source (family, member, supply, budget)``."""
    order = f"PARTITION BY {family} ORDER BY supply / weight, {member}"
    return f"""
        {name}_w AS (SELECT *, {_case(member.split(",")[-1].strip(), weights)} AS weight FROM {source}),
        {name}_l AS (SELECT *, (budget - coalesce(sum(supply) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER (PARTITION BY {family}) - coalesce(sum(weight) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
            FROM {name}_w),
        {name}_m AS (SELECT *, max(CASE WHEN supply >= weight * level THEN level END) OVER (PARTITION BY {family}) AS water FROM {name}_l),
        {name} AS (SELECT *, greatest(CASE WHEN water IS NULL THEN supply ELSE least(supply, weight * water) END, 0) AS given FROM {name}_m)"""


def _mix_sql() -> str:
    figure = "regexp_extract(source, '[0-9]$')"
    return rf"""
        WITH d AS (SELECT doc_id, lang, source, coalesce(lang, '(none)') AS l, coalesce(source, '(none)') AS s,
            CASE WHEN {figure} IN ('0', '1', '2') THEN 'web' WHEN {figure} IN ('3', '4', '5') THEN 'books'
                 WHEN {figure} IN ('6', '7') THEN 'code' WHEN source IS NULL THEN 'other' ELSE 'talk' END AS dom,
            md5(coalesce(text, '')) AS hash, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS n FROM documents),
        leaf AS (SELECT dom, l, s, sum(n)::BIGINT AS tokens, {mixing.EPOCHS} * sum(n)::DOUBLE AS supply, 1 AS root FROM d GROUP BY dom, l, s HAVING sum(n) > 0),
        top AS (SELECT root, dom, sum(supply) AS supply, {MIX_SHARE} * (SELECT sum(tokens) FROM leaf) AS budget FROM leaf GROUP BY root, dom),
        {_level_sql("a", "top", "root", "dom", MIX_WEIGHTS["domain"])},
        mid AS (SELECT leaf.dom, l, sum(leaf.supply) AS supply, any_value(a.given) AS budget FROM leaf JOIN a USING (dom) GROUP BY leaf.dom, l),
        {_level_sql("b", "mid", "dom", "l", MIX_WEIGHTS["lang"])},
        low AS (SELECT leaf.dom, leaf.l, s, tokens, leaf.supply, b.given AS budget FROM leaf JOIN b USING (dom, l)),
        {_level_sql("c", "low", "dom, l", "s", MIX_WEIGHTS["source"])},
        plan AS (SELECT dom, l, s, tokens, floor(given + 1e-6)::BIGINT AS ask FROM c),
        o AS (SELECT d.*, ask // tokens AS n_full, ask % tokens AS rest,
            md5('{mixing.SEED}:' || (ask // tokens) || ':' || coalesce(doc_id::VARCHAR, 'null:' || hash)) AS place FROM d JOIN plan USING (dom, l, s)),
        r AS (SELECT *, sum(n) OVER (PARTITION BY dom, l, s ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM o)
        SELECT doc_id, lang, source, n AS n_tokens, (n_full + (rest > 0 AND upto <= rest)::INT)::INT AS n_epochs
        FROM r WHERE n_full + (rest > 0 AND upto <= rest)::INT > 0"""


ORACLES: dict[str, str] = {
    "op5_mixing": _mix_sql(),
    "op7_line_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, str_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
        k AS (SELECT *, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key),
        m AS (SELECT k.*, coalesce(k.doc_id > f.first_doc, false) AS gone FROM k LEFT JOIN f USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY rid, doc_id""",
    "op12_prefix_trie": digests_sql.TRIE,
    "op13_merkle": digests_sql.MERKLE,
}
