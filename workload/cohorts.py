"""Vertex values, profiles, vocabulary, classification, regions, agreement and file sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ripplenet.functions import dates, places, text
from ripplenet.operators import agreement, classify, cleaning, profiles, regions, statistics, values
from ripplenet.operators.sampling import sample_exact
from ripplenet.operators.structure import degrees
from ripplenet.plans.classification import classify_snowball
from ripplenet.sources import files
from ripplenet.storage import materialize, scratch_root, small_table
from workload import inputs as inp

KEYWORDS = ["that", "with", "andere", "the", "les", "and-", "ion,"]


# Values.

def _users(spark, d):
    return inp.table(spark, d, "events").select(F.col("user_id").alias("v")).distinct()


def topic_values(spark, d):
    found = values.topic_values(inp.purchases(spark, d), "purchase")
    return values.with_default(found, inp.table(spark, d, "customer").select(F.col("c_custkey").alias("v")))


def keyword_values(spark, d):
    docs = inp.table(spark, d, "documents")
    texts = inp.spread(docs.select(F.col("source").alias("v"), "text"))
    return values.keyword_values(texts, docs.select(F.col("source").alias("v")).distinct(), KEYWORDS)


def off_hours(spark, d):
    return values.off_hours_values(inp.activity(spark, d), _users(spark, d))


def years(spark, d):
    first = inp.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("v")).agg(F.min("o_orderdate").alias("ts"))
    return values.year_values(first, inp.table(spark, d, "customer").select(F.col("c_custkey").alias("v")))


def name_lengths(spark, d):
    return values.length_values(inp.table(spark, d, "part").select(F.col("p_partkey").alias("v"), F.col("p_name").alias("name")))


def status_times(spark, d):
    """Event times written as status timestamps and parsed back."""
    ts = F.col("ts").cast("timestamp")
    written = inp.table(spark, d, "events").select("event_id", F.concat(F.date_format(ts, "EEE MMM dd HH:mm:ss"), F.lit(" UTC "), F.date_format(ts, "yyyy")).alias("created"))
    parsed = written.withColumn("at", dates.parse_status_time(F.col("created")))
    return parsed.select("event_id", F.hour("at").alias("hour"), dates.years_since_1900(F.col("at")).alias("year"), dates.is_off_hours(F.col("at")).alias("off"))


# Text.

def clean_tokens(spark, d):
    return inp.document_texts(spark, d).select("v", text.clean_text(F.col("text"), inp.STOP_WORDS).alias("cleaned"))


def scrubbed(spark, d):
    return inp.document_texts(spark, d).select("v", text.scrub_text(F.col("text")).alias("scrubbed"))


def conversation_profiles(spark, d):
    turns = inp.table(spark, d, "conversations").select(F.col("conv_id").alias("v"), "turn", "text")
    return profiles.profiles(turns, "turn")


def _words(spark, d, members=None):
    texts = inp.document_texts(spark, d)
    if members is not None:
        texts = texts.join(members.select("v"), "v", "left_semi")
    stops = small_table(spark, ["value"], [(w,) for w in inp.STOP_WORDS])
    return profiles.profile_words(texts, stops)


def _labelled(spark, d):
    return inp.table(spark, d, "labels").select(F.col("doc_id").alias("v"), F.col("quality").alias("label"))


def _unlabelled(spark, d):
    return inp.document_texts(spark, d).select("v").join(_labelled(spark, d).select("v"), "v", "left_anti")


def word_totals(spark, d):
    return profiles.word_counts(_words(spark, d))


def vocabulary(spark, d):
    return profiles.vocabulary(_words(spark, d))


def _vectors(spark, d, build, members):
    words = materialize(_words(spark, d), "words")
    vocab = materialize(profiles.vocabulary(words.join(_labelled(spark, d).select("v"), "v", "left_semi")), "vocab")
    chosen = words.join(members(spark, d).select("v"), "v", "left_semi")
    return build(chosen, vocab)


def training_vectors(spark, d):
    found = _vectors(spark, d, profiles.training_vectors, _labelled)
    return profiles.vector_text(found)


def scoring_vectors(spark, d):
    found = _vectors(spark, d, profiles.scoring_vectors, _unlabelled)
    return profiles.vector_text(found)


def ignored(spark, d):
    words = materialize(_words(spark, d, _unlabelled(spark, d)), "words")
    vocab = materialize(profiles.vocabulary(_words(spark, d, _labelled(spark, d))), "vocab")
    return profiles.ignored_users(words, profiles.scoring_vectors(words, vocab))


def training_set(spark, d):
    toxic = inp.table(spark, d, "labels").where(F.col("toxic") == 1).select(F.col("doc_id").alias("v"))
    return profiles.training_set(_labelled(spark, d), toxic, _unlabelled(spark, d), percent=80)


def external_sample(spark, d):
    return profiles.external_sample(_unlabelled(spark, d), 100)


def _scored(spark, d):
    words = materialize(_words(spark, d), "words")
    labelled = _labelled(spark, d)
    vocab = materialize(profiles.vocabulary(words.join(labelled.select("v"), "v", "left_semi")), "vocab")
    size = profiles.FIRST_WORD_ID + vocab.count()
    vectors = classify.as_features(profiles.scoring_vectors(words, vocab), size)
    rows = materialize(vectors.join(labelled, "v", "left").select("v", F.col("label").cast("double").alias("label"), "features"), "rows")
    training, scoring = classify.train_and_score(rows)
    return classify.fit_labels(training).transform(scoring)


def random_forest(spark, d):
    return _scored(spark, d).select("v", "predictedLabel")


def prediction_table(spark, d):
    labels = inp.table(spark, d, "labels")
    kept = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("v"))
    toxic = labels.where((F.col("toxic") == 1) & (F.col("quality") == 0)).select(F.col("doc_id").alias("v"))
    return classify.prediction_table(_scored(spark, d), kept, toxic)


def label_index(spark, d):
    rows = _labelled(spark, d).withColumn("label", F.col("label").cast("double"))
    return classify.label_index(rows).select("label", F.col("index").cast("int").alias("index"))


def feature_index(spark, d):
    """The features of the labelled users' vectors; values as text, the smallest five where there are more."""
    index = classify.feature_index(materialize(_vectors(spark, d, profiles.training_vectors, _labelled), "vectors"))
    return index.select("id", F.array_join(F.transform("values", lambda x: x.cast("bigint")), " ").alias("values"), "categorical")


def forest_facts(spark, d):
    """Who is scored, and whether each has a label that training knows."""
    return random_forest(spark, d).select("v", F.col("predictedLabel").isin("0.0", "1.0").alias("known"))


def prediction_facts(spark, d):
    """Rows of the prediction table; the label only where no classifier chooses it."""
    scored = _unlabelled(spark, d).withColumn("scored", F.lit(True))
    rows = prediction_table(spark, d).join(scored, "v", "left").withColumn("scored", F.coalesce("scored", F.lit(False)))
    return rows.select("v", "scored", F.when(~F.col("scored"), F.col("label")).alias("label"), F.col("label").isin("0.0", "1.0").alias("known"))


def snowball_classification(spark, d):
    """From ten sampled users: a user owns the document of the same number and is known by its labels."""
    links = inp.event_links(spark, d)
    seeds = sample_exact(_users(spark, d), "v", 10, "snowball")
    texts = inp.document_texts(spark, d)
    external = texts.select("v").join(_labelled(spark, d), "v", "left_anti").join(_users(spark, d), "v", "left_anti")
    stops = small_table(spark, ["value"], [(w,) for w in inp.STOP_WORDS])
    return classify_snowball(texts, links, seeds, _labelled(spark, d), inp.event_cohort(spark, d), external, stops)


def snowball_facts(spark, d):
    """The snowball's table with the classifier's choice as a check that it is one of the labels."""
    rows = snowball_classification(spark, d)
    return rows.select("v", "part", F.when(F.col("part") != "scored", F.col("label")).alias("label"), F.col("label").isin("0.0", "1.0").alias("known"))


# Agreement.

def _votes(spark, d):
    """Three annotators: quality, absence of toxicity, and length, the last unsure about French."""
    rows = inp.table(spark, d, "labels").join(inp.table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    length = F.when(F.col("lang") == "fr", 2).otherwise((F.col("n_chars") >= 1000).cast("int"))
    return rows.select(F.col("doc_id").alias("item"), F.explode(F.array(F.col("quality"), 1 - F.col("toxic"), length)).alias("label"))


def _counts(spark, d):
    docs = inp.table(spark, d, "documents")
    predictions = docs.select(F.col("doc_id").alias("item"), (F.col("n_chars") >= 500).cast("int").alias("predicted"))
    return agreement.label_counts(_votes(spark, d), predictions)


def kappa(spark, d):
    return agreement.fleiss_kappa(_counts(spark, d)).select("items", "raters", *inp.r6("observed", "expected", "kappa"))


# Regions.

def _locations(spark, d):
    c = inp.table(spark, d, "customer")
    location = F.concat(F.lit("Town "), F.col("c_nationkey").cast("string"), F.lit(" "), "c_mktsegment")
    return c.select(F.col("c_custkey").alias("v"), location.alias("location"), (F.col("c_acctbal") > 5000).alias("ill"))


def _lookup(spark, d):
    c = inp.table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()
    key = F.col("c_nationkey")
    part = F.when(key % 2 == 0, F.substring("c_mktsegment", 1, 2)).otherwise(F.col("c_mktsegment"))
    tail = F.when(key % 5 == 4, F.lit(", Canada")).otherwise(F.lit(", USA"))
    address = F.concat(F.lit("town, "), part, F.lit(" "), F.lpad(key.cast("string"), 5, "0"), tail)
    location = F.lower(F.concat(F.lit("Town "), key.cast("string"), F.lit(" "), "c_mktsegment"))
    return c.select(location.alias("location"), address.alias("address"))


def _states(spark, d):
    c = inp.table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    return c.select("name", F.substring("name", 1, 2).alias("abbreviation"))


def normalised_states(spark, d):
    addresses = _lookup(spark, d).select("location", F.lower("address").alias("address"))
    return regions.normalise_states(addresses, _states(spark, d)).select("location", "region")


def _cohort_table(spark, d):
    users = _locations(spark, d)
    tables = []
    for cohort in (users.where("ill"), users.where("NOT ill")):
        located = regions.cohort_locations(users, cohort)
        tables.append(regions.state_distribution(located, _lookup(spark, d), _states(spark, d)))
    return regions.cohort_table(*tables)


def split_cohorts(spark, d):
    """Documents predicted by their quality label, counted per cohort."""
    labels = inp.table(spark, d, "labels")
    predictions = labels.select(F.col("doc_id").alias("v"), F.col("quality").cast("double").cast("string").alias("label"))
    ill, well = regions.split_cohorts(predictions)
    return ill.withColumn("cohort", F.lit("ill")).unionByName(well.withColumn("cohort", F.lit("well")))


def cohort_percentage(spark, d):
    return regions.cohort_percentage(_cohort_table(spark, d)).select("region", "or18", "well", *inp.r6("res"))


def merged_regions(spark, d):
    shapes = _states(spark, d).select(F.lower("name").alias("region"), "abbreviation")
    return regions.merge_regions(shapes, _cohort_table(spark, d))


def unknown_locations(spark, d):
    known = _lookup(spark, d).where(~F.col("address").contains("Canada"))
    return regions.unknown_locations(_locations(spark, d).select(F.lower("location").alias("location")), known)


def geocoded(spark, d):
    c = inp.table(spark, d, "customer")
    found = F.concat(F.lit('{"status":"OK","results":[{"formatted_address":"'), F.col("c_name"), F.lit(', USA"}]}'))
    payload = F.when(F.col("c_nationkey") == 3, F.lit('{"status":"ZERO_RESULTS","results":[]}')).otherwise(found)
    query = F.when(F.col("c_nationkey") == 4, F.lit("")).otherwise(F.col("c_name"))
    return c.select("c_custkey", places.geocode_address(query, payload).alias("address"))


def filled_years(spark, d):
    """Region keys of nations looked up with a default for those not in Africa or America."""
    few = inp.table(spark, d, "region").where(F.col("r_name").isin("AFRICA", "AMERICA")).select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return cleaning.lookup_or(inp.table(spark, d, "nation"), few, "n_regionkey", "r_name", "elsewhere").select("n_nationkey", "r_name")


# Sources: tables are written in the file layouts and read back.

def _folder(spark, label):
    return f"{scratch_root(spark)}/layouts/{label}-{uuid.uuid4().hex}"


def edge_list(spark, d):
    path = _folder(spark, "edges")
    links = inp.event_links(spark, d)
    line = F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string"))
    commented = F.when(F.col("src") == F.col("dst"), F.concat(F.lit("# loop "), line)).otherwise(line)
    links.select(commented).write.text(path)
    return files.read_edge_list(spark, path)


def named_network(spark, d):
    path = _folder(spark, "network")
    files.write_tsv(inp.event_links(spark, d), path)
    return files.load_network(spark, "enron", {"enron": files.Network(path, files.clean_mode("enron"))})


def catalog_networks(spark, d):
    """Event links as three networks of the catalog: mutual and simple by their own rule, and raw as the caller asks."""
    path = _folder(spark, "networks")
    loaded = []
    catalog = files.network_catalog(path, {"amazon": "raw"})
    for name in ("enron", "gowalla", "amazon"):
        files.write_tsv(inp.event_links(spark, d), catalog[name].path)
        loaded.append(files.load_network(spark, name, catalog).select("src", "dst").withColumn("network", F.lit(name)))
    return loaded[0].unionByName(loaded[1]).unionByName(loaded[2])


def ratings(spark, d):
    path = _folder(spark, "ratings")
    events = inp.table(spark, d, "events")
    topic = F.length("event_type").cast("string")
    full = F.concat_ws("\t", F.col("event_id").cast("string"), F.col("user_id").cast("string"), topic)
    short = F.concat_ws("\t", F.col("event_id").cast("string"), F.col("user_id").cast("string"))
    events.select(F.when(F.col("event_type") == "error", short).otherwise(full)).write.text(path)
    return values.topic_values(files.read_ratings(spark, path), 8)


def user_info(spark, d):
    path = _folder(spark, "users")
    c = inp.table(spark, d, "customer")
    blank = F.lit("null")
    number = F.col("c_nationkey")
    rows = c.select(
        F.concat(F.lit("f"), number).alias("a"), "c_name", F.when(number < 5, blank).otherwise(F.col("c_mktsegment")),
        number.alias("n1"), number.alias("n2"), blank.alias("b1"), blank.alias("b2"), blank.alias("b3"),
        number.alias("n3"), blank.alias("b4"), blank.alias("b5"), blank.alias("b6"), F.col("c_custkey").cast("int"),
    )
    files.write_tsv(rows, path)
    return files.read_user_info(spark, path).select("followed_user", "screen_name", "location", "followers", "created", "statuses")


def votes_file(spark, d):
    path = _folder(spark, "votes")
    rows = inp.table(spark, d, "labels")
    item = F.col("doc_id").cast("string")
    rows.select(F.when(F.col("toxic") == 1, item).otherwise(F.concat_ws("\t", item, F.col("quality").cast("string")))).write.text(path)
    return files.read_votes(spark, path)


def vocabulary_file(spark, d):
    path = _folder(spark, "vocabulary")
    files.write_vocabulary(vocabulary(spark, d), path)
    return files.read_vocabulary(spark, path)


QUERIES = {
    "b14_split_cohorts": split_cohorts,
    "a1_edge_list": edge_list,
    "a2_named_network": named_network,
    "a2_catalog_networks": catalog_networks,
    "a3_value_counts": ratings,
    "a3_value_default": topic_values,
    "a5_user_info": user_info,
    "a11_vocabulary_file": vocabulary_file,
    "a13_votes_file": votes_file,
    "c5_lookup_default": filled_years,
    "c10_region_merge": merged_regions,
    "j14_keyword_value": keyword_values,
    "j15_offhours_value": off_hours,
    "j16_year_value": years,
    "j17_name_length_value": name_lengths,
    "h5_status_time": status_times,
    "h1_clean_tokens": clean_tokens,
    "h3_scrub_text": scrubbed,
    "d10_word_counts": word_totals,
    "d11_profiles": conversation_profiles,
    "k2_vocabulary": vocabulary,
    "k3_training_vectors": training_vectors,
    "k4_scoring_vectors": scoring_vectors,
    "k4_ignored_users": ignored,
    "k5_training_set": training_set,
    "k6_external_sample": external_sample,
    "k7_label_index": label_index,
    "k8_feature_index": feature_index,
    "k9_random_forest": random_forest,
    "k9_forest_facts": forest_facts,
    "k11_prediction_table": prediction_table,
    "k11_prediction_facts": prediction_facts,
    "k11_snowball_classification": snowball_classification,
    "k11_snowball_facts": snowball_facts,
    "l1_label_counts": _counts,
    "l2_fleiss_kappa": kappa,
    "l3_confusion": lambda s, d: agreement.confusion(_counts(s, d)),
    "c7_cohort_region_table": _cohort_table,
    "c4_unknown_locations": unknown_locations,
    "h10_geocode_payload": geocoded,
    "h11_state_normalise": normalised_states,
    "l6_cohort_percentage": cohort_percentage,
    "d6_median_by_flag": lambda s, d: statistics.median_by_counts(
        inp.table(s, d, "lineitem").groupBy("l_returnflag", "l_extendedprice").agg(F.count(F.lit(1)).alias("c")),
        ["l_returnflag"], "l_extendedprice", "c", bounded=False,
    ).select("l_returnflag", *inp.r6("median")),
    "d16_value_histogram": lambda s, d: statistics.rounded_histogram(
        inp.table(s, d, "events"), ["event_type"], "value", 0
    ),
    "d1_mutual_degrees": lambda s, d: degrees(cleaning.mutual_edges(inp.event_links(s, d))),
}


WORDS = """
tokens AS (SELECT doc_id v, unnest(list_filter(string_split(regexp_replace(lower(text), '[^A-Za-z0-9]', ' ', 'g'), ' '),
  lambda x: length(x) > 3)) word FROM documents),
words AS (SELECT v, word, count(*) n FROM tokens WHERE word NOT IN ('that', 'with', 'this', 'from', 'they', 'have') GROUP BY ALL)"""


def _vocab(where: str = "true") -> str:
    return f"""vocab AS (SELECT word, row_number() OVER (ORDER BY word) + 99 id FROM
      (SELECT word FROM words WHERE {where} GROUP BY word HAVING sum(n) > 3))"""


LABELLED = "v IN (SELECT doc_id FROM labels)"
VECTORS = f"""WITH {WORDS}, {_vocab(LABELLED)},
  vec AS (SELECT v, string_agg(id || ':' || n, ' ' ORDER BY id) features, sum(n) tokens, count(*) kinds
    FROM words JOIN vocab USING (word) GROUP BY v)"""

VOTES = """votes AS (SELECT doc_id item, quality label FROM labels UNION ALL SELECT doc_id, 1 - toxic FROM labels
  UNION ALL SELECT doc_id, CASE WHEN lang = 'fr' THEN 2 WHEN n_chars >= 1000 THEN 1 ELSE 0 END FROM labels JOIN documents USING (doc_id)),
counts AS (SELECT item, (CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END)::int predicted, count(*) FILTER (label = 0) n0,
  count(*) FILTER (label = 1) n1, count(*) FILTER (label = 2) n2, count(*) FILTER (label = 3) n3
  FROM votes JOIN documents ON doc_id = item GROUP BY item, n_chars)"""

REGIONS = """
locs AS (SELECT c_custkey v, lower('Town ' || c_nationkey || ' ' || c_mktsegment) location, c_acctbal > 5000 ill FROM customer),
look AS (SELECT DISTINCT lower('Town ' || c_nationkey || ' ' || c_mktsegment) location,
  lower(CASE WHEN c_nationkey % 2 = 0 THEN left(c_mktsegment, 2) ELSE c_mktsegment END) part,
  c_nationkey % 5 = 4 abroad FROM customer),
states AS (SELECT DISTINCT lower(c_mktsegment) name, lower(left(c_mktsegment, 2)) abbr FROM customer),
normal AS (SELECT location, coalesce(name, part) region FROM look LEFT JOIN states ON abbr = part WHERE NOT abroad),
region_table AS (SELECT region, sum(ill::int)::bigint or18, sum((NOT ill)::int)::bigint well FROM locs JOIN normal USING (location) GROUP BY region
  UNION ALL SELECT 'idaho', 0, 0 UNION ALL SELECT 'south dakota', 0, 0)"""


def _keyword_sql() -> str:
    listed = ", ".join(f"'{w}'" for w in values.clean_keywords(KEYWORDS))
    return f"""WITH hits AS (SELECT source v, len(list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g')), ' '),
        lambda x: length(x) > 1 AND x IN ({listed}))) h FROM documents)
      SELECT v, (1 + sum(h))::bigint AS k FROM hits GROUP BY v"""



ORACLES = {
    "b14_split_cohorts": "SELECT doc_id AS v, CASE WHEN quality = 1 THEN 'ill' ELSE 'well' END AS cohort FROM labels",
    "a1_edge_list": f"WITH {inp.EVENT_LINKS} SELECT src, dst FROM links WHERE src <> dst",
    "a2_named_network": f"""WITH {inp.EVENT_LINKS}, u AS (SELECT DISTINCT src, dst FROM links)
      SELECT a.src, a.dst FROM u a JOIN u b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst""",
    "a2_catalog_networks": f"""WITH {inp.EVENT_LINKS}, u AS (SELECT DISTINCT src, dst FROM links)
      SELECT 'enron' AS network, a.src, a.dst FROM u a JOIN u b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst
      UNION ALL SELECT DISTINCT 'gowalla', least(src, dst), greatest(src, dst) FROM links WHERE src <> dst
      UNION ALL SELECT 'amazon', src, dst FROM links""",
    "a3_value_counts": """SELECT user_id AS v, count(*) + 1 AS k FROM events
      WHERE length(event_type) = 8 AND event_type <> 'error' GROUP BY 1""",
    "a3_value_default": """SELECT c_custkey AS v, 1 + count(user_id) AS k FROM customer
      LEFT JOIN events ON user_id = c_custkey AND event_type = 'purchase' GROUP BY 1""",
    "a5_user_info": """SELECT 'f' || c_nationkey AS followed_user, c_name AS screen_name,
      CASE WHEN c_nationkey >= 5 THEN c_mktsegment END AS location, c_nationkey AS followers, NULL::varchar AS created,
      c_custkey::int AS statuses FROM customer""",
    "a11_vocabulary_file": f"WITH {WORDS}, {_vocab()} SELECT word, id FROM vocab",
    "a13_votes_file": """SELECT doc_id::varchar AS item, (CASE WHEN toxic = 1 THEN 2 ELSE quality END)::int AS label FROM labels""",
    "c5_lookup_default": """SELECT n_nationkey, CASE WHEN r_name IN ('AFRICA', 'AMERICA') THEN r_name ELSE 'elsewhere' END AS r_name
      FROM nation JOIN region ON r_regionkey = n_regionkey""",
    "c10_region_merge": f"""WITH {REGIONS}, a AS (SELECT DISTINCT c_mktsegment name FROM customer)
      SELECT region, left(name, 2) AS abbreviation, or18, well FROM a JOIN region_table ON region = lower(name)""",
    "j14_keyword_value": _keyword_sql(),
    "j15_offhours_value": """SELECT user_id AS v, 1 + count(*) FILTER (hour(ts) < 6 OR hour(ts) > 21) AS k FROM events GROUP BY 1""",
    "j16_year_value": """SELECT c_custkey AS v, coalesce(min(year(o_orderdate)) - 1900, 108)::bigint AS k
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "j17_name_length_value": "SELECT p_partkey AS v, length(p_name)::bigint AS k FROM part",
    "h5_status_time": """SELECT event_id, hour(ts)::int AS hour, (year(ts) - 1900)::int AS year, (hour(ts) < 6 OR hour(ts) > 21) AS off FROM events""",
    "h1_clean_tokens": """SELECT doc_id AS v, array_to_string(list_filter(string_split(regexp_replace(lower(text), '[^A-Za-z0-9]', ' ', 'g'), ' '),
        lambda x: length(x) > 3 AND x NOT IN ('that', 'with', 'this', 'from', 'they', 'have')), ' ') AS cleaned FROM documents""",
    "h3_scrub_text": r"""SELECT doc_id AS v, regexp_replace(text, '\p{C}|\s+|\r$|\\t|\\n|\\r', ' ', 'g') AS scrubbed FROM documents""",
    "d10_word_counts": f"WITH {WORDS} SELECT word, sum(n)::bigint AS n FROM words GROUP BY word",
    "d11_profiles": """SELECT conv_id AS v, 0::bigint AS segment, string_agg(text, ' ' ORDER BY turn) AS profile FROM conversations GROUP BY conv_id""",
    "k2_vocabulary": f"WITH {WORDS}, {_vocab()} SELECT word, id FROM vocab",
    "k3_training_vectors": f"{VECTORS} SELECT v, features FROM vec WHERE tokens > 3 AND {LABELLED}",
    "k4_scoring_vectors": f"{VECTORS} SELECT v, features FROM vec WHERE kinds > 3 AND NOT {LABELLED}",
    "k4_ignored_users": f"""{VECTORS}, u AS (SELECT DISTINCT v FROM words WHERE NOT {LABELLED}),
      kept AS (SELECT v FROM vec WHERE kinds > 3 AND NOT {LABELLED})
      SELECT (SELECT count(*) FROM u) - (SELECT count(*) FROM kept) AS ignored, (SELECT count(*) FROM kept) AS available""",
    "k5_training_set": f"""WITH pos AS (SELECT doc_id v FROM labels WHERE toxic = 1 OR quality = 1),
      neg AS (SELECT doc_id v FROM labels WHERE quality = 0 AND toxic <> 1),
      ext AS (SELECT doc_id v, row_number() OVER (ORDER BY md5('external|' || doc_id), doc_id) r FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels))
      SELECT v, 1::int AS label FROM pos UNION ALL SELECT v, 0 FROM neg UNION ALL
      SELECT v, 0 FROM ext WHERE r <= floor(100.0::double / 80 * ((SELECT count(*) FROM pos) + (SELECT count(*) FROM neg)))""",
    "k6_external_sample": """SELECT doc_id AS v FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
      ORDER BY md5('external|' || doc_id), doc_id LIMIT 100""",
    "k7_label_index": """SELECT l AS label, (row_number() OVER (ORDER BY l) - 1)::int AS index FROM (SELECT DISTINCT quality::double::varchar l FROM labels)""",
    "k8_feature_index": f"""{VECTORS}, kept AS (SELECT v FROM vec WHERE tokens > 3 AND {LABELLED}),
      f AS (SELECT id, n FROM words JOIN vocab USING (word) JOIN kept USING (v)),
      vals AS (SELECT DISTINCT id, n FROM f UNION SELECT id, 0 FROM f GROUP BY id HAVING count(*) < (SELECT count(*) FROM kept)),
      r AS (SELECT id, n, row_number() OVER (PARTITION BY id ORDER BY n) r FROM vals)
      SELECT id, string_agg(n::varchar, ' ' ORDER BY n) AS values, count(*) <= 4 AS categorical FROM r WHERE r <= 5 GROUP BY id""",
    "k9_forest_facts": f"{VECTORS} SELECT v, true AS known FROM vec WHERE kinds > 3 AND NOT {LABELLED}",
    "k11_prediction_facts": f"""{VECTORS} SELECT v, true AS scored, NULL::varchar AS label, true AS known FROM vec WHERE kinds > 3 AND NOT {LABELLED}
      UNION ALL SELECT doc_id, false, '1.0', true FROM labels WHERE quality = 1 OR toxic = 1""",
    "k11_snowball_facts": f"""WITH {inp.EVENT_LINKS}, {inp.EVENT_COHORT}, {WORDS},
      seeds AS (SELECT v FROM (SELECT DISTINCT user_id v FROM events) ORDER BY md5('snowball|' || v), v LIMIT 10),
      w1 AS (SELECT DISTINCT dst v FROM links WHERE src IN (SELECT v FROM seeds) EXCEPT SELECT v FROM seeds),
      kept AS (SELECT v FROM w1 WHERE v IN (SELECT v FROM cohort)),
      w2 AS (SELECT DISTINCT dst v FROM links WHERE src IN (SELECT v FROM kept) EXCEPT SELECT v FROM w1 EXCEPT SELECT v FROM seeds),
      pos AS (SELECT v FROM seeds UNION SELECT doc_id FROM labels WHERE quality = 1),
      neg AS (SELECT doc_id v FROM labels WHERE quality = 0 AND doc_id NOT IN (SELECT v FROM pos)),
      ext AS (SELECT doc_id v, row_number() OVER (ORDER BY md5('external|' || doc_id), doc_id) r FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT user_id FROM events)
        AND doc_id NOT IN (SELECT v FROM pos)),
      taught AS (SELECT v FROM pos UNION SELECT v FROM neg UNION SELECT v FROM ext
        WHERE r <= floor(100.0::double / 36 * ((SELECT count(*) FROM pos) + (SELECT count(*) FROM neg)))),
      {_vocab("v IN (SELECT v FROM taught)")},
      scored AS (SELECT v FROM words JOIN vocab USING (word) WHERE v IN (SELECT v FROM w2) GROUP BY v HAVING count(*) > 3)
      SELECT v, 'scored' AS part, NULL::varchar AS label, true AS known FROM scored
      UNION ALL SELECT v, 'kept', '1.0', true FROM kept UNION ALL SELECT v, 'seed', '1.0', true FROM seeds""",
    "l1_label_counts": f"WITH {VOTES} SELECT item, predicted, n0, n1, n2, n3 FROM counts",
    "l2_fleiss_kappa": f"""WITH {VOTES}, p AS (SELECT avg((n0 * n0 + n1 * n1 + n2 * n2 + n3 * n3 - 3) / 6.0::double) o,
        (sum(n0) / (3.0::double * count(*))) ** 2 + (sum(n1) / (3.0::double * count(*))) ** 2
        + (sum(n2) / (3.0::double * count(*))) ** 2 + (sum(n3) / (3.0::double * count(*))) ** 2 e, count(*) items FROM counts)
      SELECT items, 3::bigint AS raters, round(o, 6) AS observed, round(e, 6) AS expected, round((o - e) / (1 - e), 6) AS kappa FROM p""",
    "l3_confusion": f"""WITH {VOTES} SELECT count(*) FILTER (predicted = 1 AND n1 > n0) AS tp, count(*) FILTER (predicted = 1 AND n0 > n1) AS fp,
      count(*) FILTER (predicted = 0 AND n0 > n1) AS tn, count(*) FILTER (predicted = 0 AND n1 > n0) AS fn FROM counts""",
    "c7_cohort_region_table": f"WITH {REGIONS} SELECT region, or18, well FROM region_table",
    "c4_unknown_locations": f"WITH {REGIONS} SELECT DISTINCT location FROM look WHERE abroad",
    "h10_geocode_payload": """SELECT c_custkey, CASE WHEN c_nationkey IN (3, 4) THEN 'invalid' ELSE c_name || ', USA' END AS address FROM customer""",
    "h11_state_normalise": f"WITH {REGIONS} SELECT location, region FROM normal",
    "l6_cohort_percentage": f"""WITH {REGIONS} SELECT region, or18, well,
      CASE WHEN or18 > 0 THEN round(100.0::double * or18 / (or18 + well), 6) END AS res FROM region_table""",
    "d6_median_by_flag": "SELECT l_returnflag, round(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY 1",
    "d16_value_histogram": "SELECT event_type, round(value, 0) AS bucket, count(*) AS n FROM events GROUP BY ALL",
    "d1_mutual_degrees": f"""WITH {inp.EVENT_LINKS}, u AS (SELECT DISTINCT src, dst FROM links)
      SELECT a.src AS v, count(*) AS k FROM u a JOIN u b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY 1""",
}
