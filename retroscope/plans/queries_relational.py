"""Queries on joins, unions, tallies, bins and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from retroscope.functions import bins
from retroscope.functions import text as tx
from retroscope.operators import metrics, resample
from retroscope.operators import relational as rel
from retroscope.plans import oracle as sql
from retroscope.plans import posts
from retroscope.plans.models import filled
from retroscope.plans.catalogue import documents, layer, query, structured
from retroscope.plans.queries_posts import BASE, RICH
from retroscope.session import scratch_path
from retroscope.sources import readers, writers
from retroscope.sources.readers import table


# --- sources and sinks --------------------------------------------------------------
@query("id:s title:s selftext_md5:s created_dt:s num_comments:i score:i",
       """SELECT id, title, md5(selftext) AS selftext_md5, strftime(DATE '2012-01-01' + CAST(doc_id * 37 % 5000 AS INT), '%Y-%m-%dT%H:%M:%S') AS created_dt, num_comments, score FROM posts""", [sql.POSTS])
def landed_listing_posts(spark, d):
    """Posts written as nested listing pages in two overlapping buckets, read back once each."""
    made = posts.posts_of_documents(documents(spark, d))
    child = F.struct(F.lit("t3").alias("kind"), F.struct(
        "id", "subreddit", "title", "selftext",
        F.unix_timestamp(F.col("created").cast("timestamp")).cast("double").alias("created_utc"),
        "num_comments", "score", F.lit("").alias("permalink"), F.lit("").alias("url")).alias("data"))
    # pages of about a hundred posts each, as they land
    paged = made.withColumn("page", F.floor(F.col("doc_id") / 100)).groupBy("page").agg(F.collect_list(child).alias("children"))
    folder = scratch_path(spark, "landing")
    for bucket in ("new", "top"):
        paged.select(F.struct(F.lit("").alias("after"), "children").alias("data"), F.lit(bucket).alias("bucket"), "page").write.mode(
            "append").partitionBy("bucket", "page").json(folder)
    rows = readers.read_landing(spark, folder)
    return rows.select("id", "title", F.md5("selftext").alias("selftext_md5"), "created_dt", "num_comments", "score")


@query("id:s title:s selftext_md5:s created_utc:f score:i",
       "SELECT id, title, md5(selftext) AS selftext_md5, epoch(DATE '2012-01-01' + CAST(doc_id * 37 % 5000 AS INT)) AS created_utc, score FROM posts", [sql.POSTS])
def csv_posts(spark, d):
    """Posts through quoted multi-line CSV and back."""
    made = posts.posts_of_documents(documents(spark, d))
    path = scratch_path(spark, "posts-csv")
    writers.write_csv(made.select(
        "id", "subreddit", "title", "selftext", F.unix_timestamp(F.col("created").cast("timestamp")).cast("double").alias("created_utc"),
        F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss").alias("created_dt"), "num_comments", "score",
        F.lit("/p").alias("permalink"), F.lit("/u").alias("url")), path)
    return readers.read_csv(spark, path).select("id", "title", F.md5("selftext").alias("selftext_md5"), "created_utc", "score")


def _csv_of(made):
    return made.select("id", "subreddit", "title", "selftext", F.lit(0.0).alias("created_utc"), F.lit(None).cast("string").alias("created_dt"),
                       "num_comments", "score", F.lit("/p").alias("permalink"), F.lit("/u").alias("url"))


@query("id:s title:s score:i", "SELECT id, title, score FROM posts", [sql.POSTS])
def latest_snapshot_posts(spark, d):
    """Snapshots 2, 9 and 10 of a growing collection: the last by number holds all posts, and it alone is read."""
    made, folder = posts.posts_of_documents(documents(spark, d)), scratch_path(spark, "snapshots")
    for number, part in ((2, 1), (9, 2), (10, 3)):
        writers.write_csv(_csv_of(made.where(F.col("doc_id") % 3 < part)), f"{folder}/career_stable_regret_{number}.csv")
    return readers.read_latest(spark, f"{folder}/career_stable_regret_*.csv")


# the sources that stand in for file names, and the domain of each
NAMED = {"src1": "career", "src2": "immigration", "src3": "relationships"}


@query("id:s source_subreddit:s domain:s origin:s", f"""
  SELECT id, subreddit AS source_subreddit, CASE subreddit {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMED.items())} END AS domain, 'crawl' AS origin
  FROM posts WHERE regexp_matches(subreddit, 'src1|src2')""", [sql.POSTS])
def posts_of_named_files(spark, d):
    """A file per source, those with a word in their name read; source from the name, domain and origin stated."""
    made, folder = posts.posts_of_documents(documents(spark, d)), scratch_path(spark, "named")
    for source in rel.few_values(made, "source_subreddit"):
        writers.write_csv(_csv_of(made.where(F.col("source_subreddit") == F.lit(source))), f"{folder}/{source}_stable_regret.csv")
    rows = readers.read_named(spark, f"{folder}/*.csv", ["src1", "SRC2"])
    return readers.with_source_and_domain(rows, NAMED).withColumn("origin", F.lit("crawl"))


@query("id:s title:s score:i", "SELECT id, title, score FROM posts ORDER BY score DESC, id LIMIT 200", [sql.POSTS])
def first_rows_of_scan(spark, d):
    made = posts.posts_of_documents(documents(spark, d))
    return readers.sample_rows(made.withColumn("order", -F.col("score")), 200, ["order", "id"])


@query("vec_id:i width:i total:f", "SELECT vec_id, len(embedding) AS width, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS total FROM embeddings")
def stored_vectors(spark, d):
    """Vectors through the array sink and back."""
    path = scratch_path(spark, "vectors")
    writers.write_vectors(table(spark, d, "embeddings"), "vec_id", "embedding", path)
    back = spark.read.parquet(path)
    return back.select("vec_id", F.size("vector").alias("width"), F.aggregate("vector", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")).alias("total"))


@query("domain:s rate:f n:i", "SELECT domain, round(avg(reversal), 4) AS rate, count(*) AS n FROM structured GROUP BY domain", BASE)
def stored_results(spark, d):
    """Result rows as JSON documents through the result sink and back."""
    path = scratch_path(spark, "results")
    writers.write_results(writers.result_document(rel.rates(structured(spark, d), ["domain"], "reversal"), "domain"), path)
    back = spark.read.schema("domain string, document string").json(path)
    return back.select("domain", F.from_json("document", "rate double, n bigint").alias("r")).select("domain", "r.*")


@query("id:s prompt_md5:s", """SELECT id, md5('Title: ' || title || chr(10) || 'Post: ' || substr(full_text, 1, 1500)) AS prompt_md5 FROM structured""", BASE)
def annotation_prompts(spark, d):
    made = structured(spark, d).withColumn("prompt", tx.annotation_prompt("Title: %s\nPost: %s"))
    return made.select("id", F.md5("prompt").alias("prompt_md5"))


@query("event_id:i k:f kind:f", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS DOUBLE), 0) AS k, 0.0 AS kind FROM events")
def coerced_and_filled(spark, d):
    """Text read as numbers: what is none becomes zero and fails nothing."""
    rows = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("kind"))
    return filled(rows, ["k", "kind"])


@query("id:s post_year:i", "SELECT id, CAST(year(DATE '2012-01-01' + CAST(doc_id * 37 % 5000 AS INT)) AS INT) AS post_year FROM posts", [sql.POSTS])
def parsed_years(spark, d):
    """Creation times read from their text form."""
    made = posts.posts_of_documents(documents(spark, d))
    return readers.parse_created(made.select("id", F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss").alias("created_dt")))


@query("domain:s n:i reversals:i", "SELECT domain, count(*) AS n, sum(reversal) AS reversals FROM structured GROUP BY domain", BASE)
def layer_round_trip(spark, d):
    """The structured layer written as a version partitioned by domain, then read by manifest."""
    folder = scratch_path(spark, "layers")
    writers.write_layer(structured(spark, d), folder, "structured", 1, ["domain"])
    return writers.read_layer(spark, folder, "structured").groupBy("domain").agg(
        F.count(F.lit(1)).alias("n"), F.sum("reversal").alias("reversals"))


# --- joins and sets -----------------------------------------------------------------
@query("doc_id:i source:s copies:i",
       "SELECT arg_min(doc_id, (source, doc_id)) AS doc_id, min(source) AS source, count(*) AS copies FROM documents GROUP BY text")
def dedupe_keep_first(spark, d):
    keyed = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    copies = keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    return rel.dedupe_keep_first(keyed, ["digest"], ["source", "doc_id"]).join(copies, "digest")


@query("origin:s n:i", """
  WITH all_rows AS (SELECT 0 AS p, 'benchmark' AS origin, item_id AS k, text FROM benchmark UNION ALL SELECT 1, 'documents', doc_id, text FROM documents UNION ALL SELECT 2, 'conversations', conv_id * 1000 + turn, text FROM conversations)
  SELECT origin, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY p, k) AS rn FROM all_rows) WHERE rn = 1 GROUP BY origin""")
def first_across_sources(spark, d):
    frames = [
        table(spark, d, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("k"), F.sha2("text", 256).alias("digest")),
        table(spark, d, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("k"), F.sha2("text", 256).alias("digest")),
        table(spark, d, "conversations").select(F.lit("conversations").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.sha2("text", 256).alias("digest")),
    ]
    return rel.first_across_sources(frames, "digest", "k").groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("rows:i with_lang:i with_role:i with_item:i", """
  SELECT count(*) AS rows, count(lang) AS with_lang, count(role) AS with_role, count(item_id) AS with_item FROM (
    SELECT doc_id, text, lang, source, n_chars, NULL AS item_id, NULL AS role FROM documents UNION ALL
    SELECT NULL, text, NULL, NULL, NULL, item_id, NULL FROM benchmark UNION ALL SELECT NULL, text, NULL, NULL, NULL, NULL, role FROM conversations)""")
def schema_union(spark, d):
    merged = rel.union_with_drift([table(spark, d, t) for t in ("documents", "benchmark", "conversations")])
    return merged.agg(F.count(F.lit(1)).alias("rows"), F.count("lang").alias("with_lang"), F.count("role").alias("with_role"), F.count("item_id").alias("with_item"))


@query("doc_id:i", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, d):
    return rel.not_done(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("doc_id:i lang:s quality:f toxic:f", "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def label_enrichment(spark, d):
    left = table(spark, d, "documents").select("doc_id", "lang", F.lit(None).cast("int").alias("quality"))
    return rel.enrich(left, table(spark, d, "labels"), "doc_id")


@query("c_custkey:i c_name:s n:i", """
  SELECT o_custkey AS c_custkey, c_name, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) LEFT JOIN customer ON o_custkey = c_custkey ORDER BY n DESC, c_custkey LIMIT 10""")
def lookup_join_top(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    # the ten rows are picked before the lookup, so the join handles ten rows
    top = counts.orderBy(F.desc("n"), "c_custkey").limit(10)
    return top.join(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", "left")


@query("kind:s sub:s n:i", """
  SELECT 'second' AS kind, coalesce(subreddit, 'unknown') AS sub, count(*) AS n FROM structured GROUP BY ALL
  UNION ALL SELECT 'first', CASE WHEN doc_id % 5 > 0 THEN subreddit ELSE 'unknown' END, count(*) FROM structured GROUP BY ALL""", BASE)
def fuller_source_column(spark, d):
    """The fuller of two columns where the first lacks a fifth of its values, and where the second lacks half of them."""
    rows, known = layer(spark, d), lambda c, held: F.when(held, F.col(c))
    poorer_first = rows.withColumn("subreddit", known("subreddit", F.col("doc_id") % 5 > 0))
    poorer_second = poorer_first.withColumn("source_subreddit", known("source_subreddit", F.col("doc_id") % 2 == 0))
    cases = [rel.fuller_column(r, "subreddit", "source_subreddit", "sub").select(F.lit(kind).alias("kind"), "sub") for kind, r in (("second", poorer_first), ("first", poorer_second))]
    return rel.union_with_drift(cases).groupBy("kind", "sub").agg(F.count(F.lit(1)).alias("n"))


# --- tallies ------------------------------------------------------------------------
@query("event_type:s n:i", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, d):
    return rel.value_counts(table(spark, d, "events"), "event_type")


@query("source_subreddit:s n:i outcome_rate:f known_rate:f",
       "SELECT subreddit AS source_subreddit, count(*) AS n, avg(reversal) AS outcome_rate, avg(CAST(time_to_regret_days IS NOT NULL AS INT)) AS known_rate FROM structured GROUP BY ALL", BASE)
def audit_by_source(spark, d):
    return rel.audit(structured(spark, d), "source_subreddit", "reversal", "time_to_regret_days")


@query("year:f status:s rate:f n:i", """
  SELECT year(o_orderdate) AS year, o_orderstatus AS status, avg(CAST(o_totalprice > 150000 AS INT)) AS rate, count(*) AS n FROM orders GROUP BY GROUPING SETS ((1, 2), (1))""")
def year_status_rates(spark, d):
    rows = table(spark, d, "orders").select(
        F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") > 150000).cast("int").alias("high"))
    return rel.rates_with_overall(rows, "year", "status", "high")


@query("post_year:i domain:s rate:f n:i", "SELECT post_year, domain, avg(reversal) AS rate, count(*) AS n FROM structured GROUP BY GROUPING SETS ((post_year, domain), (post_year))", BASE)
def reversal_by_year(spark, d):
    return rel.rates_with_overall(layer(spark, d), "post_year", "domain", "reversal")


ERA = "CASE WHEN post_year <= 2019 THEN 'pre_covid' WHEN post_year <= 2021 THEN 'covid' ELSE 'post_covid' END"


@query("era_domain:s rate:f n:i", f"SELECT {ERA} || '_' || domain AS era_domain, avg(reversal) AS rate, count(*) AS n FROM structured GROUP BY ALL", BASE)
def era_rates(spark, d):
    rows = layer(spark, d).withColumn("era", bins.era(F.col("post_year")))
    return rel.rates(rows, ["era", "domain"], "reversal").withColumn("era_domain", F.concat_ws("_", "era", "domain"))


@query("o_orderpriority:s o_orderstatus:s n:i", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def crosstab_counts(spark, d):
    return rel.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


@query("o_orderpriority:s F:f O:f P:f", "SELECT o_orderpriority, " + ", ".join(
    f"coalesce(avg(o_totalprice) FILTER (o_orderstatus = '{s}'), 0) AS {s}" for s in "FOP") + " FROM orders GROUP BY ALL")
def mean_pivot(spark, d):
    return rel.mean_pivot(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], "o_totalprice")


@query("event_type:s mean:f std:f median:f", "SELECT event_type, avg(value) AS mean, stddev_samp(value) AS std, median(value) AS median FROM events GROUP BY ALL")
def moments_by_event(spark, d):
    return rel.moments(table(spark, d, "events"), ["event_type"], "value")


@query("a:s b:s r:f", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def correlation_matrix(spark, d):
    return rel.correlation_matrix(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("o_orderstatus:s o_orderkey:i o_totalprice:f rank:i", """
  SELECT * FROM (SELECT o_orderstatus, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 15""")
def top_per_group(spark, d):
    return rel.top_per_group(table(spark, d, "orders"), ["o_orderstatus"], [F.desc("o_totalprice"), F.col("o_orderkey")], 15)


# --- bins and summaries -------------------------------------------------------------
def _histogram_sql(source: str, value: str, n: int) -> str:
    return f"""SELECT bin, lo + bin * w AS left_edge, n, n / (total * w) AS density FROM (
      SELECT least(CAST(floor(({value} - lo) / w) AS INT), {n - 1}) AS bin, any_value(lo) AS lo, any_value(w) AS w, count(*) AS n, any_value(total) AS total FROM {source},
        (SELECT min({value})::DOUBLE AS lo, (max({value}) - min({value})) / {n}.0::DOUBLE AS w, count({value}) AS total FROM {source}) WHERE {value} IS NOT NULL GROUP BY 1)"""


@query("bin:i left_edge:f n:i density:f", _histogram_sql("orders", "o_totalprice", 30))
def price_histogram(spark, d):
    return rel.histogram(table(spark, d, "orders"), "o_totalprice", 30)


@query("bin:i left_edge:f n:i density:f", _histogram_sql("enriched", "time_to_regret_days", 15), RICH)
def duration_histogram(spark, d):
    return rel.histogram(layer(spark, d), "time_to_regret_days", 15)


@query("o_orderpriority:s n:i q1:f median:f q3:f whisker_low:f whisker_high:f outliers:i", """
  SELECT o_orderpriority, any_value(n) AS n, any_value(q1) AS q1, any_value(med) AS median, any_value(q3) AS q3,
         min(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low, max(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
         count(*) FILTER (NOT (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS outliers
  FROM (SELECT o_orderpriority, o_totalprice AS x FROM orders) JOIN (SELECT o_orderpriority, count(*) AS n, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS med, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1) USING (o_orderpriority) GROUP BY 1""")
def price_box_summary(spark, d):
    return rel.box_summary(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")


@query("bin:i lowest:f highest:f rate:f n:i", """
  WITH e AS (SELECT quantile_cont(CAST(l_quantity AS DOUBLE), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM lineitem)
  SELECT greatest(len(list_filter(list_sort(list_distinct(q))[2:], lambda e: e < l_quantity)), 0) AS bin, min(l_quantity) AS lowest, max(l_quantity) AS highest, avg(CAST(l_returnflag = 'R' AS INT)) AS rate, count(*) AS n FROM lineitem, e GROUP BY 1""")
def quintile_rates(spark, d):
    rows = table(spark, d, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    return rel.quantile_bin_rates(rows, "l_quantity", "returned", 5)


@query("high_engagement:i rate:f n:i", "SELECT CAST(num_comments >= (SELECT median(num_comments) FROM structured) AS INT) AS high_engagement, avg(reversal) AS rate, count(*) AS n FROM structured GROUP BY ALL", BASE)
def engagement_rates(spark, d):
    return rel.rates(metrics.high_low(layer(spark, d), "num_comments", "high_engagement"), ["high_engagement"], "reversal")


# --- samples ------------------------------------------------------------------------
@query("quality:i toxic:i doc_id:i draw:i", """
  SELECT * FROM (SELECT quality, toxic, doc_id, row_number() OVER (PARTITION BY quality, toxic ORDER BY md5('42|' || doc_id), doc_id) AS draw FROM labels) WHERE draw <= 83""")
def stratified_sample(spark, d):
    return resample.stratified_sample(table(spark, d, "labels"), ["quality", "toxic"], "doc_id", 83)


@query("l_orderkey:i fold:i", """
  SELECT o_orderkey AS l_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1) % 5 AS fold FROM orders""")
def stratified_folds(spark, d):
    return resample.with_folds(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey").withColumnRenamed("o_orderkey", "l_orderkey")


@query("o_orderstatus:s test_n:i n:i", """
  SELECT o_orderstatus, count(*) FILTER (p <= round(total * 0.2)) AS test_n, count(*) AS n FROM (
    SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey), o_orderkey) AS p, count(*) OVER (PARTITION BY o_orderstatus) AS total FROM orders) GROUP BY 1""")
def stratified_split(spark, d):
    rows = resample.with_split(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")
    return rows.groupBy("o_orderstatus").agg(F.count_if("is_test").alias("test_n"), F.count(F.lit(1)).alias("n"))


@query("quality:i weight:f n:i", "SELECT quality, (SELECT count(*) FROM labels) / (2.0::DOUBLE * count(*)) AS weight, count(*) AS n FROM labels GROUP BY quality")
def balanced_weights(spark, d):
    return resample.class_weights(table(spark, d, "labels"), "quality").groupBy("quality", "weight").agg(F.count(F.lit(1)).alias("n"))
