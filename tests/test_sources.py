"""Files in, files out, threads, resumption and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from retroscope.functions import lexicons as lex
from retroscope.operators import relational, terms, topics
from retroscope.functions import text as tx
from retroscope.plans import posts
from retroscope.session import cut_lineage, scratch_path
from retroscope.sources import comments, readers, writers
from retroscope.streaming import streams

HEADER = "id,subreddit,title,selftext,created_utc,created_dt,num_comments,score,permalink,url\n"


def csv(folder, name, *rows):
    (folder / name).write_text(HEADER + "".join(rows))


def test_csv_names_snapshots_and_multi_line_fields(spark, tmp_path):
    row = '{0},s,"a ""quoted"" title","line one\n\nline, two",1675356031.0,2023-02-02T16:40:31,3,4,/p,/u\n'
    csv(tmp_path, "visa_buckets_999.csv", row.format("old"))
    csv(tmp_path, "visa_buckets_1000.csv", row.format("new1"), row.format("new2"))
    csv(tmp_path, "visa_stable_regret_0.csv")
    rows = readers.read_csv(spark, str(tmp_path / "visa_buckets_*.csv"))
    latest = readers.read_latest(spark, str(tmp_path / "visa_buckets_*.csv"))
    assert [f.rpartition("/")[2] for f in latest.inputFiles()] == ["visa_buckets_1000.csv"]  # the others are not even opened
    newest = latest.collect()
    assert sorted(r["id"] for r in newest) == ["new1", "new2"]  # by number, not by letters
    assert newest[0]["selftext"] == "line one\n\nline, two" and newest[0]["title"] == 'a "quoted" title'
    assert readers.read_csv(spark, str(tmp_path / "visa_stable_regret_0.csv")).count() == 0
    csv(tmp_path, "broken.csv", "not, a row")
    named = readers.read_named(spark, str(tmp_path / "*.csv"), lex.IMMIGRATION_FILE_WORDS)
    assert len(named.inputFiles()) == 3
    for missing in (lambda: readers.read_latest(spark, str(tmp_path / "none_*.csv")), lambda: readers.read_named(spark, str(tmp_path / "*.csv"), ["zzz"])):
        with pytest.raises(FileNotFoundError):
            missing()
    tagged = readers.with_source_and_domain(named, {"visa": "immigration"}).select("source_subreddit", "domain").distinct().collect()
    assert [(r[0], r[1]) for r in tagged] == [("visa", "immigration")]
    with pytest.raises(FileNotFoundError):
        readers.require(spark, [str(tmp_path / "absent.csv")])
    parsed = readers.parse_created(rows).select("post_year").distinct().collect()
    assert [r[0] for r in parsed] == [2023]


def test_listing_pages_keep_the_first_of_each_id(spark, tmp_path):
    def page(bucket, number, ids):
        folder = tmp_path / f"bucket={bucket}" / f"page={number}"
        folder.mkdir(parents=True)
        children = [{"kind": "t3", "data": {"id": i, "title": f"{bucket}{number}", "created_utc": 1416756348.0}} for i in ids]
        (folder / "x.json").write_text(json.dumps({"data": {"after": None, "children": children}}))

    page("new", 1, ["a", "b"])
    page("new", 2, ["b", None])
    page("top", 1, ["a", "c"])
    got = {r["id"]: (r["title"], r["selftext"], r["created_dt"]) for r in readers.read_landing(spark, str(tmp_path)).collect()}
    assert got == {"a": ("new1", "", "2014-11-23T15:25:48"), "b": ("new1", "", "2014-11-23T15:25:48"), "c": ("top1", "", "2014-11-23T15:25:48")}


def test_thread_features(spark):
    reply = {"data": {"children": [{"kind": "t1", "data": {"author": "op", "body": "we broke up"}}, {"kind": "t1", "data": {"author": "z", "body": "quit"}}]}}
    top = [
        {"kind": "t1", "data": {"author": "x", "body": "so sad", "replies": reply}},
        {"kind": "t1", "data": {"author": "op", "body": "I Resigned", "replies": ""}},
        {"kind": "t1", "data": {"author": "y", "body": "[deleted]", "replies": ""}},
        {"kind": "more", "data": {}},
    ]
    thread = [{"data": {"children": [{"data": {"author": "op", "upvote_ratio": .9, "title": "Update please"}}]}}, {"data": {"children": top}}]
    raw = spark.createDataFrame([("p", json.dumps(thread))], "id string, payload string")
    row = comments.thread_features(comments.parse_threads(raw)).first()
    assert (row["n_top_comments"], row["n_op_replies"], row["upvote_ratio"]) == (3, 2, .9)
    assert row["update_keywords_found"] == "broke up,resigned" and row["op_reply_preview"] == "we broke up"
    assert row["reversal_comment_score"] == pytest.approx(.9667) and row["comment_vader_mean"] < 0


def test_long_conversations_join_across_stretches(spark):
    said = ["we broke", "up and took", "the", "job", "x" * 200, "then we moved", "out"]
    turns = [(1, 2 * i, "user", t) for i, t in enumerate(said)] + [(1, 2 * i + 1, "assistant", "I quit") for i in range(7)]
    turns += [(2, 0, "assistant", "so sad"), (2, 1, "user", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for stretch in (4096, 4, 2):
        got = {r["id"]: r for r in comments.conversation_features(df, stretch=stretch).collect()}
        assert got[1]["update_keywords_found"] == "broke up,took the job,moved out"
        assert (got[1]["n_top_comments"], got[1]["n_op_replies"], got[1]["op_reply_preview"]) == (14, 7, "we broke")
        assert (got[2]["n_op_replies"], got[2]["op_reply_preview"], got[2]["reversal_comment_score"]) == (1, "", 0.0)


def test_layers_and_manifest(spark):
    folder = scratch_path(spark, "layers")
    writers.write_layer(spark.range(3), folder, "posts", 1)
    writers.write_layer(spark.range(5), folder, "posts", 2)
    assert writers.read_layer(spark, folder, "posts").count() == 5
    with pytest.raises(Exception):
        writers.write_layer(spark.range(1), folder, "posts", 2)
    assert cut_lineage(spark.range(4)).count() == 4


def test_publishing_nulls_and_chunks(spark, tmp_path):
    rows = [(str(i), float("nan") if i == 0 else float("inf") if i == 1 else 1.0, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "id string, vader_compound double, hidden int").repartition(1)
    out = writers.publishable(df)
    assert out.columns == ["id", "vader_compound"]
    target = str(tmp_path)

    def connect():
        import json
        import uuid

        def commit(batch):
            with open(f"{target}/{uuid.uuid4().hex}.json", "w") as f:
                json.dump(batch, f)
        return commit

    writers.upsert(out, connect)
    batches = [json.loads((tmp_path / f).read_text()) for f in os.listdir(tmp_path)]
    assert sorted(len(b) for b in batches) == [100, 450, 450]
    sent = {k: v for b in batches for k, v in b}
    assert len(sent) == 1000 and sent["0"]["vader_compound"] is None and sent["1"]["vader_compound"] is None


def test_stream_resumes_and_scores(spark, tmp_path):
    landing, out, progress = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress")
    schema = "doc_id long, text string, source string, n_chars long"
    spark.createDataFrame([(i, "x", "s", 1) for i in range(20)], schema).write.parquet(landing)

    def run():
        stream = streams.file_stream(spark, landing, spark.read.parquet(landing).schema)
        streams.run_available(streams.structured_posts(stream).select("id", "reversal"), out, progress)
        return spark.read.parquet(out).count()

    first = run()
    assert run() == first  # nothing new landed
    spark.createDataFrame([(i, "x", "s", 1) for i in range(20, 40)], schema).write.mode("append").parquet(landing)
    assert run() > first
    assert spark.read.parquet(out).select("id").distinct().count() == spark.read.parquet(out).count()


def test_stream_score_and_upsert(spark, tmp_path):
    landing, target = str(tmp_path / "in"), str(tmp_path / "store")
    os.makedirs(target)
    spark.createDataFrame([("a", "I quit"), ("b", "hello")], "id string, text string").write.parquet(landing)
    stream = streams.file_stream(spark, landing, "id string, text string")

    def connect():
        import uuid

        def commit(batch):
            for key, _ in batch:
                open(f"{target}/{key}", "w").write(uuid.uuid4().hex)
        return commit

    log = str(tmp_path / "log")
    streams.score_and_upsert(stream, "text", str(tmp_path / "progress"), connect, log_path=log).awaitTermination()
    assert sorted(os.listdir(target)) == ["a", "b"]
    assert spark.read.parquet(log).where("logged_at IS NOT NULL").count() == 2


def test_resume_and_column_order(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "id string, extra int, score int")
    assert relational.not_done(df, df.where("id = 'a'"), "id").select("id").collect()[0][0] == "b"
    assert relational.arrange(df, lex.MASTER_COLUMNS).columns == ["id", "score", "extra"]


def test_tfidf_rows_have_unit_length_and_topics_improve(spark):
    texts = [(i, " ".join(["apple pear plum", "iron steel zinc"][i % 2].split()[: 2 + i % 2]) + " common") for i in range(40)]
    df = spark.createDataFrame(texts, "id int, t string")
    weights = terms.tfidf(df, "id", tx.terms_and_bigrams("t"), 2, 50).persist()
    lengths = weights.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("l")).collect()
    assert all(r["l"] == pytest.approx(1) for r in lengths)
    rows, vocabulary = terms.tfidf_vectors(df, "id", tx.terms_and_bigrams("t"), 2, 50)
    model = topics.fit_nmf(rows, vocabulary, k=2, iterations=5)
    assert all(b <= a + 1e-9 for a, b in zip(model.losses, model.losses[1:]))
    found = {0: set(), 1: set()}
    for r in model.transform(rows, "id").collect():
        found[r["id"] % 2].add(r["topic"])
    assert found[0].isdisjoint(found[1])


def test_landing_keeps_every_line_and_refuses_trailing_text(spark, tmp_path):
    def listing(*ids):
        return json.dumps({"data": {"after": None, "children": [{"kind": "t3", "data": {"id": i, "created_utc": 1.0}} for i in ids]}})

    folder = tmp_path / "lines" / "bucket=new" / "page=1"
    folder.mkdir(parents=True)
    (folder / "x.json").write_text(listing("a", "b") + "\n" + listing("c", "d") + "\n")
    assert sorted(r["id"] for r in readers.read_landing(spark, str(tmp_path / "lines")).collect()) == ["a", "b", "c", "d"]
    whole = tmp_path / "whole" / "bucket=new" / "page=1"
    whole.mkdir(parents=True)
    (whole / "x.json").write_text(json.dumps(json.loads(listing("a", "b")), indent=1))
    assert sorted(r["id"] for r in readers.read_landing(spark, str(tmp_path / "whole"), whole_files=True).collect()) == ["a", "b"]
    (whole / "x.json").write_text(listing("a") + "\n" + listing("b"))
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_landing(spark, str(tmp_path / "whole"), whole_files=True).collect()


def test_streams_over_a_folder_table_give_open_windows(spark, tmp_path):
    from retroscope.plans import catalogue

    catalogue.load_all()

    rows = [(i, f"2024-01-0{1 + i % 3} 10:00:00", i % 2, "ab"[i % 2], float(i), "{}") for i in range(30)]
    events = spark.createDataFrame(rows, "event_id bigint, at string, user_id bigint, event_type string, value double, props string")
    events.select("event_id", F.col("at").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    found = {(r["window_start"], r["event_type"]): (r["rate"], r["n"]) for r in catalogue.QUERIES["stream_window_rates"](spark, str(tmp_path)).collect()}
    want = {}
    for _, at, _, kind, value, _ in rows:
        want.setdefault((at[:10], kind), []).append(value > 20)
    assert found == {k: (round(sum(v) / len(v), 6), len(v)) for k, v in want.items()}
    assert catalogue.QUERIES["stream_dedupe"](spark, str(tmp_path)).count() == 2


def test_a_missing_model_is_an_error(spark, tmp_path):
    from retroscope.plans import scoring

    assert scoring.load_model(None) is None
    assert scoring.load_model(str(tmp_path / "none"), spark, or_rules=True) is None
    with pytest.raises(FileNotFoundError):
        scoring.load_model(str(tmp_path / "none"), spark)


def test_a_long_lexicon_scores_rows_and_streams_alike(spark, tmp_path):
    from retroscope.operators import sentiment
    from retroscope.plans import scoring

    long = {**{f"word{i}": 0.1 for i in range(7500)}, **lex.DEMO_VALENCE}
    df = spark.createDataFrame([(1, "I regret it, not happy but word7"), (2, None), (3, "so very sad!!")], "id long, t string")
    short = {**lex.DEMO_VALENCE, "word7": 0.1}
    assert sentiment.inline_sentiment(df, "t", long).orderBy("id").collect() == sentiment.inline_sentiment(df, "t", short).orderBy("id").collect()
    df.write.parquet(f"{tmp_path}/in")
    scored = scoring.score(streams.file_stream(spark, f"{tmp_path}/in", df.schema), "t", lexicon=long)
    assert streams.stream_to_table(spark, scored, "long").count() == 3


def test_a_batch_is_handled_until_it_is_noted_and_then_no_more(spark, tmp_path):
    landing, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    spark.createDataFrame([(i,) for i in range(40)], "id long").repartition(4).write.parquet(landing)
    stream = streams.file_stream(spark, landing, "id long", files_per_trigger=1)
    notes, seen = writers.Ledger(spark, f"{progress}/ledger"), []

    def run(stops):
        def handle(batch, number):
            writers.put_batch(batch, str(tmp_path / "store"), number)
            seen.append(number)
            if stops == "before" and number == 1:
                raise RuntimeError("stopped")
            if stops == "after" and number == 2:
                notes.note(number)
                raise RuntimeError("stopped")

        streams.once_per_batch(stream, progress, handle).awaitTermination()

    for stops in ("before", "after"):
        with pytest.raises(Exception, match="stopped"):
            run(stops)
    run(None)
    assert seen == [0, 1, 1, 2, 3] and all(notes.holds(i) for i in range(4)) and not notes.holds(4)
    rows = spark.read.parquet(str(tmp_path / "store"))
    assert rows.count() == 40 and rows.select("id").distinct().count() == 40


def test_a_batch_of_one_file_is_scored_by_all_cores(spark, tmp_path):
    landing, log = str(tmp_path / "in"), str(tmp_path / "log")
    spark.createDataFrame([(str(i), f"I quit {i}") for i in range(400)], "id string, text string").coalesce(1).write.parquet(landing)
    stream = streams.file_stream(spark, landing, "id string, text string", files_per_trigger=1)
    streams.score_and_upsert(stream, "text", str(tmp_path / "progress"), log_path=log).awaitTermination()
    assert spark.read.parquet(log).select("id").distinct().count() == 400
    files = spark.read.parquet(log).select("_metadata.file_name").distinct().count()
    assert files >= spark.sparkContext.defaultParallelism


def test_spread_gives_more_tasks_to_more_splits(spark):
    """As many splits as cores is no reason to stay: a split is up to 128 MB, whose texts take over a minute."""
    from retroscope.sources import readers
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(1000)
    assert readers.spread(rows.repartition(1)).rdd.getNumPartitions() == 2 * cores
    assert readers.spread(rows.repartition(cores)).rdd.getNumPartitions() == 8 * cores
    assert readers.spread(rows.repartition(10 * cores)).rdd.getNumPartitions() == 80 * cores


def test_words_are_counted_once_for_all_rates(spark):
    rows = spark.createDataFrame([("d1", 1, "career", "t", "I regret it because we will see, maybe", 2020, 1, 2)],
                                 "id string, doc_id long, domain string, title string, selftext string, post_year int, num_comments int, score int")
    kept = rows.selectExpr("*", "lower(concat(title, '\n', selftext)) AS full_text", "'' AS regret_sentence", "false AS negated_regret",
                           "0 AS urgency_score", "0 AS reversal", "CAST(NULL AS bigint) AS time_to_regret_days")
    made = posts.enrich_posts(kept)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "_words" not in made.columns and plan.count("split(full_text") + plan.count("split(lower") <= 1
    row = made.first()
    assert row.social_embed_score >= 0 and row.future_orient_score > 0
