"""What travels through the large steps, and how they are cut."""

import datetime
import random
import time

from pyspark.sql import functions as F

from stakewatch import session
from stakewatch.operators import activity, grouping, history, prices, rankings, signals, total_order
from stakewatch.plans import normal, tables, web
from stakewatch.streaming import jobs
from test_semantics import signal_rows


def test_ranking_writes_only_what_it_shows(spark, monkeypatch):
    seen = []
    real = total_order.written
    monkeypatch.setattr(total_order, "written", lambda df, name: seen.append(set(df.columns)) or real(df, name))
    rows = signal_rows(spark)
    ranked = rankings.rank_discoveries(rows.withColumn("unshown", F.lit("x")))
    assert ranked.columns == rankings.RANKING_COLUMNS and ranked.count() > 0
    assert seen and not any("unshown" in columns for columns in seen)


def test_spread_out_keeps_null_entries_and_drops_empty_lists(spark):
    frame = spark.sql("SELECT * FROM VALUES (1, array('a', NULL)), (2, array()), (3, NULL) AS t(k, l)")
    assert sorted((r.k, r.e or "") for r in grouping.spread_out(frame, "l", "e").collect()) == [(1, ""), (1, "a")]


def test_documents_are_read_once_for_their_lots(spark, sf_dir):
    for run in (normal.src1_lots, normal.src1_terms):
        plan = run(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_xml") == 2  # the typed and the semi-structured reading


def test_short_tells_apart_what_padded_tells_apart(spark):
    numbers = [0, 7, -5, 12345678901, 12345678902, 1234567890, -1234567890123, None]
    frame = spark.createDataFrame([(n,) for n in numbers], "n bigint")
    rows = frame.select("n", tables.padded("n").alias("p"), tables.short("n").alias("s")).withColumn("again", tables.padded("s")).collect()
    assert all(r.p == r["again"] for r in rows)
    assert len({r.p for r in rows}) == len({r.s for r in rows})


def write_tables(spark, folder):
    day = datetime.datetime(2000, 1, 3)
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    write("customer", [(1, 2, "BUILDING"), (2, None, "BUILDING")], "c_custkey bigint, c_nationkey int, c_mktsegment string")
    write("orders", [(-5, 1, day, "5-LOW"), (12, 1, day, "1-URGENT"), (3, 1, day + datetime.timedelta(1), None), (4, 2, day, "")], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderpriority string")
    write("part", [(1, 2, "LARGE"), (2, None, "SMALL")], "p_partkey bigint, p_size int, p_type string")
    lines = [(12, 1, 9, 1, 10.0, 100.0, "N", "O", day), (-5, 2, 9, 1, 1.0, 5.0, None, None, day), (3, 1, 9, 1, 100.0, 1.0, "A", "F", day), (4, 1, 9, 1, 7.0, 1.0, "N", "O", day)]
    write("lineitem", lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp")


def test_lots_carry_codes_and_keep_the_order_of_padded_numbers(spark, tmp_path, monkeypatch):
    seen = []
    real = total_order.written
    monkeypatch.setattr(tables, "written", lambda df, name: seen.append(set(df.columns)) or real(df, name), raising=False)
    write_tables(spark, tmp_path)
    rows = {r.accession_number: r for r in tables.build_lots(spark, str(tmp_path)).collect()}
    assert {k: r.shares_owned_after for k, r in rows.items()} == {"00000000-5": 1.0, "0000000012": 11.0, "0000000003": 111.0}
    assert [rows["0000000012"][c] for c in ("transaction_code", "acquired_disposed_code", "direct_indirect_code", "is_amendment", "is_qualifying_purchase")] == ["P", "A", "D", False, True]
    assert [rows["00000000-5"][c] for c in ("transaction_code", "direct_indirect_code", "security_title", "is_non_derivative")] == ["F", "I", "SMALL", None]
    assert seen and not any(c in columns for columns in seen for c in ("issuer_cik", "accession_number", "transaction_code"))


def test_histories_carry_no_prices(spark, sf_dir):
    """The wide columns of a purchase join its signal, they do not pass through the windows of the histories."""
    held = set(tables.histories(spark, sf_dir).columns)
    assert "drawdown_52w" not in held and "event_id" in held
    assert {"drawdown_52w", "security_title", "conviction_score"} <= set(tables.signals(spark, sf_dir).columns)
    assert tables.signals(spark, sf_dir).count() == tables.priced_events(spark, sf_dir).count()


def test_partitions_grow_with_the_input(spark, sf_dir, monkeypatch):
    names = ["spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        assert session.input_bytes(spark, sf_dir) > 0 and session.input_bytes(spark, "/tmp/there-is-no-such-folder") == 0
        found = []
        for size in (0, 1 << 30, 6 << 30, 1 << 50):
            monkeypatch.setattr(session, "input_bytes", lambda s, d, size=size: size)
            session.size_partitions(spark, sf_dir)
            found.append(int(spark.conf.get(names[0])))
        assert found == [8, 256, 1536, 4096]
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_lots_send_flags_as_codes(spark, tmp_path, monkeypatch):
    seen = []
    real = total_order.written
    monkeypatch.setattr(tables, "written", lambda df, name: seen.append(set(df.columns)) or real(df, name))
    write_tables(spark, tmp_path)
    rows = {r.accession_number: r for r in tables.build_lots(spark, str(tmp_path)).collect()}
    assert seen and not any({"is_amendment", "is_non_derivative"} & columns for columns in seen)
    assert {k: (r.is_amendment, r.is_non_derivative) for k, r in rows.items()} == {"00000000-5": (True, None), "0000000012": (False, True), "0000000003": (None, True)}


def test_ranked_rows_are_written_once(spark, sf_dir):
    from pathlib import Path

    folder = Path(session.shared_folder(spark)) / "stakewatch"
    tables.signals(spark, sf_dir)
    tables._ranked.clear()
    before = {p.parent for p in folder.rglob("*.parquet")}
    ranked = tables.ranked(spark, sf_dir)
    assert ranked.columns == rankings.RANKING_COLUMNS and ranked.count() > 0
    kept = [p for p in {p.parent for p in folder.rglob("*.parquet")} - before if "stable_key" in spark.read.parquet(str(p)).columns]
    assert len(kept) == 1
    assert dict(spark.read.parquet(str(kept[0])).dtypes)["stable_key"] == "binary"
    twice = ranked.join(tables.ranked(spark, sf_dir), ["stable_key"])  # the same table read anew
    assert twice.count() == ranked.count()


def codec(path):
    import pyarrow.parquet as pq

    return {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in path.glob("*.parquet") if pq.ParquetFile(f).metadata.num_row_groups}


def test_tables_between_steps_shrink_the_digits_of_ids(spark, sf_dir):
    from pathlib import Path

    assert codec(Path(tables.events(spark, sf_dir).inputFiles()[0].removeprefix("file:")).parent) == {"ZSTD"}


def test_days_without_parts_give_the_same_history_and_send_rows_less_often(spark, sf_dir):
    events = tables.events(spark, sf_dir).select(*tables.HISTORY_COLUMNS)
    assert not history.has_large_days(events) and history.has_large_days(events, 0)
    whole, split = (history.with_daily_history(events, digits) for digits in (0, 2))
    exchanges = [frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for frame in (whole, split)]
    assert exchanges[0] <= exchanges[1] / 2
    columns = ["event_id", "sequence", "_priors", "_day_place", "purchase_count_90d", F.round("_sum_placed_logs", 6).alias("p"), F.round("_largest", 6).alias("l")]
    assert whole.select(*columns).exceptAll(split.select(*columns)).isEmpty() and whole.count() == split.count() == events.count()


def test_large_days_are_found_also_without_keys(spark):
    day = datetime.date(2020, 1, 1)
    rows = [("a", None, day)] * 3 + [("a", "b", day), ("a", "b", None)]
    events = spark.createDataFrame(rows, "issuer_cik string, insider_id string, transaction_date date")
    assert history.has_large_days(events, 2) and not history.has_large_days(events, 3)
    assert not history.has_large_days(events.limit(0), 0)


def test_buckets_miss_no_large_key(spark):
    frame = spark.createDataFrame([("a", 1)] * 5 + [("a", 2), (None, None)], "k string, n int")
    keys = [F.col("k"), F.col("n")]
    assert grouping.may_exceed(frame, keys, 4) and not grouping.may_exceed(frame, keys, 5)
    assert not grouping.may_exceed(frame.limit(0), keys, 0)


def test_holdings_by_line_and_by_day_are_the_same_and_by_line_sends_lots_once(spark):
    rng = random.Random(3)
    pick = lambda *values: rng.choice([*values, None])
    days = [datetime.date(2020, 1, d) for d in (1, 2, 3)]
    rows = [(rng.choice([1, 2, -12345678901, None]), pick(1, 2), rng.randrange(30), rng.randrange(4), pick(1, 2), pick(1.0, 2.0, 7.0), 1.0, pick(*days)) for _ in range(600)]
    facts = spark.createDataFrame(rows + rows[:50], "l_suppkey bigint, _buyer bigint, _filing bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, day date")
    line, day = (held(facts).select(*facts.columns, "_issuer", "shares_owned_after") for held in (tables.held_by_line, tables.held_by_day))
    assert line.count() == day.count() == sum(None not in (r[0], r[1], r[7]) for r in rows + rows[:50])
    assert line.exceptAll(day).isEmpty() and not line.filter("shares_owned_after is null").isEmpty()
    plans = [frame._jdf.queryExecution().executedPlan().toString().count("Exchange") for frame in (line, day)]
    assert plans[0] == 1 < plans[1]


def test_lots_of_a_large_holder_are_added_up_by_day(spark, sf_dir, monkeypatch):
    whole = tables.build_lots(spark, sf_dir).collect()
    monkeypatch.setattr(tables, "HOLDER_ROWS", 1)
    monkeypatch.setattr(tables, "held_by_line", None)
    assert sorted(map(str, tables.build_lots(spark, sf_dir).collect())) == sorted(map(str, whole))


def test_companies_of_daily_rows_need_no_ranking(spark, sf_dir, monkeypatch):
    tables.signals(spark, sf_dir)
    monkeypatch.setattr(tables, "ranked", None)
    for run in (web.j10, web.j10_keep):
        assert run(spark, sf_dir).count() > 0


def test_clusters_read_purchases_once(spark, sf_dir):
    clusters = signals.buyer_clusters(tables.histories(spark, sf_dir))
    assert clusters._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1


def test_writes_leave_no_shuffle_files(spark, sf_dir, monkeypatch):
    jobs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {str(f) for f in jobs.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    before = files()
    assert len(total_order.written(rows, "let-go").collect()) == 7
    monkeypatch.setattr(tables, "_written", {})
    assert len(tables.stage(spark, sf_dir, "let-go", lambda s, d: rows).collect()) == 7
    kept = spark.conf.get(session.CLEANUP, "false")
    for _ in range(50):  # files go in the background
        left = {f for f in files() - before if f.endswith(".data")}
        if not left:
            break
        time.sleep(0.1)
    assert kept == "false" and not left


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_histories_by_person_are_the_same_and_purchases_stay_dealt_out(spark, sf_dir):
    whole, dealt = tables.build_histories(spark, sf_dir), tables.histories_by_person(spark, sf_dir)
    assert whole.columns == dealt.columns and whole.count() == dealt.count() > 0
    figures = [F.round(c, 6).alias(c) if kind == "double" else c for c, kind in whole.dtypes]
    assert whole.select(*figures).exceptAll(dealt.select(*figures)).isEmpty()
    with session.for_writing(spark, **{session.DEAL_AGAIN: "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        assert plan_of(tables.histories_by_person(spark, sf_dir)).count("Exchange hashpartitioning") == 2


def test_large_persons_take_the_written_days(spark, sf_dir, monkeypatch):
    purchases = tables.events(spark, sf_dir)
    monkeypatch.setattr(tables, "_written", {})
    monkeypatch.setattr(tables, "events", lambda s, d: purchases)
    monkeypatch.setattr(tables, "stage", lambda s, d, name, build, settings=None: (build, settings))
    assert tables.histories(spark, sf_dir) == (tables.histories_by_person, {session.DEAL_AGAIN: "false"})
    monkeypatch.setattr(tables.params, "ARRAY_GROUP_LIMIT", 0)
    assert tables.histories(spark, sf_dir) == (tables.build_histories, None)


def test_only_sessions_that_are_asked_for_are_sent_on(spark):
    day = lambda n: None if n is None else datetime.date(2020, 1, n)
    lines = [(t, day(n), 1.0) for t, n in (("A", 2), ("A", 4), ("A", 6), ("A", 6), ("A", 9), ("A", None), ("B", 5), (None, 3))]
    asked = [(t, day(n)) for t, n in (("A", 3), ("A", 4), ("A", 5), ("A", 20), ("A", None), ("C", 1), ("B", 6))]
    sessions = spark.createDataFrame(lines, "ticker string, date date, close double")
    found = prices.with_asked_for(sessions, spark.createDataFrame(asked, "ticker string, day date")).collect()
    assert len(found) == len(lines)
    assert sorted((r.ticker, r.date.day) for r in found if r._asked_for and r.date) == [("A", 4), ("A", 6)]


def test_only_ids_meet_the_clusters(spark, sf_dir):
    found, bought = tables.histories(spark, sf_dir), tables.priced_events(spark, sf_dir)
    with session.for_writing(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = plan_of(signals.score_histories(found, tables.company_context(spark, sf_dir), bought))
    assert plan.count("Exchange hashpartitioning(event_id") == 3  # histories, purchases, ids with their clusters
    day = ["issuer_cik", "transaction_date"]
    clusters = found.select("event_id", *day).join(signals.buyer_clusters(found), day).select("event_id", "cluster_score", "unique_buyers")
    assert clusters.exceptAll(tables.signals(spark, sf_dir).select(*clusters.columns)).isEmpty()


def test_stored_rows_hold_no_column_twice(spark, sf_dir, monkeypatch):
    seen = {}
    real = total_order.written
    monkeypatch.setattr(total_order, "written", lambda df, name: seen.setdefault(name, df) and real(df, name))
    ranked = rankings.rank_discoveries(tables.signals(spark, sf_dir), digits=("stable_key", "event_id"))
    assert "headline" not in seen["rank"].columns and dict(seen["rank"].dtypes)["event_id"] == "binary"
    plain = rankings.discovery_rows(tables.signals(spark, sf_dir)).select("event_id", "ranking_category", "headline", "stable_key")
    assert ranked.select(*plain.columns).exceptAll(plain).isEmpty() and ranked.count() == plain.count()
    stored = lambda name: set(spark.read.parquet(tables._written[(spark.sparkContext.applicationId, sf_dir, name)]).columns)
    assert not stored("signals") & set(signals.TOLD) and set(signals.TOLD) <= set(tables.signals(spark, sf_dir).columns)
    tables.prices(spark, sf_dir)
    assert stored("prices") == {"ticker", "date", "low", "high", "volume"}


def test_texts_of_a_company_are_read_once(spark, monkeypatch):
    seen = []
    real = activity.resolve_company
    monkeypatch.setattr(activity, "resolve_company", lambda rows, companies, **named: seen.extend(companies.columns) or real(rows, companies, **named))
    day = datetime.date(2020, 1, 2)
    known = [("1", "aa", " Acme ", "nan", " Mining", 1.0, "aa"), ("2", "bb", "None", "EUROPE", "", 1.0, "bb"), ("3", "n/a", "Hidden", "ASIA", "x", 1.0, "c")]
    companies = spark.createDataFrame(known, "issuer_cik string, ticker string, company_name string, sector string, industry string, market_cap double, slug string")
    schema = "event_id string, filing_date date, transaction_date date, ticker string, issuer_cik string, company_name string, sector string, industry string, owner_cik string, owner_name string, purchase_value double, buyer_count int, conviction_score double, behavior_change_score double, cluster_score double, silence_break_score double, days_since_previous_purchase int, headline string, ranking_category string"
    rest = (5.0, 1, 1.0, 1.0, 1.0, 1.0, 1, "", "")
    rows = [("a", day, None, "zz", "1", "Other", " NULL ", "Own", " 7 ", "Who", *rest), ("b", day, day, "bb", "", "undefined", "ASIA", "Own", "nan", " Who ", *rest), ("c", day, day, "zz", "3", "x", "x", "x", "7", "", *rest)]
    daily = spark.createDataFrame(rows, schema)
    found = activity.activity_events(daily, daily.limit(0).withColumn("rank", F.lit(1)), companies)
    got = {tuple(r) for r in found.select("issuer_cik", "ticker", "company_name", "sector", "industry", "owner_cik", "owner_name", "transaction_date").collect()}
    assert got == {("1", "AA", "Acme", "", "Mining", "7", "Who", day), ("2", "BB", "BB", "EUROPE", "Own", "", "Who", day)}
    assert seen and all(f"_{c}" in seen for c in activity.COMPANY_TEXTS)


def test_histories_of_rankings_send_only_what_they_show(spark, sf_dir):
    latest = spark.createDataFrame([("c", i, f"k{i % 7}", 1.0) for i in range(20)] * 2, "ranking_category string, rank int, stable_key string, ranking_score double")
    history = rankings.snapshot_keys(latest.filter("rank < 3"))
    whole, narrow = rankings.append_history(history, latest), rankings.append_history(history, latest, ["ranking_category", "rank"])
    assert narrow.columns == ["snapshot_key", "ranking_category", "rank"] and narrow.count() == 17
    assert whole.select(*narrow.columns).exceptAll(narrow).isEmpty() and "stable_key" in whole.columns
    stream = spark.readStream.format("rate").load().selectExpr("'c' ranking_category", "CAST(value AS INT) rank", "'k' stable_key", "1D ranking_score", "timestamp")
    assert jobs.new_rankings(stream, history, "timestamp", shown=["rank"]).columns == ["snapshot_key", "rank"]
    assert "stable_key" in jobs.new_rankings(stream, history, "timestamp").columns


def test_trailing_figures_share_the_order_of_the_rows(spark, sf_dir):
    """Five frames of blocks: each sorts twice, and the last columns and their first numbers share what is left."""
    plan = plan_of(prices.session_context(tables.prices(spark, sf_dir)))
    assert plan.count("Sort [") <= 13 and plan.count("Exchange hashpartitioning") == 1
