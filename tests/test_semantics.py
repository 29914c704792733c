"""Small cases with known answers."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from stakewatch import params
from stakewatch.functions import dates, identity, numeric, text
from stakewatch.functions.roles import roles_from_title
from stakewatch.operators import events, normalize, prices, quality, rankings, signals, stories
from stakewatch.operators.evidence import mid_ranks
from stakewatch.operators.grouping import exact_median, mark_copies, rank_rows
from stakewatch.operators.history import with_daily_history
from stakewatch.operators.total_order import value_positions
from stakewatch.sources import filings, indexes


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return row.select(expression.alias("out")).first()["out"]


def lots(spark):
    base = dict(
        issuer_cik="1", owner_cik="2", insider_id="2", ticker="ABC", transaction_date=date(2020, 1, 1), filing_date=date(2020, 1, 2),
        security_title="Common", direct_indirect_code="D", accession_number="a", footnotes="", quality="high", is_qualifying_purchase=True,
    )
    return spark.createDataFrame(
        [
            dict(base, shares=10.0, reported_value=100.0, shares_owned_after=10.0, normalized_roles=["ceo", "director"]),
            dict(base, shares=5.0, reported_value=60.0, shares_owned_after=15.0, normalized_roles=["ceo"]),
        ]
    )


def purchases(spark, rows):
    """(event_id, day, value) rows of one person in one issuer, with what the jobs need besides."""
    return spark.createDataFrame(
        [("1", "2", e, d, float(v), 10.0) for e, d, v in rows],
        "issuer_cik string, insider_id string, event_id string, transaction_date date, purchase_value double, ownership_increase_percent double",
    )


def histories(events):
    """Full histories by the arrays; the way for large groups has its own tests."""
    return signals.complete_histories(with_daily_history(events), False)


def test_lots_become_one_event(spark):
    row = events.purchase_events(lots(spark)).first()
    assert (row.lot_count, row.purchase_value, row.total_shares) == (2, 160.0, 15.0)
    assert row.normalized_roles == ["ceo", "director"]
    assert row.ownership_increase_percent == 100.0 and row.first_reported_position


def test_campaign_of_two(spark):
    first = events.purchase_events(lots(spark))
    second = first.withColumn("event_id", F.lit("x")).withColumn("transaction_date", F.lit(date(2020, 1, 3)))
    assert events.purchase_campaigns(first.unionByName(second), 5).first().event_count == 2
    late = second.withColumn("transaction_date", F.lit(date(2020, 1, 20)))
    assert events.purchase_campaigns(first.unionByName(late), 5).count() == 2


@pytest.mark.parametrize("acquired,after,percent", [(10.0, 10.0, 100.0), (10.0, 20.0, 100.0), (10.0, 5.0, None), (0.0, 0.0, 0.0)])
def test_ownership(spark, acquired, after, percent):
    columns = events.ownership_columns(F.col("a"), F.col("b"), F.lit("I"))
    assert one(spark, columns["ownership_increase_percent"], a=acquired, b=after) == percent
    assert one(spark, columns["ambiguous_ownership"], a=acquired, b=after) is False


def test_weekday_gap_skips_weekends(spark):
    frame = spark.createDataFrame(
        [(date(2020, 1, 3), date(2020, 1, 6), 1), (date(2020, 1, 1), date(2020, 1, 1), 0), (date(2020, 1, 4), date(2020, 1, 4), -1)],
        "a date, b date, want int",
    )
    assert all(r.got == r.want for r in frame.withColumn("got", dates.weekday_gap(F.col("a"), F.col("b"))).collect())


def test_split_factor_after_a_day(spark):
    table = spark.createDataFrame([("T", date(2020, 1, 1), 0.0), ("T", date(2021, 1, 1), 2.0)], "ticker string, date date, stock_splits double")
    days = spark.createDataFrame([("T", date(2020, 1, 1)), ("T", date(2021, 1, 1))], "ticker string, day date")
    got = {r.day: r.split_factor_after_event for r in prices.later_split_factor(days, table).collect()}
    assert got == {date(2020, 1, 1): 2.0, date(2021, 1, 1): 1.0}


def test_history_depth_and_no_look_ahead(spark):
    rows = [(str(i), date(2020, 1, i + 1), 100 + i) for i in range(9)]
    got = {r.event_id: r for r in histories(purchases(spark, rows)).collect()}
    assert [got[i].history_depth for i in ("0", "2", "8")] == ["no_history", "sparse", "deep"]
    assert got["0"].prior_purchase_count == 0 and got["1"].prior_median_purchase_value == 100.0
    # Dropping everything later changes nothing earlier.
    cut = {r.event_id: r for r in histories(purchases(spark, rows[:5])).collect()}
    for event_id, row in cut.items():
        for name in row.asDict():
            if name not in ("group_size", "_first_gap"):
                assert row[name] == got[event_id][name], name


def test_same_day_purchases_count_by_position_only(spark):
    rows = [("a", date(2020, 1, 1), 100), ("b", date(2020, 1, 1), 300), ("c", date(2020, 2, 1), 200)]
    got = {r.event_id: r for r in histories(purchases(spark, rows)).withColumns(signals.abnormality_columns()).collect()}
    assert got["b"].prior_purchase_count == 0 and got["b"].purchase_multiple == 3.0
    assert got["c"].prior_purchase_count == 2 and got["c"].median_prior_gap_days == 0.0
    assert got["b"].purchase_value_90d == 400.0 and got["b"].purchase_count_90d == 2


def test_ten_times_the_median(spark):
    rows = [(str(i), date(2020, 1, i + 1), 100) for i in range(3)] + [("z", date(2020, 3, 1), 1000)]
    got = histories(purchases(spark, rows)).withColumns(signals.abnormality_columns()).filter("event_id = 'z'").first()
    assert got.purchase_multiple == 10.0 and got.robust_z == 10.0 and got.abnormality_quality == "high"


def test_silence_after_five_years(spark):
    columns = signals.silence_columns(F.lit(1825), F.lit(365.0), F.lit(False))
    assert one(spark, columns["silence_break_score"]) > 80
    unknown = signals.silence_columns(F.lit(None).cast("int"), F.lit(365.0), F.lit(False))
    assert one(spark, unknown["silence_break_score"]) == 0.0


def test_acceleration_needs_three(spark):
    rows = [(str(i), date(2020, i + 1, 1), v) for i, v in enumerate([100, 200, 500])]
    scored = with_daily_history(purchases(spark, rows)).withColumns(signals.acceleration_columns())
    got = {r.event_id: r for r in scored.collect()}
    assert got["0"].acceleration_score == 0.0 and got["1"].acceleration_score == 0.0
    assert got["2"].acceleration_quality == "high" and got["2"].acceleration_score > 50


def test_cluster_counts_people_once_with_their_newest_roles(spark):
    table = spark.createDataFrame(
        [
            ("1", "a", "e1", date(2020, 1, 1), 1.0, ["director"]), ("1", "a", "e2", date(2020, 1, 5), 1.0, ["ceo"]),
            ("1", "b", "e3", date(2020, 1, 6), 1.0, ["cfo"]), ("1", "c", "e4", date(2020, 1, 25), 1.0, ["director"]),
        ],
        "issuer_cik string, insider_id string, event_id string, transaction_date date, purchase_value double, normalized_roles array<string>",
    )
    got = {r.transaction_date: r for r in signals.buyer_clusters(table).collect()}
    assert got[date(2020, 1, 1)].unique_operating_executives == 0
    row = got[date(2020, 1, 6)]
    assert (row.unique_buyers, row.unique_operating_executives, row.ceo_present, row.cluster_purchase_value) == (2, 2, True, 3.0)
    assert got[date(2020, 1, 25)].unique_buyers == 1


def test_penalties_are_visible(spark):
    row = spark.createDataFrame([(80.0, 100000.0, 10.0, 50.0, 90.0, "I", False, "high", ["indirect_only", "microcap_or_illiquid"])],
        "behavior_change_score double, purchase_value double, ownership_increase_percent double, cluster_score double, role_score double,"
        " direct_indirect_code string, discovery_eligible boolean, event_quality string, reason_codes array<string>")
    got = row.select(signals.conviction_columns()["conviction_penalties"].alias("p")).first().p
    assert set(got) == {"indirect_only", "microcap_or_illiquid"}


def signal_rows(spark):
    columns = (
        "event_id string, issuer_cik string, insider_id string, ticker string, company_name string, sector string, industry string, purchase_value double,"
        " purchase_multiple double, first_ever_purchase boolean, historical_percentile double, robust_z_display double, abnormality_score double,"
        " silence_break_score double, cluster_score double, behavior_change_score double, conviction_score double, history_depth string, history_quality string,"
        " days_since_previous_purchase int, ownership_increase_percent double, normalized_roles array<string>, unique_buyers int,"
        " unique_operating_executives int, drawdown_52w double, discovery_eligible boolean, market_cap double, transaction_date date, filing_date date,"
        " accession_number string, acceleration_score double, acceleration_sample_count int, direct_indirect_code string, reason_codes array<string>"
    )
    return spark.createDataFrame(
        [
            ("e1", "1", "a", "AAA", "A", "Tech", "", 1e5, 10.0, False, 99.0, 5.0, 95.0, 80.0, 70.0, 90.0, 88.0, "usable", "high", 1826, 20.0,
             ["ceo", "operating_executive"], 2, 2, -0.3, True, 5e8, date(2026, 1, 1), date(2026, 1, 3), "x", 80.0, 3, "D", []),
            ("e2", "2", "b", "BBB", "B", "Health", "", 5e4, None, True, None, None, 60.0, 40.0, 0.0, 65.0, 60.0, "no_history", "limited", None, 5.0,
             ["founder"], 1, None, -0.05, True, 2e9, date(2026, 1, 2), date(2026, 1, 4), "y", None, None, "D", []),
        ],
        columns,
    )


def test_rankings(spark):
    ranked = rankings.rank_discoveries(signal_rows(spark)).collect()
    of = lambda name: [r for r in sorted(ranked, key=lambda r: r["rank"]) if r.ranking_category == name]
    assert [r.ticker for r in of("breaking_habits")] == ["AAA", "BBB"]
    assert of("breaking_habits")[0].headline == "CEO purchase was 10.0× larger than prior median"
    assert of("wolf_packs")[0].buyer_count == 2
    assert [r.ticker for r in of("contrarian")] == ["AAA"]
    assert of("under_the_radar")[0].ticker == "AAA"
    assert of("quiet_buyers")[0].headline == "First open-market purchase in 5.0 years"


def test_history_takes_a_snapshot_once(spark):
    latest = rankings.rank_discoveries(signal_rows(spark))
    first = rankings.append_history(rankings.snapshot_keys(latest).limit(0), latest)
    assert first.count() == latest.count()
    assert rankings.append_history(first, latest).count() == 0


def test_roles(spark):
    found = one(spark, roles_from_title(F.lit("Founder, President and CEO"), F.lit(True), None, F.lit(True)))
    assert {"founder", "president", "ceo", "operating_executive", "director"} <= set(found)
    assert one(spark, roles_from_title(F.lit("Vice President"), None, None, F.lit(True))) == ["other_officer"]


@pytest.mark.parametrize("raw,want", [("BRK.B", "BRK-B"), ("(abc)", "ABC"), ("N/A", ""), ("12345", ""), (" $xyz ", "XYZ")])
def test_price_symbols(spark, raw, want):
    assert one(spark, text.price_symbol(F.col("s")), s=raw) == want


def test_names_ids_and_versions(spark):
    assert one(spark, text.clean_name(F.lit("  o'neil-smith,  JOHN\n j."))) == "O'Neil-Smith John J."
    import hashlib
    import json

    want = hashlib.sha256(json.dumps(["a", "ü/\"b"], separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:24]
    assert one(spark, identity.stable_id(F.lit("a"), F.lit("ü/\"b"))) == want
    assert one(spark, identity.version_readable(F.lit("v1.2"), F.lit("v1.1"))) is True
    assert one(spark, identity.version_readable(F.lit("v1"), F.lit("v1.1"))) is False
    assert one(spark, identity.version_part(F.lit("v01"), 1)) is None


@pytest.mark.parametrize("value,want", [(1250.0, "$1.3K"), (999.4, "$999"), (2_000_000.0, "$2M"), (-1500.0, "-$1.5K")])
def test_feed_currency(spark, value, want):
    assert one(spark, numeric.feed_currency(F.lit(value))) == want


def test_submission_text(spark):
    inside = "<SEC><XML>junk</XML><xml>\n<ownershipDocument>x</ownershipDocument>\n</xml></SEC>"
    assert one(spark, filings.extract_block(F.lit(inside), "XML", "ownershipDocument")) == "<ownershipDocument>x</ownershipDocument>"
    bare = 'head <?xml version="1.0"?><ownershipDocument>y</ownershipDocument> tail'
    assert one(spark, filings.extract_block(F.lit(bare), "XML", "ownershipDocument")) == '<?xml version="1.0"?><ownershipDocument>y</ownershipDocument>'
    assert one(spark, filings.extract_block(F.lit("nothing"), "XML", "ownershipDocument")) is None


def test_index_lines(spark):
    lines = ["Description: x", "CIK|Company Name|Form Type|Date Filed|Filename", "-----", "123|A Co|4|2026-01-02|edgar/data/123/0000000001-26-000001.txt",
             "124|B Co|10-K|2026-01-02|edgar/data/124/x.txt"]
    got = indexes.parse_index_lines(spark.createDataFrame([(v,) for v in lines], "value string")).collect()
    assert [(r.issuer_cik, r.accession_number) for r in got] == [("0000000123", "0000000001-26-000001")]


def test_document_and_amendment(spark):
    def document(form, shares):
        return (
            f"<ownershipDocument><documentType>{form}</documentType><issuer><issuerCik>7</issuerCik><issuerName>N</issuerName><issuerTradingSymbol>T</issuerTradingSymbol></issuer>"
            "<reportingOwner><reportingOwnerId><rptOwnerCik>9</rptOwnerCik><rptOwnerName>Doe, Jane</rptOwnerName></reportingOwnerId></reportingOwner>"
            "<nonDerivativeTable><nonDerivativeTransaction><securityTitle><value>Common</value></securityTitle><transactionDate><value>2026-01-01</value></transactionDate>"
            "<transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts>"
            f"<transactionShares><value>{shares}</value></transactionShares><transactionPricePerShare><value>2</value></transactionPricePerShare>"
            "<transactionAcquiredDisposedCode><value>A</value></transactionAcquiredDisposedCode></transactionAmounts>"
            "<ownershipNature><directOrIndirectOwnership><value>D</value></directOrIndirectOwnership></ownershipNature></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"
        )

    docs = spark.createDataFrame(
        [(document("4", 5), "a1", "2026-01-02", "p1"), (document("4/A", 6), "a2", "2026-01-09", "p2"), ("<ownershipDocument><issuer>", "a3", "2026-01-09", "p3")],
        "xml string, accession_number string, filing_date string, path string",
    )
    parsed = filings.parse_documents(docs)
    assert {r.accession_number: r.status for r in normalize.filing_rows(parsed).collect()} == {"a1": "active", "a2": "active", "a3": "unusable"}
    rows = normalize.mark_superseded(normalize.lot_rows(parsed).withColumn("status", F.lit("active"))).collect()
    assert {r.accession_number: r.status for r in rows} == {"a1": "superseded", "a2": "active"}
    assert all(r.is_qualifying_purchase and r.insider_id == "0000000009" for r in rows)


def test_filing_and_transaction_checks(spark):
    good = spark.createDataFrame([("f", "0000000001-26-000001", "0000000001", "4", "2026-01-02")], "filing_id string, accession_number string, issuer_cik string, form_type string, filing_date string")
    assert quality.check_filings(good).first().quality == "high"
    bad = spark.createDataFrame(
        [("t", "P", "A", "2026-01-01", "2026-01-02", True, False, 1.0, 1.0, 1.0, 1.0)],
        "transaction_id string, transaction_code string, acquired_disposed_code string, transaction_date string, filing_date string, is_qualifying_purchase boolean,"
        " is_non_derivative boolean, shares double, price_per_share double, reported_value double, shares_owned_after double",
    )
    row = quality.check_transactions(bad).first()
    assert row.quality == "unusable" and row.errors == "derivative_misclassified"


def test_contract_stops_the_job(spark):
    table = spark.createDataFrame([("a", ""), ("b", "x")], "issuer_cik string, issuer_name string")
    with pytest.raises(Exception, match="required field"):
        quality.require_contract(table, ["issuer_name"], "issuers").collect()
    assert quality.require_contract(table.filter("issuer_name <> ''"), ["issuer_name"], "issuers").count() == 1
    assert len(quality.REQUIRED_FIELDS) == 15


def test_parameter_weights(spark):
    groups = {"behavior": params.BEHAVIOR_WEIGHTS, "conviction": params.CONVICTION_WEIGHTS, "evidence": params.EVIDENCE_WEIGHTS}
    rows = [(g, n, w) for g, members in groups.items() for n, w in members.items()]
    table = spark.createDataFrame(rows, "weight_group string, name string, weight double")
    assert all(r.valid for r in quality.check_weights(table).collect())
    bounds = spark.createDataFrame([("market_cap", params.ELIGIBILITY["market_cap_min"], params.ELIGIBILITY["market_cap_max"])], "name string, low double, high double")
    assert quality.check_thresholds(bounds).first().valid


def test_story_of_three_hundred_sessions(spark):
    from datetime import timedelta

    days, day = [], date(2025, 1, 1)
    while len(days) < 300:
        if day.weekday() < 5:
            days.append(day)
        day += timedelta(days=1)
    table = spark.createDataFrame(
        [("T", d, 10 + 0.02 * i, 10 + 0.02 * i, 1000.0) for i, d in enumerate(days)], "ticker string, date date, close double, adj_close double, volume double"
    )
    bought = spark.createDataFrame(
        [("e1", "T", days[50], "1", "1", 1000.0, 100.0, 10.0, 1.0), ("e2", "T", days[200], "2", "2", 2200.0, 200.0, 11.0, 2.0)],
        "event_id string, ticker string, transaction_date date, owner_cik string, insider_id string, purchase_value double, total_shares double, weighted_average_price double, conviction_score double",
    )
    firms = spark.createDataFrame([("1", "T", "Firm", "S", "I"), ("2", "U", "Other", "S", "I")], "issuer_cik string, ticker string, company_name string, sector string, industry string")
    sessions = prices.usable_sessions(table)
    got = {r.ticker: r for r in stories.company_stories(firms, sessions, bought).collect()}
    assert len(got["T"].price_path) <= 260 and len(got["T"].purchase_markers) == 2
    assert round(got["T"].summary.average_reported_purchase_price, 6) == round(3200 / 300, 6)
    assert got["U"].price_available is False and got["U"].price_unavailable_reason == "missing_or_unusable_price_history"


# --- groups that hold most of the rows --------------------------------------------------------------------------

def test_copies_are_marked_once(spark):
    rows = [("hot", 1)] * 500 + [("hot", 2)] * 3 + [("cold", 5), ("cold", 4)]
    marked = mark_copies(spark.createDataFrame(rows, "k string, v int"), ["k"], ["v"])
    assert marked.count() == len(rows)
    kept = marked.filter("not is_copy").collect()
    assert sorted((r.k, r.v) for r in kept) == [("cold", 4), ("hot", 1)]


def test_positions_ranks_and_medians_match_brute_force(spark):
    import random
    from statistics import median

    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}", rng.choice([31.0, rng.random() * 100]), float(rng.randrange(4)), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k string, v double, w double, i int")
    by_key = {}
    for k, v, w, i in rows:
        by_key.setdefault(k, []).append((v, w, i))
    for r in value_positions(frame, ["k"], ["v"]).collect():
        values = [v for v, _, _ in by_key[r.k]]
        assert (r.n_equal, r.n_below, r.n_total) == (values.count(r.v), sum(x < r.v for x in values), len(values))
    assert {r.k: r.m for r in exact_median(frame, ["k"], "v", "m").collect()} == {k: median(v for v, _, _ in x) for k, x in by_key.items()}
    ranked = {r.i: r["rank"] for r in rank_rows(frame, ["k"], [F.col("v"), F.col("w")], [F.col("i")]).collect()}
    for group in by_key.values():
        for place, (_, _, i) in enumerate(sorted(group, key=lambda x: (-x[0], -x[1], x[2])), start=1):
            assert ranked[i] == place


def test_missing_scores_come_last(spark):
    rows = [("a", 1.0, 0), ("a", None, 1), ("a", 5.0, 2), ("a", None, 3), ("b", None, 4)]
    frame = spark.createDataFrame(rows, "k string, v double, i int")
    ranked = {r.i: r["rank"] for r in rank_rows(frame, ["k"], [F.col("v")], [F.col("i")]).collect()}
    assert ranked == {2: 1, 0: 2, 1: 3, 3: 4, 4: 1}
    assert {r.i: r.p for r in mid_ranks(frame, {"p": ("v", False)}).collect()}.keys() == set(range(5))


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from stakewatch.session import shared_folder

    unset = SimpleNamespace(get=lambda name, default=None: default)
    context = SimpleNamespace(master="local-cluster[2,1,1024]", applicationId="x", getConf=lambda: unset)
    with pytest.raises(ValueError):
        shared_folder(SimpleNamespace(conf=unset, sparkContext=context))


def test_blocked_statistics_equal_the_arrays(spark):
    """A person with a day that holds a third of the purchases, many equal, zero, negative and missing values, and missing ownership."""
    import random
    from datetime import timedelta

    from stakewatch.operators.blocked import blocked_statistics
    from stakewatch.operators.ordered_statistics import STATISTICS, array_statistics

    rng, rows = random.Random(3), []
    for group, count in (("1", 170), ("2", 60)):
        for i in range(count):
            day = date(2020, 1, 1) + timedelta(days=5 if rng.random() < 0.33 else rng.randrange(120))
            value = rng.choice([100.0, 100.0, None, 0.0, -0.25, round(rng.random() * 1000, 2) + 0.01, round(10 ** (rng.random() * 6), 2) + 0.01])
            rows.append((group, "p", f"e{i:05d}", day, value, rng.choice([None, rng.random() * 100])))
    table = spark.createDataFrame(
        rows, "issuer_cik string, insider_id string, event_id string, transaction_date date, purchase_value double, ownership_increase_percent double"
    )
    placed = with_daily_history(table)
    want = {(r.issuer_cik, r.sequence): r for r in array_statistics(placed).collect()}
    got = {(r.issuer_cik, r.sequence): r for r in blocked_statistics(placed, block_rows=16, ranges=12).collect()}
    assert want.keys() == got.keys()
    for key, row in want.items():
        for name in STATISTICS:
            assert got[key][name] == pytest.approx(row[name], abs=1e-9), (key, name)


def test_large_and_small_groups_together(spark):
    from stakewatch.operators.ordered_statistics import STATISTICS, array_statistics, has_large_groups, with_prior_statistics

    rows = [(f"e{i:03d}", date(2020, 1 + i % 12, 1 + i % 28), 50 + (i * 37) % 91) for i in range(40)]
    other = purchases(spark, rows[:6]).withColumn("insider_id", F.lit("3"))
    placed = with_daily_history(purchases(spark, rows).unionByName(other))
    assert has_large_groups(placed, 10) and not has_large_groups(placed, 40)
    want = {(r.insider_id, r.sequence): r for r in array_statistics(placed).collect()}
    got = {(r.insider_id, r.sequence): r for r in with_prior_statistics(placed, limit=10).collect()}
    assert want.keys() == got.keys()
    assert all(got[k][n] == pytest.approx(want[k][n], abs=1e-9) for k in want for n in STATISTICS)


def test_a_split_day_gives_the_same_positions(spark):
    import hashlib

    days = [date(2020, 1, 1)] * 60 + [date(2020, 1, 1 + i % 9) for i in range(30)]
    rows = [(hashlib.sha256(str(i).encode()).hexdigest()[:24], d, 10 + (i * 37) % 91) for i, d in enumerate(days)]
    table = purchases(spark, rows)
    whole = {r.event_id: r.asDict() for r in with_daily_history(table, digits=0).collect()}
    split = {r.event_id: r.asDict() for r in with_daily_history(table, digits=2).collect()}
    assert whole.keys() == split.keys()
    for key, row in whole.items():
        for name, value in row.items():
            assert split[key][name] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), name


def test_trailing_highest_is_that_of_the_frame(spark):
    import random

    rng = random.Random(5)
    rows = [(t, n, rng.choice([None, rng.random()])) for t in ("A", "B") for n in range(1, 40 if t == "A" else 4)]
    frame = spark.createDataFrame(rows, "ticker string, _n int, high double")
    got = prices.with_trailing_highest(frame, "high", {"h3": 3, "h10": 10}).collect()
    values = {(t, n): v for t, n, v in rows}
    for row in got:
        for name, size in (("h3", 3), ("h10", 10)):
            known = [v for n in range(row["_n"] - size + 1, row["_n"] + 1) if (v := values.get((row.ticker, n))) is not None]
            assert row[name] == (max(known) if known else None)


def test_plain_elements_are_values_too(spark):
    xml = """<ownershipDocument><documentType>4</documentType><issuer><issuerCik>7</issuerCik></issuer><nonDerivativeTable>
    <nonDerivativeTransaction><securityTitle>Common</securityTitle><transactionDate><value>2020-01-02</value><footnoteId id="F1"/></transactionDate>
    <transactionCoding><transactionCode>P</transactionCode></transactionCoding>
    <transactionAmounts><transactionShares>10</transactionShares><transactionPricePerShare><value>2.5</value></transactionPricePerShare>
    <transactionAcquiredDisposedCode>A</transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction>
    <nonDerivativeTransaction><securityTitle><value>Common</value></securityTitle><transactionDate>2020-01-03</transactionDate></nonDerivativeTransaction>
    </nonDerivativeTable></ownershipDocument>"""
    documents = spark.createDataFrame([(xml, "a", "2020-01-05", "p")], "xml string, accession_number string, filing_date string, path string")
    row = filings.parse_documents(documents).first()
    first, second = row.lots
    assert (first.security_title, first.transaction_date, first.shares, first.price_per_share, first.acquired_disposed_code) == ("Common", "2020-01-02", 10.0, 2.5, "A")
    assert first.footnote_refs == ["F1"] and second.transaction_date == "2020-01-03" and second.security_title == "Common"
    assert row.quality_flags == []
