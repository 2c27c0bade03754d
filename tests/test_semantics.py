"""Literal cases for semantics that are easy to get wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidegate.apps import latency, markov, sensors, stock, text
from tidegate.apps.book import Book
from tidegate.functions import scalar
from tidegate.operators import aggs, dataflow, joins, ordering, stats, windows
from tidegate.operators.ordered import micros
from tidegate.session import ROWS_PER_TASK_CONF
from tidegate.sinks.tables import KeyedTable
from tidegate.sources import readers
from tidegate.sources.catalog import StreamCatalog, script_statements


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_ttl_join_keeps_latest_only(spark):
    left = spark.createDataFrame([(1, at(0), 1), (1, at(1), 2)], "k int, ts timestamp, id int")
    right = spark.createDataFrame([(1, at(2), 10), (1, at(3), 11), (1, at(100), 12)], "k int, ts timestamp, id int")
    out = joins.latest_ttl_join(left, right, "k", "ts", "id", 60)
    # The first left message is replaced before any right one; the last right one finds it too old.
    assert rows(out, "l.id", "r.id") == [(2, 10), (2, 11)]


def test_ttl_bound_is_strict(spark):
    left = spark.createDataFrame([(1, at(0), 1)], "k int, ts timestamp, id int")
    right = spark.createDataFrame([(1, at(60), 10)], "k int, ts timestamp, id int")
    assert joins.latest_ttl_join(left, right, "k", "ts", "id", 60).count() == 0
    assert joins.latest_ttl_join(left, right, "k", "ts", "id", 61).count() == 1


def test_interval_join_meets_both_bounds(spark):
    left = spark.createDataFrame([(1, at(100), "a"), (2, at(0), "b")], "k int, ts timestamp, l string")
    right = spark.createDataFrame([(1, at(s), s) for s in (39, 40, 100, 160, 161)], "k int, rts timestamp, r int")
    out = joins.interval_join(left, right, "k", "ts", "rts", 60, "left")
    assert rows(out, "l", "r") == [("a", 100), ("a", 160), ("a", 40), ("b", None)]


def test_stream_table_joins(spark):
    stream = spark.createDataFrame([(1, "x"), (9, "y")], "id int, page string")
    table = spark.createDataFrame([(1, "Mike"), (2, "Mary")], "id int, name string")
    assert rows(joins.stream_table_join(stream, table, ["id"])) == [(1, "x", "Mike")]
    assert rows(joins.stream_table_join(stream, table, ["id"], "left")) == [(1, "x", "Mike"), (9, "y", None)]


def test_override_takes_right_most_source(spark):
    def source(*pairs):
        return spark.createDataFrame(list(pairs), "k int, v string")

    out = joins.override_join([source((1, "a"), (2, "a"), (3, "a")), source((2, "b"), (2, "b2")), source((3, "c"))], "k")
    assert rows(out) == [(1, "a"), (2, "b"), (2, "b2"), (3, "c")]


@pytest.mark.parametrize("how", ["inner", "full_outer"])
def test_merge_of_unique_sources(spark, how):
    a = spark.createDataFrame([(1, "a1"), (2, "a2")], "k int, a string")
    b = spark.createDataFrame([(2, 20, None), (3, 30, "x")], "k int, b int, c string")
    assert rows(joins.merge_unique([a, b], "k", how)) == rows(joins.merge_join([a, b], "k", how))


def test_tagged_join_drops_single_tags(spark):
    a = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    b = spark.createDataFrame([(2, 200), (3, 300)], "k int, v int")
    assert rows(joins.tagged_join({"a": a, "b": b}, "k", "v")) == [(2, 2, 20, 200)]


def test_completion_needs_all_parts(spark):
    data = [("k", 1, 0, at(1)), ("k", 1, 1, at(5)), ("k", 1, 0, at(9)), ("k", 2, 0, at(10))]
    df = spark.createDataFrame(data, "key string, epoch int, part int, ts timestamp")
    assert rows(joins.completion_join(df, "key", "epoch", "part", "ts", 2)) == [("k", 1, at(5))]


def test_sessions_merge_at_exact_gap(spark):
    df = spark.createDataFrame([("u", at(s)) for s in (0, 60, 121, 150)], "u string, ts timestamp")
    out = windows.sessions(df, "ts", 60, ["u"], {"n": ("count", "ts")})
    assert rows(out, "session_start", "session_end", "n") == [(at(0), at(120), 2), (at(121), at(210), 2)]
    built_in = windows.session_stream(df, "ts", "60 seconds", ["u"], {"n": F.count("ts")})
    assert rows(built_in, "session_start", "session_end", "n") == rows(out, "session_start", "session_end", "n")


def test_repartitioned_session_counts(spark):
    views = [("userId1", at(0)), ("userId2", at(1)), ("userId1", at(1)), ("userId1", at(2)), ("userId1", at(3))]
    df = spark.createDataFrame(views, "user string, ts timestamp").repartition(3)
    out = windows.sessions(df, "ts", 3, ["user"], {"n": ("count", "ts")})
    assert rows(out, "user", "n") == [("userId1", 4), ("userId2", 1)]


@pytest.mark.parametrize(
    "accumulating, expected",
    [(False, [("DEFAULT", 3, 2), ("EARLY", 1, 5), ("EARLY", 2, 5)]), (True, [("DEFAULT", 3, 12), ("EARLY", 1, 5), ("EARLY", 2, 10)])],
)
def test_early_panes(spark, accumulating, expected):
    df = spark.createDataFrame([("u", at(s), s) for s in range(12)], "u string, ts timestamp, id int")
    out = windows.early_panes(df, ["u"], "ts", "1 day", 5, accumulating)
    assert rows(out, "firing_type", "pane", "count") == expected


def test_count_trigger_fires_once(spark, small_tasks):
    df = spark.createDataFrame([("u", at(s), s) for s in range(1500)] + [("v", at(0), 0)], "u string, ts timestamp, id int")
    for n in (3, 1200):
        assert rows(windows.count_trigger(df, ["u"], "ts", ["ts", "id"], "1 day", n), "u", "id", "count") == [("u", n - 1, n)]


def test_many_panes_are_cut_into_runs(spark, monkeypatch):
    monkeypatch.setattr(windows, "PANES_PER_ROW", 4)
    df = spark.createDataFrame([("u", at(s)) for s in range(41)], "u string, ts timestamp")
    out = windows.early_panes(df, ["u"], "ts", "1 day", 2, True)
    assert rows(out.filter("firing_type = 'EARLY'").orderBy("pane"), "pane", "count") == sorted(
        [(p, 2 * p) for p in range(1, 21)], key=repr
    )
    assert rows(out.filter("firing_type = 'DEFAULT'"), "pane", "count") == [(21, 41)]


def test_discarding_has_no_empty_last_pane(spark):
    df = spark.createDataFrame([("u", at(s), s) for s in range(10)], "u string, ts timestamp, id int")
    out = windows.early_panes(df, ["u"], "ts", "1 day", 5, False)
    assert rows(out, "firing_type", "count") == [("EARLY", 5), ("EARLY", 5)]


def test_since_last_trigger_is_reset(spark):
    df = spark.createDataFrame([("u", at(s)) for s in (0, 5, 9, 30)], "u string, ts timestamp")
    out = windows.since_last_trigger(df, ["u"], "ts", "1 day", 10)
    assert rows(out, "fire_ts", "seen") == [(at(19), 3)]


def test_running_sum_is_not_an_average(spark):
    data = [(1, 1, 1, 1, 100, 5, "B", at(0)), (1, 2, 1, 1, 300, 5, "S", at(1))]
    orders = spark.createDataFrame(data, "security int, order_no int, line int, part_id int, cents int, volume int, side string, ts timestamp")
    assert rows(stock.running_totals(orders), "running_sum", "running_n") == [(100, 1), (400, 2)]


def test_stopped_with_few_reports(spark):
    positions = [7, 8, 8, 8, 8, 9]
    df = spark.createDataFrame([(1, at(i), i, p) for i, p in enumerate(positions)], "vehicle int, ts timestamp, event_id int, position int")
    assert rows(sensors.stops(df), "event_id", "stopped") == [(0, True), (1, True), (2, True), (3, False), (4, True), (5, False)]


def test_markov_smooths_whole_row(spark):
    seq = spark.createDataFrame([("e", at(i), i, s) for i, s in enumerate("aabab")], "e string, ts timestamp, id int, s string")
    moves = markov.transitions(seq, "e", "s", ["ts", "id"])
    # a→a 1, a→b 2, b→a 1, b→b 0: row b is smoothed to 2 and 1.
    assert rows(markov.train(moves, "s", ["a", "b"], 1000), "from_state", "to_state", "n", "p") == [
        ("a", "a", 1, 333), ("a", "b", 2, 666), ("b", "a", 2, 666), ("b", "b", 1, 333),
    ]
    assert rows(markov.train(moves, "s", ["a", "b"], 1), "to_state", "p")[0] == ("a", pytest.approx(1 / 3))


def test_fraud_score_is_mean_miss(spark):
    seq = spark.createDataFrame([("e", at(i), i, s) for i, s in enumerate("ababa")], "e string, ts timestamp, id int, s string")
    moves = markov.transitions(seq, "e", "s", ["ts", "id"])
    model = spark.createDataFrame([("a", "b", 0.25), ("b", "a", 0.5)], "from_state string, to_state string, p double")
    out = markov.score(moves, "e", "s", ["ts", "id"], model, 5, 0.6)
    assert rows(out, "id", "score", "outlier") == [(4, 0.625, True)]


def test_value_histogram_median(spark):
    data = [("x", v) for v, n in (("a", 1), ("b", 3), ("c", 5), ("d", 7)) for _ in range(n)]
    out = aggs.value_histogram(spark.createDataFrame(data, "id string, v string"), "id", "v")
    # Element 4 // 2 of [1, 3, 5, 7], and the population deviation.
    assert rows(out) == [("x", 4, 1, 5, 7, 4.0, pytest.approx(5**0.5))]


def test_value_histogram_with_counts(spark):
    df = spark.createDataFrame([("x", "a", 2), ("x", "b", 3), ("x", "a", 4)], "id string, v string, n int")
    assert rows(aggs.value_histogram(df, "id", "v", "n"), "unique_values", "min_count", "max_count") == [(2, 3, 6)]


def test_aggregate_job(spark):
    # Line i holds the number i, i times over; the distinct count is capped at 14.
    numbers = spark.createDataFrame([(str(i).zfill(4), i) for i in range(1, 20) for _ in range(i)], "word string, n int")
    out = aggs.by_descriptor(
        numbers.withColumn("text", F.col("n").cast("string")),
        {"max": ("LongValueMax", "n"), "min": ("LongValueMin", "n"), "value_as_string_max": ("StringValueMax", "text"),
         "value_as_string_min": ("StringValueMin", "text")},
    )
    assert rows(out, "id", "value") == [("max", "19"), ("min", "1"), ("value_as_string_max", "9"), ("value_as_string_min", "1")]
    assert rows(numbers.agg(aggs.uniq_capped("word", 14)))[0][0] == 15
    counts = rows(numbers.groupBy("word").agg(F.count(F.lit(1))))
    assert counts == [(str(i).zfill(4), i) for i in range(1, 20)]


def test_text_protocol(spark):
    lines = ["LongValueSum:a\t1", "LongValueSum:a\t1", "LongValueSum:b:c\t5", "StringValueMax:a\tx\ty", "no separator"]
    out = aggs.text_protocol(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows(out) == [("LongValueSum", "a", "2"), ("LongValueSum", "b:c", "5"), ("StringValueMax", "a", "x\ty")]


def test_flatten_keeps_null_and_drops_empty(spark):
    df = spark.createDataFrame([(1, ["a", None]), (2, []), (3, None)], "id int, w array<string>")
    assert rows(scalar.flatten_rows(df, "w")) == [(1, "a"), (1, None), (3, None)]
    with pytest.raises(ValueError):
        scalar.flatten_rows(df, "w", "id")


def test_regex_match_is_full(spark):
    df = spark.createDataFrame([("abc",), ("abcd",), ("abc\n",), ("xabc",)], "v string")
    assert rows(df.filter(scalar.regex_match("a|abc", F.col("v")))) == [("abc",)]
    scalar.register(spark)
    assert spark.sql("SELECT RegexMatch('.*\\\\.com', 'a.com'), RegexMatch('a', 'ab')").first() == (True, False)


def test_euro_is_single_precision(spark):
    from tidegate.plans.nexmark import euros

    assert rows(spark.createDataFrame([(100,)], "p bigint").select(euros(F.col("p")))) == [(82,)]


def test_integer_division_and_mod(spark):
    assert spark.sql("SELECT -7 div 2, mod(-7, 3)").first() == (-3, -1)


def test_field_selection(spark):
    line = "-".join(str(i).zfill(4) for i in range(7))
    df = spark.createDataFrame([(line,)], "value string")
    out = dataflow.select_fields(df, "value", "-", "6,5,1-3:0-").select("key", "val")
    assert rows(out) == [("0006-0005-0001-0002-0003", line)]
    assert rows(dataflow.select_fields(df, "value", "-", ":4,3,2,1,0,0-").select("key", "val")) == [
        ("", "0004-0003-0002-0001-0000-" + line)
    ]
    with pytest.raises(ValueError):
        dataflow.select_fields(df, "value", "-", "1-:0")


LINE1 = "123 -123 005120 123.9 0.01 0.18 010 10.0 4444.1 011 011 234"
LINE2 = "134 -12 005100 123.10 -1.01 0.19 02 10.1 4444"


@pytest.mark.parametrize(
    "spec, first",
    [("-k1,1n", 1), ("-k2,2n", 1), ("-k2.2,2n", 2), ("-k3.4,3n", 2), ("-k3.2,3.3n -k4,4n", 2), ("-k3.2,3.3n -k4,4nr", 1),
     ("-k2.4,2.4n", 2), ("-k7,7", 1), ("-k7,7n", 2), ("-k8,8n", 1), ("-k9,9", 2), ("-k11,11", 2), ("-k10,10", 2), ("-k9n", 2)],
)
def test_key_field_sort(spark, spec, first):
    df = spark.createDataFrame([(LINE1,), (LINE2,)], "value string")
    assert ordering.sort_by_fields(df, "value", spec, " ").first()[0] == (LINE1 if first == 1 else LINE2)


def test_byte_slice(spark):
    df = spark.createDataFrame([(bytearray(b"abcdef"),)], "k binary")
    got = df.select(*[ordering.byte_slice(F.col("k"), a, b).cast("string").alias(f"s{a}_{b}") for a, b in ((0, -1), (1, 3), (-3, -2))])
    # Two slices are equal when their bytes are.
    assert got.first() == ("abcdef", "bcd", "de")


def test_kth_smallest_large_index(spark, small_tasks):
    df = spark.createDataFrame([(i % 2, float(5000 - i), i) for i in range(5000)], "g int, v double, id int")
    out = ordering.kth_smallest(df, ["g"], "v", 1200, ["id"], F.col("v"))
    assert rows(out, "g", "v") == [(0, 2402.0), (1, 2401.0)]


def test_checksum_ignores_order(spark, tables):
    cols = ["event_id", "event_type", "value"]
    once = ordering.row_checksum(tables.events, *cols).first()
    again = ordering.row_checksum(tables.events.orderBy(F.col("value").desc()).repartition(5), *cols).first()
    assert once == again and once.n == tables.events.count()


def test_sort_report_counts_breaks(spark):
    df = spark.createDataFrame([(k,) for k in "acbd"], "k string").coalesce(1)
    assert rows(ordering.sort_report(df, "k")) == [(4, 1)]


def test_ewma_warms_up_on_count(spark):
    values = [float(i) for i in range(1, 13)]
    df = spark.createDataFrame([("d", at(i), i, v) for i, v in enumerate(values)], "d string, ts timestamp, id int, v double")
    decay = 2 / 31
    expected = sum(values[:10]) / 10
    for v in values[10:]:
        expected = v * decay + expected * (1 - decay)
    got = stats.ewma(df, ["d"], ["ts", "id"], micros("ts"), "v").first()
    assert got.ewma == pytest.approx(expected)
    assert stats.ewma(df.filter("id < 10"), ["d"], ["ts", "id"], micros("ts"), "v").first().ewma == 0.0


def test_confidence_bounds_take_a_step(spark):
    df = spark.createDataFrame([("k", v) for v in (52, 53, 54)], "k string, v int")
    assert rows(stats.confidence_bounds(df, ["k"], "v", 10, 80), "mean", "low", "high") == [(53, 45, 65)]


def test_entropy(spark):
    df = spark.createDataFrame([("k", v) for v in "aabb"] + [("one", "a")], "k string, v string")
    assert rows(stats.entropy(df, ["k"], "v")) == [("k", 1.0), ("one", 0.0)]
    zero = spark.range(1).select(stats.entropy_normal(F.lit(0.0)).alias("e")).first().e
    assert zero == pytest.approx(-12.396572, abs=1e-5)


def test_latency_series(spark):
    log = [(0, 50), (10, 90), (120, 150), (330, 360), (450, 470)]
    lines = spark.createDataFrame([("x", f"stock_id: 1 arrival_ts: {a} completion_ts: {c}") for a, c in log] + [("x", "noise")], "e string, value string")
    series = latency.epochs(lines, "e", "value", 100)
    # Completions 50, 90 | 150 from 50 is epoch 1 | 360 is epoch 3 | 470 is the last epoch and left out.
    assert rows(series, "epoch", "latency") == [(0, 65.0), (1, 30.0), (3, 30.0)]
    assert rows(latency.filled(series, "e"), "epoch", "latency") == [(0, 65.0), (1, 30.0), (2, 30.0)]
    late = spark.createDataFrame([("x", 2, 10.0), ("x", 4, 20.0)], "e string, epoch bigint, latency double")
    assert rows(latency.filled(late, "e"), "epoch", "latency") == [(0, 0.0), (1, 5.0), (2, 10.0), (3, 15.0)]
    assert rows(latency.resampled(spark.range(0, 31).toDF("epoch"), 10, 30, 10)) == [(20,)]


def test_sentiment(spark):
    lexicon = spark.createDataFrame([("good", 3), ("bad", -2)], "word string, score int")
    df = spark.createDataFrame([(1, "Good,good day!"), (2, "a BAD\nday"), (3, ""), (4, "goodness")], "id int, t string")
    assert rows(text.sentiment(df, "id", "t", lexicon)) == [(1, 6, "Positive"), (2, -2, "Negative"), (3, 0, "Neutral"), (4, 0, "Neutral")]


def test_edit_lines(spark):
    good = "[[Talk:Wikis]] !NM http://en.example.org/?diff=1 * Some User * (+17) a note"
    df = spark.createDataFrame([(good,), ("[[broken",), ("[[A]] B u * x * (-5) s",)], "value string")
    out = rows(text.parse_edits(df), "title", "user", "diff_bytes", "is_talk", "is_minor", "is_unpatrolled", "is_bot_edit")
    assert out == [("A", "x", -5, False, False, False, True), ("Talk:Wikis", "Some User", 17, True, True, True, False)]


def test_log_attributes_first_match(spark):
    lines = [("c1", 1, "system config nexmark-q5"), ("c1", 2, "system config nexmark-q8"),
             ("c1", 3, "executor configure resource <memory:1024, vCores:4>"), ("c2", 1, "system config nexmark-q1")]
    df = spark.createDataFrame(lines, "dir string, n int, value string")
    assert rows(latency.log_attributes(df, "dir", "n", "value")) == [("c1", "nexmark-q5", "memory:1024", "vCores:4")]


def test_book_price_then_time():
    book = Book()
    assert book.add(1, "S", 100, 5) == []
    assert book.add(2, "S", 99, 5) == []
    assert book.add(3, "S", 99, 5) == []
    assert book.add(4, "B", 100, 12) == [(4, 2, 99, 5), (4, 3, 99, 5), (4, 1, 100, 2)]
    assert book.add(5, "B", 98, 1) == []
    assert book.add(6, "S", 98, 4) == [(5, 6, 98, 1)]


def test_matching_against_a_plain_matcher(spark, tables):
    """Each order looks through all resting ones for the best price, the oldest first, until it is met or none fits."""
    columns = ["security", "session", "side", "cents", "order_no", "volume"]
    orders = tables.stock_order.withColumn("session", stock.session_of(F.col("ts"), "year"))
    arriving = orders.orderBy("ts", "order_no", "line", "part_id", "cents", "volume", "side").select(*columns).collect()
    resting, want = {}, []
    for security, session, side, cents, order_no, volume in map(tuple, arriving):
        book = resting.setdefault((security, session), [])  # [side, cents, order_no, volume], oldest first
        while volume:
            fits = [o for o in book if o[0] != side and o[3] and (o[1] <= cents if side == "B" else o[1] >= cents)]
            if not fits:
                book.append([side, cents, order_no, volume])
                break
            best = min(o[1] for o in fits) if side == "B" else max(o[1] for o in fits)
            met = next(o for o in fits if o[1] == best)
            traded = min(volume, met[3])
            volume, met[3] = volume - traded, met[3] - traded
            want.append((security, session, *((order_no, met[2]) if side == "B" else (met[2], order_no)), met[1], traded))
    assert len(want) > 100 and rows(stock.match_orders(tables.stock_order, "year")) == sorted(want, key=repr)


def test_order_codec(spark):
    state = spark.createDataFrame([("7|12.34|100,8|0.07|5.9",)], "s string")
    got = state.select(F.explode(stock.decode_state(F.col("s"))).alias("o")).select("o.*")
    assert rows(got) == [("7", 1234, 100), ("8", 7, 5)]


def test_keyed_table(spark, folder):
    table = KeyedTable(spark, folder, ["k"])
    table.put_all(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, seq int"), ["seq"])
    table.put_all(spark.createDataFrame([(2, "d", 9), (3, "e", 9)], "k int, v string, seq int"))
    table.delete_all(spark.createDataFrame([(1,)], "k int"))
    assert rows(table.read(), "k", "v") == [(2, "d"), (3, "e")]
    assert rows(table.get_all(spark.createDataFrame([(3,), (9,)], "k int")), "k", "v") == [(3, "e")]
    table.compact()
    table = KeyedTable(spark, folder, ["k"])
    table.put_all(spark.createDataFrame([(1, "z", 1)], "k int, v string, seq int"), batch=table.next_batch)
    assert rows(table.read(), "k", "v") == [(1, "z"), (2, "d"), (3, "e")]


def test_scripts_and_names(spark):
    assert script_statements("-- c\ninsert into a\nselect 1\n\n insert into b select 2") == ["insert into a select 1", "insert into b select 2"]
    cat = StreamCatalog(spark)
    cat.source("kafka.one", spark.range(3))
    assert cat.query("select count(*) from kafka.one").first()[0] == 3
    with pytest.raises(ValueError, match="unknown stream"):
        cat.query("select * from kafka.two")
    with pytest.raises(ValueError, match="unknown sink"):
        cat.insert("insert into kafka.none select id from kafka.one")
    with pytest.raises(ValueError, match="not an INSERT"):
        cat.insert("select * from kafka.one")


def test_range_predicates():
    assert readers.range_predicates("x", 0, 18, 4)[-1] == "x >= 16 AND x <= 18"
    assert readers.range_predicates("x", None, None, 4) == ["x IS NULL"]
    assert readers.range_predicates("x", False, True, 4, True) == ["x = FALSE", "x = TRUE", "x IS NULL"]


@pytest.mark.parametrize(
    "values", [list(range(-5, 60)), [0.5 * i for i in range(40)], [7], [dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i) for i in range(50)]]
)
def test_range_predicates_cover_once(spark, values):
    df = spark.createDataFrame([(v,) for v in values], ["x"])
    splits = readers.range_predicates("x", min(values), max(values), 6)
    assert [sum(r) for r in df.select(*[F.expr(p).cast("int") for p in splits]).collect()] == [1] * len(values)


def test_topics_configured_twice(spark):
    with pytest.raises(ValueError):
        readers.regex_paths(spark.range(1), "a.*", static=["abc"])


def test_enum_check(spark):
    df = spark.createDataFrame([("a",), (None,)], "v string")
    assert rows(df.select(readers.enum_checked(F.col("v"), ["a", "b"]).alias("v"))) == [("a",), (None,)]
    with pytest.raises(Exception, match="not an allowed value"):
        df.select(readers.enum_checked(F.col("v"), ["b"])).collect()


def test_partition_by_sends_nulls_to_one_place(spark):
    df = spark.createDataFrame([(None,)] * 50 + [(i,) for i in range(50)], "k int")
    placed = dataflow.partition_by(df, F.col("k"), 7).withColumn("p", F.spark_partition_id())
    assert placed.filter("k IS NULL").select("p").distinct().count() == 1


def test_packed_reads(spark, folder):
    spark.range(1000).repartition(50).write.parquet(f"{folder}/many")
    with readers.packed_reads(spark, 1 << 20):
        assert spark.read.parquet(f"{folder}/many").rdd.getNumPartitions() < 10


def test_auto_text(spark, folder):
    df = spark.createDataFrame([("a", "1"), ("b", "2\t3")], "k string, v string")
    df.select(F.concat_ws("\t", "k", "v").alias("value")).write.text(f"{folder}/text")
    df.rdd.map(tuple).saveAsSequenceFile(f"{folder}/seq")
    assert rows(readers.auto_text(spark, f"{folder}/text")) == rows(readers.auto_text(spark, f"{folder}/seq"))


def test_avro_schema():
    from tidegate.sources.avro_schema import row_schema

    record = {
        "type": "record",
        "fields": [
            {"name": "id", "type": ["null", "int"]}, {"name": "two", "type": ["long", "string"]},
            {"name": "many", "type": ["null", "int", "string"]}, {"name": "kind", "type": {"type": "enum", "symbols": ["A"]}},
            {"name": "raw", "type": {"type": "fixed", "size": 4}}, {"name": "tags", "type": {"type": "array", "items": "string"}},
            {"name": "attrs", "type": {"type": "map", "values": "double"}},
            {"name": "sub", "type": {"type": "record", "fields": [{"name": "x", "type": "boolean"}]}},
        ],
    }
    got = row_schema(record)
    assert got.simpleString() == (
        "struct<id:int,two:bigint,many:string,kind:string,raw:binary,tags:array<string>,attrs:map<string,double>,sub:struct<x:boolean>>"
    )
    assert all(f.nullable for f in got)
    with pytest.raises(ValueError):
        row_schema({"type": "array", "items": "int"})


def test_hot_key_with_crowded_positions(spark, tables):
    from tidegate.operators.ordered import at as position
    from tidegate.operators.ordered import moving, previous, running, slice_hot_keys
    from tidegate.session import ROWS_PER_TASK_CONF

    # One key with most of the rows, and nearly all of those at two times.
    df = tables.events.select(
        "event_id", F.when(F.col("user_id") % 4 > 0, 0).otherwise(F.col("user_id")).alias("k"),
        F.when(F.col("event_id") < 950, F.date_trunc("month", F.col("ts"))).otherwise(F.col("ts")).alias("ts"),
        F.round(F.col("value") * 100).cast("bigint").alias("v"),
    )
    args = (["k"], ["ts", "event_id"], position("ts", "event_id"))

    def all_results():
        return [
            rows(running(df, *args, {"s": ("sum", "v"), "l": ("last", "v"), "m": ("max", "v")}, include_current=False)),
            rows(previous(df, *args, "v", 3)),
            rows(moving(df, *args, 9, {"s": ("sum", "v")})),
        ]

    plain = all_results()
    spark.conf.set(ROWS_PER_TASK_CONF, "50")
    try:
        sliced, split = slice_hot_keys(df, ["k"], args[2])
        largest = sliced.groupBy("k", "_slice").count().agg(F.max("count")).first()[0]
        assert split and largest <= 100
        assert all_results() == plain
    finally:
        spark.conf.unset(ROWS_PER_TASK_CONF)


def test_functions_travel_by_value(folder):
    """Workers have no copy of the package: what they run must not import it."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from tidegate.operators.median import _fold
    from tidegate.streaming.processors import LatestTtlJoin, MatchOrders

    with open(f"{folder}/code", "wb") as f:
        cloudpickle.dump((stock._match, MatchOrders(), LatestTtlJoin(1), _fold(["k"], "v", "m")), f)
    check = "import pickle, sys; got = pickle.load(open(sys.argv[1], 'rb')); list(got[0]([])); assert 'tidegate' not in sys.modules"
    subprocess.run([sys.executable, "-c", check, f"{folder}/code"], cwd=folder, check=True)


def test_running_totals_of_a_hot_security_with_times_of_day(small_tasks):
    """Slices follow the arrival order, so a split security has the same sums as a whole one."""
    spark = small_tasks
    orders = spark.range(200).select(
        F.lit(1).alias("security"), ((F.col("id") * 7919) % 1000).alias("order_no"), F.lit(1).alias("line"),
        F.timestamp_seconds(F.lit(1704067200) + (F.col("id") * 37) % 86400).alias("ts"), F.lit(1).alias("part_id"),
        (F.col("id") + 1).alias("cents"), F.lit(1).alias("volume"), F.lit("B").alias("side"),
    )
    got = stock.running_totals(orders).select("ts", "order_no", "cents", "running_sum").collect()
    total = 0
    for r in sorted(got, key=lambda r: (r.ts, r.order_no)):
        total += r.cents
        assert r.running_sum == total


def test_pipe_takes_named_exit_codes_and_skips_empty_partitions(spark):
    from tidegate.functions.pipes import piped_map

    words = spark.createDataFrame([(w,) for w in ("a", "b", "c", "a")], "w string").repartition(8)
    assert rows(piped_map(words, "grep a", "w", accept=(0, 1))) == [("a",), ("a",)]
    assert rows(piped_map(words.filter("w = 'a'"), "grep a", "w")) == [("a",), ("a",)]
    with pytest.raises(Exception, match="exit"):
        piped_map(words, "grep a", "w").collect()


@pytest.mark.parametrize("limit", ["3", "1000"])
def test_median_of_null_keys_and_values(spark, limit):
    from tidegate.operators.median import running_median

    data = [(None, 1, 0.0), (None, 2, 1.0), (None, 3, None), (None, 4, 2.0), ("k", 1, None), ("k", 2, 5.0)]
    df = spark.createDataFrame(data, "k string, t int, v double")
    spark.conf.set(ROWS_PER_TASK_CONF, limit)  # 3: the null key is split into slices
    try:
        got = {(r.k, r.t): r.median for r in running_median(df, ["k"], ["t"], F.col("t"), "v").collect()}
    finally:
        spark.conf.unset(ROWS_PER_TASK_CONF)
    assert [got[None, t] for t in (1, 2, 3, 4)] == [0.0, 0.5, 0.5, 1.0]
    assert got["k", 1] is None and got["k", 2] == 5.0


def test_fold_with_its_own_combination(spark):
    from tidegate.operators.aggs import fold

    df = spark.createDataFrame([("a", 5), ("a", 7)], "k string, v int")
    assert rows(fold(df, ["k"], {"m": 100}, {"m": F.max("v")}, {"m": F.greatest})) == [("a", 100)]


def test_total_rank_needs_no_single_task(spark):
    from tidegate.operators.ordering import total_rank

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    ranked = total_rank(df, ["v"])
    assert rows(ranked) == [(i, i + 1) for i in sorted(range(1000), key=lambda i: repr((i, i + 1)))]


def test_keyed_table_opened_again(spark, folder):
    table = KeyedTable(spark, folder, ["k"])
    table.put_all(spark.createDataFrame([], "k int, v int"))
    again = KeyedTable(spark, folder, ["k"])
    again.put_all(spark.createDataFrame([(1, 1)], "k int, v int"))
    again.put_all(spark.createDataFrame([(1, 2)], "k int, v int"))
    again.compact()
    last = KeyedTable(spark, folder, ["k"])
    assert last.base == again.base > 0 and rows(last.read()) == [(1, 2)]


def test_text_and_sequence_files_side_by_side(spark, folder):
    from tidegate.sources.readers import auto_text

    spark.createDataFrame([("a\t1",)], "value string").coalesce(1).write.text(f"{folder}/text")
    spark.sparkContext.parallelize([("b", "2")], 1).saveAsSequenceFile(f"{folder}/seq")
    assert rows(auto_text(spark, f"{folder}/*")) == [("a", "1"), ("b", "2")]


def test_interval_join_of_equal_times(spark):
    from tidegate.operators.joins import interval_join

    df = spark.createDataFrame([(1, 10), (1, 11)], "k int, s int").select("k", F.timestamp_seconds("s").alias("t"))
    assert interval_join(df, df.withColumnRenamed("t", "u"), "k", "t", "u", 0).count() == 2


def test_own_functions_of_sql_text():
    from tidegate.sources.catalog import own_functions

    assert own_functions("SELECT SUM0(a + f(b, ')')) FROM t") == "SELECT coalesce(sum(a + f(b, ')')), 0) FROM t"
    assert own_functions("GROUP BY TUMBLE(ts, INTERVAL '5' SECOND)") == "GROUP BY window(ts, '5 SECOND')"
    with pytest.raises(ValueError):
        own_functions("SELECT flatten(a), flatten(b) FROM t")
    assert own_functions("SELECT ' sum0(v)', `sum0(a)`, 'it''s tumble(' -- sum0(x)") == "SELECT ' sum0(v)', `sum0(a)`, 'it''s tumble(' -- sum0(x)"
    assert own_functions("SELECT sum0(sum0(x) + g(h(i(j(k), ',')))) /* flatten(a) */") == "SELECT coalesce(sum(coalesce(sum(x), 0) + g(h(i(j(k), ',')))), 0) /* flatten(a) */"
    with pytest.raises(ValueError):
        own_functions("SELECT sum0(a FROM t")


def test_names_in_strings_stay(spark):
    cat = StreamCatalog(spark)
    cat.source("kafka.one", spark.createDataFrame([(1, "kafka.one")], "id int, s string"))
    got = cat.query("SELECT id, 'from kafka.two, kafka.one' AS t FROM kafka.one WHERE s = 'kafka.one'")
    assert rows(got) == [(1, "from kafka.two, kafka.one")]


def test_upserts_keep_the_last(spark, folder):
    """The last row of a key by ``__order__``, not the greatest; without it, different rows of a key are an error."""
    from tidegate.sources.readers import file_stream

    made = [(1, 9, 10), (1, 2, 11), (2, 5, 10), (2, 5, 10)]
    spark.createDataFrame(made, "k int, v int, t int").coalesce(1).write.parquet(f"{folder}/in/p=0")
    arrivals = file_stream(spark, f"{folder}/in/p=*", spark.createDataFrame([], "k int, v int, t int").schema)
    cat = StreamCatalog(spark)
    cat.source("kafka.rows", arrivals)
    cat.source("store.rows", spark.createDataFrame(made, "k int, v int, t int"))
    cat.sink("store.t.$table", f"{folder}/table")
    streamed = "UPSERT INTO store.t.$table SELECT k AS __key__, v, t AS __order__ FROM kafka.rows"
    cat.insert(streamed)
    assert rows(cat.read("store.t.$table")) == [(1, 2), (2, 5)]
    cat.insert("UPSERT INTO store.t.$table SELECT 2 AS __key__, 77 AS v")
    # Again, also by a catalog that knows nothing of the first: nothing old comes back.
    for again in (cat, StreamCatalog(spark)):
        again.source("kafka.rows", arrivals)
        again.sink("store.t.$table", f"{folder}/table")
        again.insert(streamed)
        assert rows(again.read("store.t.$table")) == [(1, 2), (2, 77)]
    # New input goes on from there, over the batch.
    spark.createDataFrame([(2, 8, 12)], "k int, v int, t int").coalesce(1).write.parquet(f"{folder}/in/p=1")
    cat.insert(streamed)
    assert rows(cat.read("store.t.$table")) == [(1, 2), (2, 8)]
    with pytest.raises(Exception, match="no order"):
        cat.insert("UPSERT INTO store.t.$table SELECT k AS __key__, v FROM store.rows")
    cat.insert("UPSERT INTO store.t.$table SELECT k AS __key__, v FROM store.rows WHERE k = 2")
    assert rows(cat.read("store.t.$table")) == [(1, 2), (2, 5)]


def test_a_batch_that_is_retried_keeps_its_number(spark, folder):
    table = KeyedTable(spark, folder, ["k"])
    number = table.number_of("s-0")
    table.put_all(spark.createDataFrame([(1, 1)], "k int, v int"), batch=number)
    table.put_all(spark.createDataFrame([(1, 2)], "k int, v int"))
    table = KeyedTable(spark, folder, ["k"])
    assert table.number_of("s-0") == number and table.number_of("s-1") == number + 2
    table.put_all(spark.createDataFrame([(1, 1)], "k int, v int"), batch=number)
    assert rows(table.read()) == [(1, 2)]
    # A number that was set down, but not written before the job ended, is not given to another batch.
    assert KeyedTable(spark, folder, ["k"]).next_batch == number + 3
