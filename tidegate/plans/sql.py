"""SQL layer queries: clauses, operators, functions, user functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.functions import scalar
from tidegate.functions.pipes import piped_map, piped_reduce
from tidegate.registry import query
from tidegate.sources.catalog import StreamCatalog


def catalog(t, **sources) -> StreamCatalog:
    cat = StreamCatalog(t.spark)
    for name, df in sources.items():
        cat.source(name.replace("__", "."), df)
    return cat


def sql_query(name: str, text: str, oracle: str | None = None, **sources: str):
    """Register a query given as SQL over dotted stream names, each backed by a table or view."""

    def run(t):
        cat = catalog(t, **{stream: getattr(t, table) for stream, table in sources.items()})
        return cat.query(text)

    plain = text
    for stream, table in sources.items():
        plain = plain.replace(stream.replace("__", "."), table)
    query(name, oracle or plain)(run)


sql_query("sql_scan", "SELECT * FROM kafka.nations", kafka__nations="nation")

sql_query(
    "sql_project",
    "SELECT e.event_id AS id, e.value * 2 AS doubled, e.event_type, s.* FROM kafka.events e JOIN store.segments s ON e.user_id = s.c_custkey",
    "SELECT e.event_id AS id, e.value * 2 AS doubled, e.event_type, s.* FROM events e JOIN customer s ON e.user_id = s.c_custkey",
    kafka__events="events", store__segments="customer",
)

sql_query(
    "sql_filter",
    "SELECT event_id, user_id FROM kafka.events WHERE value > 10 AND nullif(event_type, 'error') <> 'view'",
    kafka__events="events",
)

sql_query(
    "sql_group_count",
    """SELECT unix_micros(window(ts, '1 day').start) AS window_start, event_type, count(*) AS n FROM kafka.events
    GROUP BY window(ts, '1 day'), event_type""",
    "SELECT epoch_us(date_trunc('day', ts)) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    kafka__events="events",
)

sql_query(
    "sql_tumble",
    """SELECT unix_micros(TUMBLE_START(ts, INTERVAL '6' HOUR)) AS tumble_start,
    unix_micros(TUMBLE_END(ts, INTERVAL '6' HOUR)) AS tumble_end, count(*) AS n,
    sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM kafka.events GROUP BY TUMBLE(ts, INTERVAL '6' HOUR)""",
    """SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS tumble_start,
    epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR) AS tumble_end, count(*) AS n,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL""",
    kafka__events="events",
)

sql_query(
    "sql_literal_names",
    """SELECT event_type || ' sum0(v) from kafka.events' AS told, 'tumble(a, b) -- flatten(x' AS kept, -- flatten(a), flatten(b), tumble(
    SUM0(CASE WHEN event_type = 'sum0(' THEN 1 ELSE event_id % 7 END) AS total /* sum0(x) */ FROM kafka.events
    GROUP BY event_type, TUMBLE(ts, INTERVAL '30' DAY)""",
    """SELECT event_type || ' sum0(v) from kafka.events' AS told, 'tumble(a, b) -- flatten(x' AS kept, CAST(sum(event_id % 7) AS BIGINT) AS total
    FROM events GROUP BY event_type, time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01')""",
    kafka__events="events",
)

for how, name in (("JOIN", "sql_join_inner"), ("LEFT JOIN", "sql_join_left")):
    sql_query(
        name,
        f"""SELECT o.o_orderkey, o.o_totalprice, c.c_name, c.c_mktsegment FROM kafka.orders o {how} store.customer c
        ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0""",
        kafka__orders="orders", store__customer="customer",
    )

sql_query(
    "sql_join_right",
    """SELECT c.c_name, c.c_mktsegment, o.o_orderkey, o.o_totalprice FROM store.customer c RIGHT JOIN kafka.orders o
    ON c.c_custkey = o.o_custkey AND c.c_acctbal > 5000""",
    store__customer="customer", kafka__orders="orders",
)

sql_query(
    "sql_join_using",
    """SELECT user_id, e.event_id, p.event_id AS view_id, p.page_id FROM kafka.events e JOIN kafka.views p USING (user_id, ts)""",
    """SELECT user_id, e.event_id, p.event_id AS view_id, p.page_id FROM events e JOIN page_view p USING (user_id, ts)""",
    kafka__events="events", kafka__views="page_view",
)

sql_query(
    "sql_join_natural",
    "SELECT doc_id, lang, quality, toxic FROM store.documents NATURAL JOIN store.labels",
    store__documents="documents", store__labels="labels",
)

sql_query(
    "sql_values",
    """SELECT v.label, count(*) AS n FROM kafka.events e JOIN (VALUES ('view', 'seen'), ('click', 'used'),
    ('purchase', 'paid')) AS v(kind, label) ON e.event_type = v.kind GROUP BY v.label""",
    kafka__events="events",
)

sql_query(
    "sql_case",
    """SELECT event_id, CASE WHEN value < 5 THEN 'low' WHEN value < 20 AND event_type = 'view' THEN 'seen'
    WHEN value < 20 THEN 'mid' ELSE 'high' END AS band FROM kafka.events""",
    kafka__events="events",
)

sql_query(
    "sql_explicit_table",
    "SELECT count(*) AS n, max(s_suppkey) AS top FROM (TABLE store.supplier)",
    "SELECT count(*) AS n, max(s_suppkey) AS top FROM supplier",
    store__supplier="supplier",
)


@query(
    "sql_flatten",
    r"""WITH w AS (SELECT doc_id, CASE WHEN lang = 'en' THEN NULL ELSE list_filter(string_split(text, ' '),
      lambda x: length(x) > 12) END AS words FROM documents)
    SELECT doc_id, NULL AS word FROM w WHERE words IS NULL UNION ALL SELECT doc_id, unnest(words) FROM w WHERE words IS NOT NULL""",
)
def sql_flatten(t):
    long_words = F.filter(F.split("text", " "), lambda x: F.length(x) > 12)
    rows = t.documents.select("doc_id", F.when(F.col("lang") != "en", long_words).alias("words"))
    return catalog(t, kafka__texts=rows).query("SELECT doc_id, flatten(words) AS word FROM kafka.texts")


@query("sql_key_col", "SELECT c_custkey AS __key__, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def sql_key_col(t):
    # The message key is an ordinary column: set by alias on one statement, read by the next.
    cat = catalog(t, kafka__orders=t.orders.select(F.col("o_custkey").alias("__key__")), store__customer=t.customer)
    cat.source("store.profiles", cat.query("SELECT c_custkey AS __key__, c_name AS name FROM store.customer"))
    return cat.query("SELECT p.__key__, p.name FROM store.profiles p LEFT SEMI JOIN kafka.orders o ON p.__key__ = o.__key__")


@query("sql_insert", "SELECT event_id, event_type, value FROM events WHERE event_type <> 'view'")
def sql_insert(t):
    cat = catalog(t, kafka__events=t.events)
    cat.sink("kafka.kept")
    cat.insert("INSERT INTO kafka.kept SELECT event_id, event_type, value FROM kafka.events WHERE event_type <> 'view'")
    return cat.read("kafka.kept")


@query(
    "sql_upsert_table",
    """SELECT user_id AS __key__, CASE WHEN count(*) FILTER (event_type = 'click') > 0 THEN max(event_id) FILTER (event_type = 'click')
    ELSE max(event_id) END AS last_event FROM events GROUP BY user_id""",
)
def sql_upsert_table(t):
    cat = catalog(t, kafka__events=t.events)
    cat.sink("store.last.$table")
    cat.insert("INSERT INTO store.last.$table SELECT user_id AS __key__, max(event_id) AS last_event FROM kafka.events GROUP BY user_id")
    cat.insert(
        """UPSERT INTO store.last.$table SELECT user_id AS __key__, max(event_id) AS last_event FROM kafka.events
        WHERE event_type = 'click' GROUP BY user_id"""
    )
    return cat.read("store.last.$table")


@query(
    "sql_script",
    """SELECT 'kafka.errors' AS sink, event_id FROM events WHERE event_type = 'error'
    UNION ALL SELECT 'kafka.large', event_id FROM events WHERE value > 20""",
)
def sql_script(t):
    cat = catalog(t, kafka__events=t.events)
    cat.sink("kafka.errors")
    cat.sink("kafka.large")
    names = cat.run_script(
        """
        -- errors go to a stream of their own
        insert into kafka.errors
        select event_id from kafka.events
        where event_type = 'error'

        INSERT INTO kafka.large
          -- the threshold is in the units of the value
          SELECT event_id FROM kafka.events WHERE value > 20
        """
    )
    first, second = [cat.read(n).withColumn("sink", F.lit(n)) for n in names]
    return first.unionByName(second)


# Operators and functions. `band` holds nulls, so that three-valued logic shows.
BAND = "(SELECT event_id, user_id, value, event_type, ts, CASE WHEN value < 25 THEN value END AS band FROM {}) AS e"


def fn_query(name: str, spark_cols: str, duck_cols: str | None = None, where: str = "") -> None:
    sql_query(
        name,
        f"SELECT event_id, {spark_cols} FROM {BAND.format('kafka.events')} {where}",
        f"SELECT event_id, {duck_cols or spark_cols} FROM {BAND.format('events')} {where}",
        kafka__events="events",
    )


fn_query("fn_logic", "band > 5 AND event_type = 'view' AS a, band > 5 OR event_type = 'view' AS o, NOT (band > 5) AS n")
fn_query("fn_compare", "band = 5 AS eq, band <> 5 AS ne, band < 5 AS lt, band <= 5 AS le, band > 5 AS gt, band >= 5 AS ge")
fn_query("fn_in", "event_type IN ('view', 'click') AS i, event_type NOT IN ('view', 'click') AS ni, event_type NOT IN ('view', NULL) AS nn")
fn_query(
    "fn_is",
    """band IS NULL AS isnull, band IS NOT NULL AS isnotnull, (band > 5) IS TRUE AS ist, (band > 5) IS NOT TRUE AS isnt,
    (band > 5) IS FALSE AS isf, (band > 5) IS NOT FALSE AS isnf""",
)
fn_query(
    "fn_arith",
    "event_id + 7 AS p, event_id - 7 AS m, event_id * -3 AS t, (event_id - 500) div 7 AS d, -event_id AS neg, +event_id AS pos, value / 4 AS q",
    "event_id + 7 AS p, event_id - 7 AS m, event_id * -3 AS t, CAST(trunc((event_id - 500) / 7) AS BIGINT) AS d, -event_id AS neg, +event_id AS pos, value / 4 AS q",
)
fn_query("fn_concat", "event_type || '-' || CAST(user_id AS STRING) AS s", "event_type || '-' || CAST(user_id AS VARCHAR) AS s")
fn_query(
    "fn_string",
    """char_length(event_type) AS len, substring(event_type, 2, 3) AS sub, replace(event_type, 'e', '3') AS rep,
    trim(concat('  ', event_type, ' ')) AS tr, upper(event_type) AS up, lower(upper(event_type)) AS lo""",
    """CAST(length(event_type) AS INT) AS len, substring(event_type, 2, 3) AS sub, replace(event_type, 'e', '3') AS rep,
    trim(concat('  ', event_type, ' ')) AS tr, upper(event_type) AS up, lower(upper(event_type)) AS lo""",
)
fn_query(
    "fn_math",
    """round(power(value, 2), 6) AS pw, round(sqrt(value), 6) AS sq, mod(event_id - 500, 7) AS md,
    CAST(floor(value) AS BIGINT) AS fl, CAST(ceil(value) AS BIGINT) AS ce""",
)
fn_query(
    "fn_extract",
    """CAST(extract(YEAR FROM ts) AS BIGINT) AS y, CAST(extract(DAY FROM ts) AS BIGINT) AS d,
    CAST(extract(HOUR FROM ts) AS BIGINT) AS h, CAST(extract(MINUTE FROM ts) AS BIGINT) AS mi, CAST(month(ts) AS BIGINT) AS mo""",
)
fn_query(
    "fn_ts_arith",
    """unix_micros(timestampadd(HOUR, 5, ts)) AS plus_hours, unix_micros(timestampadd(DAY, -3, ts)) AS minus_days,
    timestampdiff(HOUR, TIMESTAMP '2024-01-01 00:00:00', ts) AS hours, timestampdiff(DAY, TIMESTAMP '2024-01-01 00:00:00', ts) AS days""",
    """epoch_us(ts + INTERVAL 5 HOUR) AS plus_hours, epoch_us(ts - INTERVAL 3 DAY) AS minus_days,
    datesub('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS hours, datesub('day', TIMESTAMP '2024-01-01 00:00:00', ts) AS days""",
)
fn_query(
    "fn_cast",
    """CAST(event_id AS STRING) AS s, CAST(CAST(event_id AS STRING) AS BIGINT) AS b, CAST(value AS BIGINT) AS truncated,
    CAST(event_id AS DOUBLE) AS d, CAST(value > 5 AS STRING) AS flag""",
    """CAST(event_id AS VARCHAR) AS s, CAST(CAST(event_id AS VARCHAR) AS BIGINT) AS b, CAST(trunc(value) AS BIGINT) AS truncated,
    CAST(event_id AS DOUBLE) AS d, CAST(value > 5 AS VARCHAR) AS flag""",
)
fn_query(
    "fn_regex_match",
    "RegexMatch('v.*w', event_type) AS whole, RegexMatch('ie', event_type) AS part",
    "regexp_full_match(event_type, 'v.*w') AS whole, regexp_full_match(event_type, 'ie') AS part",
)
fn_query("udf_scalar", "scale_udf(user_id, 3) AS scaled, my_scale(event_id, 2) AS doubled", "user_id * 3 AS scaled, event_id * 2 AS doubled")


@query("fn_now", "SELECT event_id, true AS same_day, true AS same_local, true AS same_time, true AS past FROM events")
def fn_now(t):
    # The clock's values differ between runs; within a query they are one instant.
    cat = catalog(t, kafka__events=t.events)
    return cat.query(
        """SELECT event_id, current_date() = to_date(current_timestamp()) AS same_day,
        localtimestamp() = CAST(current_timestamp() AS timestamp_ntz) AS same_local,
        date_format(localtimestamp(), 'HH:mm:ss') = date_format(now(), 'HH:mm:ss') AS same_time, ts < current_timestamp() AS past
        FROM kafka.events"""
    )


@query("fn_dot", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id AS u FROM events")
def fn_dot(t):
    nested = t.events.select(
        "event_id", F.struct(F.from_json("props", "k bigint").alias("props"), F.col("user_id").alias("u")).alias("rec")
    )
    return catalog(t, kafka__nested=nested).query("SELECT event_id, n.rec.props.k, n.rec.u FROM kafka.nested n")


@query(
    "agg_sql",
    """SELECT event_type, count(*) AS n, count(CASE WHEN value < 25 THEN 1 END) AS small,
    CAST(sum(CASE WHEN value < 1 THEN user_id END) AS BIGINT) AS s,
    CAST(coalesce(sum(CASE WHEN value < 0 THEN user_id END), 0) AS BIGINT) AS s0 FROM events GROUP BY event_type""",
)
def agg_sql(t):
    return catalog(t, kafka__events=t.events).query(
        """SELECT event_type, count(*) AS n, count(CASE WHEN value < 25 THEN 1 END) AS small,
        sum(CASE WHEN value < 1 THEN user_id END) AS s, SUM0(CASE WHEN value < 0 THEN user_id END) AS s0
        FROM kafka.events GROUP BY event_type"""
    )


@query(
    "udf_array",
    r"""SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS INT) AS words FROM conversations""",
)
def udf_array(t):
    cat = catalog(t, store__talk=t.conversations)
    return cat.query("SELECT conv_id, turn, size(words_udf(text)) AS words FROM store.talk")


@query(
    "udtf_tokens",
    r"""SELECT item_id, token, place FROM (SELECT item_id, unnest(w) AS token, CAST(generate_subscripts(w, 1) - 1 AS INT) AS place FROM
    (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark))""",
)
def udtf_tokens(t):
    cat = catalog(t, store__items=t.benchmark)
    return cat.query("SELECT i.item_id, r.token, r.place FROM store.items i, LATERAL token_rows(i.text) r")


@query("json_roundtrip", "SELECT event_id, user_id, event_type, epoch_us(ts) AS ts FROM events")
def json_roundtrip(t):
    rows = t.events.select("event_id", "user_id", "event_type", F.unix_micros("ts").alias("ts"))
    text = rows.select(F.to_json(F.struct("*")).alias("value"))
    return text.select(F.from_json("value", rows.schema).alias("r")).select("r.*")


@query("udf_pipe", "SELECT event_type || chr(9) || CAST(user_id AS VARCHAR) AS value FROM events WHERE event_type <> 'view'")
def udf_pipe(t):
    return piped_map(t.events, "grep -v ^view", "event_type", "user_id", accept=(0, 1))


@query("pipe_uniq", "SELECT DISTINCT event_type || chr(9) || CAST(user_id AS VARCHAR) AS value FROM events")
def pipe_uniq(t):
    # The program runs twice: as a combiner over sorted partitions, then over all rows of a key.
    rows = t.events.select("event_type", "user_id").sortWithinPartitions("event_type", "user_id")
    kind = F.split("value", "\t")
    once = piped_map(rows, "uniq", "event_type", "user_id").select(kind[0].alias("event_type"), kind[1].cast("bigint").alias("user_id"))
    return piped_reduce(once, "uniq", "event_type", "user_id")


@query("pipe_value_count", "SELECT event_type AS key, count(*) AS n FROM events GROUP BY event_type")
def pipe_value_count(t):
    # A program counts the lines of each key in its partition; a second one adds up the few counts of a key.
    count = "awk -F'\t' '{ n[$1]++ } END { for (k in n) print k \"\t\" n[k] }'"
    add = "awk -F'\t' '{ n[$1] += $2 } END { for (k in n) print k \"\t\" n[k] }'"
    cells = F.split("value", "\t")
    counted = piped_map(t.events, count, "event_type").select(cells[0].alias("key"), cells[1].alias("n"))
    return piped_reduce(counted, add, "key", "n").select(cells[0].alias("key"), cells[1].cast("bigint").alias("n"))
