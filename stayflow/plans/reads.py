"""Sources and decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayflow import fixed_values as V
from stayflow import schemas
from stayflow.functions import messages as M
from stayflow.functions import scalars as X
from stayflow.operators import writes
from stayflow.plans.catalog import MARKETING, query
from stayflow.session import work_dir
from stayflow.sources import streams, text, views
from stayflow.sources.tables import seed_catalogue, table
from stayflow.streaming.queries import batches, run_to_files

ROUTES = {"purchase": V.TOPIC_BOOKINGS, "click": V.TOPIC_INVOICES, "signup": V.TOPIC_MARKETING}
ROUTES_SQL = """CASE event_type WHEN 'purchase' THEN 'bookings-created' WHEN 'click' THEN 'email-invoices'
            WHEN 'signup' THEN 'marketing-actions' END"""


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def src_event_stream(spark, sf_dir):
    stream = streams.table_stream(spark, sf_dir, "events", schemas.EVENTS, streams.FILES_PER_BATCH)
    out = run_to_files(stream, "src-event-stream")
    return batches(spark, out, schemas.EVENTS).drop("batch")


@query(f"""WITH m AS (
  SELECT {ROUTES_SQL} AS topic, CAST(user_id AS VARCHAR) AS key,
         CAST(json_object('event', event_type, 'property_id', user_id,
           'guest_email', 'guest' || user_id || '@example.com', 'guest_name', 'Guest ' || user_id,
           'booking_value', value, 'timestamp', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')) AS VARCHAR) AS value
  FROM events)
SELECT topic, key, value FROM m WHERE topic IN ('bookings-created', 'marketing-actions')""")
def src_multi_topic(spark, sf_dir):
    topic = M.route(F.col("event_type"), ROUTES)
    messages = views.marketing_messages(table(spark, sf_dir, "events").filter(topic.isNotNull()), topic)
    root = f"{work_dir(spark, 'topics')}/messages"
    streams.write_file_topics(messages, root)
    stream = streams.file_topics(spark, root, [V.TOPIC_BOOKINGS, V.TOPIC_MARKETING], streams.FILES_PER_BATCH)
    out = run_to_files(stream, "src-multi-topic")
    return batches(spark, out, schemas.MESSAGE).drop("batch")


@query("""SELECT p_partkey AS id, p_name AS name, p_brand AS location,
       CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS DOUBLE) AS price, p_size AS guests
FROM part ORDER BY id""")
def properties_by_id(spark, sf_dir):
    rows = views.properties(spark, sf_dir)
    return rows.select("id", "name", "location", F.col("price").cast("double").alias("price"), "guests").orderBy("id")


@query(MARKETING)
def decode_marketing(spark, sf_dir):
    return M.decode_marketing(views.marketing_messages(table(spark, sf_dir, "events")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def decode_props(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def metric_lines(events: DataFrame) -> DataFrame:
    """Events as metrics text: offset lines of three topics between comments and other metrics."""
    topic = F.coalesce(
        F.when(F.col("event_type") == "click", "other-topic"), M.route(F.col("event_type"), ROUTES)
    )
    offset = F.format_string(
        V.OFFSET_METRIC + '{partition="%d",topic="%s"} %d', F.col("user_id"), topic, F.col("event_id")
    )
    line = (
        F.when(F.col("event_type") == "error", f"# HELP {V.OFFSET_METRIC} Current offset of a topic")
        .when(F.col("event_type") == "view", F.format_string("kafka_brokers %d", "event_id"))
        .otherwise(offset)
    )
    return events.select(line.alias("value"))


OFFSETS = """offsets AS (
  SELECT CASE event_type WHEN 'purchase' THEN 'bookings-created' WHEN 'click' THEN 'other-topic'
         WHEN 'signup' THEN 'marketing-actions' END AS topic, event_id AS "offset"
  FROM events WHERE event_type IN ('purchase', 'click', 'signup'))"""


@query(f'WITH {OFFSETS} SELECT topic, "offset" FROM offsets')
def metrics_text_parse(spark, sf_dir):
    return text.parse_offsets(metric_lines(table(spark, sf_dir, "events")))


@query(f"""WITH {OFFSETS}
SELECT t.topic, CAST(coalesce(sum(o."offset"), 0) AS BIGINT) AS offset_total
FROM (VALUES ('bookings-created'), ('email-invoices'), ('marketing-actions')) t(topic)
LEFT JOIN offsets o ON o.topic = t.topic GROUP BY t.topic
UNION ALL SELECT 'TOTAL', CAST(sum("offset") AS BIGINT) FROM offsets""")
def topic_offsets(spark, sf_dir):
    return text.topic_totals(text.parse_offsets(metric_lines(table(spark, sf_dir, "events"))), V.TOPICS)


@query("""SELECT 'containerlogs' AS job, role AS container, unnest(string_split(text, chr(10))) AS line
FROM conversations""")
def log_tail(spark, sf_dir):
    root = f"{work_dir(spark, 'log-tail')}/containers"
    turns = table(spark, sf_dir, "conversations").select("role", "text")
    turns.write.partitionBy("role").text(root)
    lines = text.log_stream(spark, root, "containerlogs", glob="*.txt")
    out = run_to_files(lines, "log-tail")
    read = batches(spark, out, lines.schema)
    return read.select("job", F.regexp_extract("file_path", "role=([^/]+)/", 1).alias("container"), "line")


SEED_VALUES = ", ".join(
    f"({i}, '{name}', '{place}', {price}, {guests})" for i, name, place, price, guests, _, _ in V.SEED_PROPERTIES
)


def _catalogue(rows: DataFrame) -> DataFrame:
    return rows.select("id", "name", "location", F.col("price").cast("double").alias("price"), "guests")


@query(f"""WITH old AS (
  SELECT p_partkey AS id, p_name AS name, p_brand AS location, CAST(p_retailprice AS DOUBLE) AS price, p_size AS guests
  FROM part WHERE p_type = 'ECONOMY'),
seed AS (SELECT * FROM (VALUES {SEED_VALUES}) s(id, name, location, price, guests))
SELECT id, name, location, price, guests FROM old
UNION ALL SELECT id, name, location, CAST(price AS DOUBLE), guests FROM seed
WHERE id NOT IN (SELECT id FROM old)""")
def seed_properties(spark, sf_dir):
    listed = views.properties(spark, sf_dir).filter(F.col("kind") == "ECONOMY")
    return writes.insert_if_absent(_catalogue(listed), _catalogue(seed_catalogue(spark)), "id", [F.col("name")])


@query(f"""SELECT 'listed' AS catalogue, p_partkey AS id, p_name AS name, p_brand AS location,
       CAST(p_retailprice AS DOUBLE) AS price, p_size AS guests FROM part
UNION ALL SELECT 'withdrawn', id, name, location, CAST(price AS DOUBLE), guests
FROM (VALUES {SEED_VALUES}) s(id, name, location, price, guests)
WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_retailprice < 0)""")
def seed_if_empty(spark, sf_dir):
    rows = views.properties(spark, sf_dir)
    seed = seed_catalogue(spark)
    listed = writes.seed_if_empty(rows, seed)
    withdrawn = writes.seed_if_empty(rows.filter(F.col("price") < 0), seed)
    return (
        _catalogue(listed).withColumn("catalogue", F.lit("listed"))
        .unionByName(_catalogue(withdrawn).withColumn("catalogue", F.lit("withdrawn")))
    )


@query("""SELECT c_custkey AS id, c_name AS username, 'guest' || c_custkey || '@example.com' AS email
FROM customer WHERE c_name = 'Customer#000000042'""")
def user_lookup(spark, sf_dir):
    return views.users(spark, sf_dir).filter(F.col("username") == "Customer#000000042").select("id", "username", "email")


@query(f"""SELECT event_id, {ROUTES_SQL} AS topic,
       CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'click' THEN 'invoice' ELSE 'market' END AS handler
FROM events WHERE event_type IN ('purchase', 'click', 'signup')""")
def route_by_topic(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("topic", M.route(F.col("event_type"), ROUTES))
    handler = (
        F.when(F.col("topic") == V.TOPIC_BOOKINGS, "confirm").when(F.col("topic") == V.TOPIC_INVOICES, "invoice")
        .otherwise("market")
    )
    return events.filter(F.col("topic").isNotNull()).select("event_id", "topic", handler.alias("handler"))


def _unless(kind: str, value: Column) -> Column:
    """The value, absent for one kind of event."""
    return F.when(F.col("event_type") != kind, value)


def booking_texts(events: DataFrame) -> DataFrame:
    """Events as booking messages with gaps and bad values, one kind of defect per event type."""
    kind = F.col("event_type")
    payload = F.struct(
        F.lit(V.EVENT_BOOKING).alias("event"),
        _unless("purchase", F.concat(F.lit("E-"), F.col("event_id").cast("string"))).alias("event_id"),
        F.concat(F.lit("BK-"), F.col("event_id").cast("string")).alias("booking_id"),
        F.col("user_id").alias("property_id"),
        _unless("view", F.lit("Guest")).alias("guest_name"),
        _unless("click", views.guest_email(F.col("user_id"))).alias("email"),
        F.lit("alt@example.com").alias("guest_email"),
        _unless("purchase", F.lit("+48500")).alias("phone"),
        _unless("signup", F.lit(3)).alias("guests"),
        F.when(kind == "error", "2024-13-01").otherwise(X.iso_date("ts")).alias("check_in"),
        X.iso_date(F.date_add("ts", 2)).alias("check_out"),
        F.lit(2).alias("nights"),
        F.when((kind == "error") & (F.col("value") > 50), "n/a").otherwise(F.col("value").cast("decimal(10,2)").cast("string")).alias("total_price"),
    )
    return events.select("event_id", F.to_json(payload).alias("value"))


@query("""SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN 'BK-' ELSE 'E-' END || event_id AS dedup_key,
       CASE WHEN event_type = 'click' THEN 'alt@example.com' ELSE 'guest' || user_id || '@example.com' END AS recipient,
       CASE WHEN event_type = 'view' THEN 'Gosc' ELSE 'Guest' END AS guest_name,
       CASE WHEN event_type <> 'purchase' THEN '+48500' END AS phone,
       CASE WHEN event_type = 'signup' THEN 2 ELSE 3 END AS guests, '' AS description
FROM events""")
def decode_with_defaults(spark, sf_dir):
    messages = booking_texts(table(spark, sf_dir, "events")).withColumnRenamed("event_id", "id")
    raw = M.read_booking(messages, ["id"])
    return M.cast_booking(raw).select(
        "id", M.dedup_key().alias("dedup_key"), M.recipient().alias("recipient"),
        F.coalesce("guest_name", F.lit(V.DEFAULT_GUEST_NAME)).alias("guest_name"), "phone", "guests", "description",
    )


@query("""SELECT event_id AS id,
       concat_ws(',', CASE WHEN event_type = 'view' THEN 'guest_name' END, CASE WHEN event_type = 'click' THEN 'email' END,
                 CASE WHEN event_type = 'error' THEN 'check_in' END,
                 CASE WHEN event_type = 'error' AND value > 50 THEN 'total_price' END) AS reasons
FROM events WHERE event_type IN ('view', 'click', 'error')""")
def decode_rejects(spark, sf_dir):
    messages = booking_texts(table(spark, sf_dir, "events")).withColumnRenamed("event_id", "id")
    bad = M.rejects(M.cast_booking(M.read_booking(messages, ["id"])))
    return bad.select("id", F.col("rejected").alias("reasons"))
