"""Joins, checks, calendars and figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayflow import fixed_values as V
from stayflow.functions import scalars as X
from stayflow.functions.privacy import Viewer, mask_bookings
from stayflow.operators import calendars, integrity, kpis
from stayflow.operators.joins import lookup_join
from stayflow.plans.catalog import BOOKINGS, STAYS, query
from stayflow.sources import views
from stayflow.sources.tables import table
from stayflow.streaming.revenue import revenue_batch


@query("""SELECT p_partkey AS id, p_name AS name, coalesce(n_name, '🏠') AS image,
       coalesce(4.0::DOUBLE + n_regionkey / 10.0::DOUBLE, 4.8::DOUBLE) AS rating
FROM part LEFT JOIN nation ON n_nationkey = p_size""")
def property_enrich(spark, sf_dir):
    shown = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("guests"), F.col("n_name").alias("image"),
        (F.lit(4.0) + F.col("n_regionkey") / F.lit(10.0)).alias("rating"),
    )
    joined = lookup_join(views.properties(spark, sf_dir), shown, ["guests"], "left")
    return joined.select(
        "id", "name", F.coalesce("image", F.lit(V.DEFAULT_IMAGE)).alias("image"),
        F.coalesce("rating", F.lit(V.DEFAULT_RATING)).alias("rating"),
    )


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def existing_users(spark, sf_dir):
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return integrity.existing_keys(table(spark, sf_dir, "customer"), "c_custkey", done, "o_custkey").select("c_custkey", "c_name")


@query("""SELECT l_partkey AS property_id, count(*) AS refs FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO') GROUP BY ALL""")
def fk_orphans(spark, sf_dir):
    listed = views.properties(spark, sf_dir).filter("kind <> 'PROMO'")
    return integrity.orphan_references(views.stays(spark, sf_dir), "property_id", listed, "id")


@query("SELECT o_orderkey, (SELECT max(c_name) FROM customer WHERE c_custkey = o_custkey) AS username FROM orders")
def scalar_subquery_username(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").alias("o")
    names = (
        table(spark, sf_dir, "customer").where(F.col("c_custkey") == F.col("o_custkey").outer())
        .select(F.max("c_name")).scalar()
    )
    return orders.select("o_orderkey", names.alias("username"))


@query("SELECT l_orderkey, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return integrity.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey"])


DAYS = """days AS (
  SELECT id, property_id, unnest(generate_series(check_in::TIMESTAMP, (check_out - {less})::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day
  FROM stays)"""


@query(f"""WITH {STAYS}, {DAYS.format(less=0)}, taken AS (SELECT day, count(*) AS booked FROM days GROUP BY ALL),
months AS (SELECT DISTINCT date_trunc('month', d)::DATE AS month FROM (SELECT check_in AS d FROM stays UNION ALL SELECT check_out FROM stays)),
cal AS (SELECT unnest(generate_series(month::TIMESTAMP, (month + INTERVAL 1 MONTH - INTERVAL 1 DAY)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM months)
SELECT CAST(day AS VARCHAR) AS day, (isodow(day) - 1)::INTEGER AS weekday, coalesce(booked, 0) AS booked,
       CASE WHEN day < DATE '1998-01-01' THEN 'past' WHEN booked > 0 THEN 'booked'
            WHEN day IN (DATE '2001-12-24', DATE '2001-11-30') THEN 'selected' ELSE 'free' END AS status
FROM cal LEFT JOIN taken USING (day)""")
def availability_calendar(spark, sf_dir):
    stays = views.stays(spark, sf_dir)
    months = stays.select(F.explode(F.array(F.trunc("check_in", "month"), F.trunc("check_out", "month"))).alias("month"))
    days = calendars.date_dimension(months, F.lit("1998-01-01").cast("date"))
    shown = calendars.availability(days, calendars.occupied_days(stays, []), [], ["2001-12-24", "2001-11-30"])
    return shown.select(X.iso_date("day").alias("day"), "weekday", "booked", "status")


@query(f"""WITH {STAYS}, {DAYS.format(less=0)}
SELECT property_id, CAST(day AS VARCHAR) AS day, count(*) AS booked FROM days GROUP BY ALL""")
def availability_by_property(spark, sf_dir):
    taken = calendars.occupied_days(views.stays(spark, sf_dir), ["property_id"])
    return taken.select("property_id", X.iso_date("day").alias("day"), "booked")


@query(f"""WITH {STAYS}, {DAYS.format(less=1)}
SELECT property_id, count(DISTINCT CASE WHEN day BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' THEN day END) AS booked_days,
       count(DISTINCT CASE WHEN day BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' THEN day END)::DOUBLE / 1827::DOUBLE AS occupancy
FROM days GROUP BY ALL""")
def occupancy_rate(spark, sf_dir):
    return calendars.occupancy(views.stays(spark, sf_dir), "property_id", "1996-01-01", "2000-12-31")


@query(f"""WITH {STAYS}, daily AS (
  SELECT property_id, check_in, count(*) AS bookings, max(check_out) AS latest_out FROM stays GROUP BY ALL),
checked AS (SELECT *, max(latest_out) OVER (PARTITION BY property_id ORDER BY check_in
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS taken_until FROM daily)
SELECT property_id, CAST(check_in AS VARCHAR) AS check_in, bookings, CAST(taken_until AS VARCHAR) AS taken_until,
       CASE WHEN taken_until > check_in THEN 'earlier stay' ELSE 'same day' END AS conflict
FROM checked WHERE taken_until > check_in OR bookings > 1""")
def overlapping_bookings(spark, sf_dir):
    found = integrity.double_bookings(views.stays(spark, sf_dir))
    return found.withColumns({"check_in": X.iso_date("check_in"), "taken_until": X.iso_date("taken_until")})


WINDOWS = """windows AS (
  SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end,
         CAST(user_id AS INTEGER) AS property_id, count(*) AS booking_count,
         CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total_revenue,
         CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / count(value) AS avg_booking_value
  FROM events GROUP BY ALL)"""


@query(f"WITH {WINDOWS} SELECT * FROM windows")
def revenue_windows_batch(spark, sf_dir):
    return revenue_batch(views.marketing_messages(table(spark, sf_dir, "events")))


KPIS = """SELECT count(*) AS bookings, CAST(coalesce(sum({visible}), 0) AS DOUBLE) AS revenue,
       least(95, count(*) * 5)::BIGINT AS occupancy_pct FROM bookings"""


@query(f"WITH {BOOKINGS} " + KPIS.format(visible="total_price"))
def dashboard_kpis(spark, sf_dir):
    return kpis.dashboard(mask_bookings(views.bookings(spark, sf_dir), Viewer(role="admin")))


@query(f"WITH {BOOKINGS} " + KPIS.format(visible="CASE WHEN user_id = 7 THEN total_price END"))
def dashboard_kpis_guest(spark, sf_dir):
    return kpis.dashboard(mask_bookings(views.bookings(spark, sf_dir), Viewer(user_id=7)))


@query("SELECT count(*) AS bookings, count(*) FILTER (WHERE o_orderstatus = 'O') AS orphans FROM orders")
def orphan_count(spark, sf_dir):
    owner = F.when(F.col("o_orderstatus") != "O", F.col("o_custkey"))
    return table(spark, sf_dir, "orders").agg(
        F.count(F.lit(1)).alias("bookings"), F.count_if(owner.isNull()).alias("orphans")
    )


@query("""SELECT coalesce(event_type, 'all') AS campaign, coalesce(strftime(ts, '%Y-%m-%d'), 'all') AS day, count(*) AS events,
       CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total_value
FROM events GROUP BY ROLLUP (event_type, strftime(ts, '%Y-%m-%d'))""")
def campaign_rollup(spark, sf_dir):
    return kpis.campaign_rollup(table(spark, sf_dir, "events"))


@query(f"""WITH {BOOKINGS}, m AS (SELECT *, strftime(check_in, '%Y-%m') AS month FROM bookings)
SELECT coalesce(property_id, -1) AS property_id, coalesce(month, 'all') AS month, coalesce(status, 'all') AS status,
       count(*) AS bookings, sum(nights)::BIGINT AS nights, CAST(sum(total_price) AS DOUBLE) AS revenue
FROM m GROUP BY ROLLUP (property_id, month, status)""")
def property_report(spark, sf_dir):
    return kpis.property_report(views.bookings(spark, sf_dir))
