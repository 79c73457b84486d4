"""Projections, filters and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayflow import fixed_values as V
from stayflow.functions import scalars as X
from stayflow.operators import calendars
from stayflow.functions.scalars import request_reasons
from stayflow.operators.joins import lookup_join
from stayflow.plans.catalog import BOOKINGS, STAYS, query
from stayflow.sources import views
from stayflow.sources.tables import table

# Requests as guests type them: some end before they begin.
REQUEST = "CAST(l_shipdate AS DATE) + (CAST(l_quantity AS INTEGER) % 14 - 3)"


def _requests(spark, sf_dir) -> DataFrame:
    check_in = F.to_date("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("property_id"), check_in.alias("check_in"),
        F.date_add(check_in, F.col("l_quantity").cast("int") % 14 - 3).alias("check_out"),
    )


def optional_property(rows: DataFrame, property_id: int | None) -> DataFrame:
    """All bookings, or those of one property."""
    return rows if property_id is None else rows.filter(F.col("property_id") == property_id)


@query(f"WITH {STAYS} SELECT id, property_id, nights FROM stays")
def bookings_optional_filter(spark, sf_dir):
    return optional_property(views.stays(spark, sf_dir), None).select("id", "property_id", "nights")


@query(f"WITH {STAYS} SELECT id, property_id, nights FROM stays WHERE property_id = 17")
def bookings_of_property(spark, sf_dir):
    return optional_property(views.stays(spark, sf_dir), 17).select("id", "property_id", "nights")


@query("SELECT event_id, 'BK-' || strftime(ts, '%Y%m%d%H%M%S') || '-' || user_id AS booking_id FROM events")
def booking_key(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", X.booking_key(F.col("ts"), F.col("user_id")).alias("booking_id"))


@query(f"""SELECT l_orderkey, l_linenumber, date_diff('day', CAST(l_shipdate AS DATE), {REQUEST})::INTEGER AS nights,
       greatest(0, date_diff('day', CAST(l_shipdate AS DATE), {REQUEST}))::INTEGER AS nights_shown FROM lineitem""")
def booking_nights(spark, sf_dir):
    dates = F.col("check_in"), F.col("check_out")
    return _requests(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", X.nights(*dates).alias("nights"), X.nights_shown(*dates).alias("nights_shown")
    )


@query(f"""WITH r AS (SELECT *, date_diff('day', CAST(l_shipdate AS DATE), {REQUEST}) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, property_id, n::INTEGER AS nights,
       CASE WHEN n > 0 THEN CAST(CAST(p_retailprice AS DECIMAL(10,2)) * n AS DOUBLE) END AS total
FROM (SELECT *, l_partkey AS property_id FROM r) JOIN part ON p_partkey = property_id""")
def price_quote(spark, sf_dir):
    prices = views.properties(spark, sf_dir).select(F.col("id").alias("property_id"), "price")
    n = X.nights(F.col("check_in"), F.col("check_out"))
    quoted = lookup_join(_requests(spark, sf_dir), prices, ["property_id"])
    return quoted.select(
        "l_orderkey", "l_linenumber", "property_id", n.alias("nights"), X.quote(F.col("price"), n).cast("double").alias("total")
    )


@query("""SELECT p_partkey AS id, CASE WHEN p_type = 'PROMO' THEN 0 ELSE 2 END AS amenity_count,
       CASE WHEN p_type = 'PROMO' THEN '' ELSE p_type || '|' || p_brand END AS amenities FROM part""")
def property_amenities(spark, sf_dir):
    # Promotions hold something that is not an array.
    stored = F.when(F.col("kind") == "PROMO", F.lit('{"wifi":true')).otherwise(F.col("amenities"))
    parsed = X.amenity_list(stored)
    return views.properties(spark, sf_dir).select(
        "id", F.size(parsed).alias("amenity_count"), F.concat_ws("|", parsed).alias("amenities")
    )


@query("""WITH r AS (
  SELECT c_custkey, trim('  ' || split_part(c_name, '#', 1) || ' ') AS login, c_mktsegment AS password,
         CASE WHEN c_acctbal < 0 THEN c_name ELSE 'guest' || c_custkey || '@example.com' END AS email,
         CASE WHEN c_nationkey < 12 THEN CAST(c_nationkey AS VARCHAR) ELSE 'n' || c_nationkey END AS guests FROM customer)
SELECT c_custkey, concat_ws(',', CASE WHEN length(login) < 9 THEN 'login' END, CASE WHEN length(password) < 9 THEN 'password' END,
         CASE WHEN email NOT LIKE '%@%' THEN 'email' END, CASE WHEN guests LIKE 'n%' THEN 'guests' END) AS reasons,
       length(login) >= 9 AND length(password) >= 9 AND email LIKE '%@%' AND guests NOT LIKE 'n%' AS valid FROM r""")
def validate_rows(spark, sf_dir):
    users = table(spark, sf_dir, "customer")
    login = F.trim(F.concat(F.lit("  "), F.split("c_name", "#")[0], F.lit(" ")))
    email = F.when(F.col("c_acctbal") < 0, F.col("c_name")).otherwise(views.guest_email(F.col("c_custkey")))
    guests = F.when(F.col("c_nationkey") < 12, F.col("c_nationkey").cast("string")).otherwise(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    )
    checked = X.reasons(registration_rules(login, F.col("c_mktsegment"), email, guests, min_login=9, min_password=9))
    return users.select("c_custkey", checked.alias("reasons"), (checked == "").alias("valid"))


@query(f"""WITH {STAYS}, r AS (
  SELECT id, l_orderkey, l_shipdate, property_id, CASE WHEN l_tax > 0.01 THEN check_in END AS d_in,
         CASE WHEN l_linenumber = 6 THEN check_in WHEN l_tax > 0 THEN check_out END AS d_out,
         CASE WHEN l_discount = 0 THEN -total_price WHEN l_discount < 0.1 THEN total_price END AS price,
         CASE WHEN l_returnflag = 'R' THEN 'nobody' ELSE 'guest' || l_suppkey || '@example.com' END AS email,
         CASE WHEN l_quantity < 40 THEN CAST(l_quantity AS INTEGER) - 3 END AS guests FROM stays)
SELECT id, l_shipdate, concat_ws(',', CASE WHEN NOT coalesce(email <> 'nobody', false) THEN 'email' END,
         CASE WHEN coalesce(guests, 1) <= 0 THEN 'guests' END, CASE WHEN d_in IS NULL THEN 'check_in' END,
         CASE WHEN NOT coalesce(d_out > d_in, false) THEN 'check_out' END, CASE WHEN NOT coalesce(price >= 0, false) THEN 'total_price' END) AS reasons
FROM r""")
def validate_requests(spark, sf_dir):
    """Rules on dates, price and address of a booking request, and the number of guests that may be absent."""
    stays = views.with_stay_columns(table(spark, sf_dir, "lineitem"))
    tax, discount = F.col("l_tax"), F.col("l_discount")
    asked = stays.select(
        "id", "l_shipdate", "property_id", F.lit("Guest").alias("guest_name"),
        F.when(F.col("l_returnflag") == "R", "nobody").otherwise(views.guest_email(F.col("l_suppkey"))).alias("email"),
        F.when(F.col("l_quantity") < 40, F.col("l_quantity").cast("int") - 3).alias("guests"), F.when(tax > 0.01, F.col("check_in")).alias("check_in"),
        F.when(F.col("l_linenumber") == 6, F.col("check_in")).when(tax > 0, F.col("check_out")).alias("check_out"),
        F.when(discount == 0, -F.col("total_price")).when(discount < 0.1, F.col("total_price")).alias("total_price"))
    return asked.select("id", "l_shipdate", request_reasons().alias("reasons"))


def registration_rules(login, password, email, guests, min_login=V.MIN_LOGIN, min_password=V.MIN_PASSWORD) -> dict:
    return {
        "login": F.length(F.trim(login)) >= min_login,
        "password": F.length(password) >= min_password,
        "email": X.valid_email(email),
        "guests": guests.try_cast("int").isNotNull(),
    }


NOW = "1998-01-01 00:00:00"


@query(f"""SELECT o_orderkey, CAST(floor((epoch(o_orderdate) - epoch(TIMESTAMP '{NOW}')) / 86400) AS BIGINT) AS days
FROM orders WHERE o_orderstatus = 'F'""")
def days_remaining(spark, sf_dir):
    day = F.lpad(F.date_format("o_orderdate", "d"), 2, " ")
    written = F.concat(
        F.date_format("o_orderdate", "MMM "), day, F.date_format("o_orderdate", " HH:mm:ss yyyy 'GMT'")
    )
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", written.alias("not_after"))
    until = X.parse_not_after(F.col("not_after"))
    days = X.days_left(until, F.lit(NOW).cast("timestamp_ntz"))
    return orders.filter(F.col("not_after").isNotNull()).select("o_orderkey", days.alias("days"))


@query("""WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month FROM orders),
d AS (SELECT month, unnest(generate_series(month::TIMESTAMP, (month + INTERVAL 1 MONTH - INTERVAL 1 DAY)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM m)
SELECT strftime(month, '%Y-%m') AS month, CAST(day AS VARCHAR) AS day, (isodow(day) - 1)::INTEGER AS weekday,
       (isodow(month) - 1)::INTEGER AS first_offset, day < DATE '1998-01-01' AS is_past FROM d""")
def date_dimension(spark, sf_dir):
    months = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("month"))
    days = calendars.date_dimension(months, F.lit("1998-01-01").cast("date"))
    return days.select(
        F.date_format("month", "yyyy-MM").alias("month"), X.iso_date("day").alias("day"), "weekday", "first_offset", "is_past"
    )


@query("SELECT p_partkey AS id, p_name AS name FROM part ORDER BY p_partkey LIMIT 3")
def featured_properties(spark, sf_dir):
    return views.properties(spark, sf_dir).select("id", "name").orderBy("id").limit(3)


LISTING = f"""{BOOKINGS} SELECT b.id, b.property_id, p_name AS property_name, """


@query(f"""WITH {LISTING} CAST(check_in AS VARCHAR) AS check_in, CAST(check_out AS VARCHAR) AS check_out,
       CAST(total_price AS DOUBLE) AS total_price, status, created_at
FROM bookings b JOIN part ON p_partkey = b.property_id ORDER BY created_at DESC, id""")
def bookings_with_property(spark, sf_dir):
    listed = views.with_property(views.bookings(spark, sf_dir), views.properties(spark, sf_dir), views.stay_properties(spark, sf_dir))
    return listed.select(
        "id", "property_id", "property_name", X.iso_date("check_in").alias("check_in"),
        X.iso_date("check_out").alias("check_out"), F.col("total_price").cast("double").alias("total_price"),
        "status", "created_at",
    ).orderBy(F.col("created_at").desc(), "id")
