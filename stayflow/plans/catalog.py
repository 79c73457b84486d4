"""The registered queries, each with the SQL that must give the same rows.

Dates are given as ISO text, sums of money are exact decimals turned into doubles at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


# The views of stayflow.sources.views in SQL.
STAYS = """stays AS (
  SELECT *, 'BK-' || l_orderkey || '-' || l_linenumber AS id, l_partkey AS property_id, l_linenumber AS guests,
         CAST(l_shipdate AS DATE) AS check_in,
         CAST(l_shipdate AS DATE) + (1 + CAST(l_quantity AS INTEGER) % 14) AS check_out,
         1 + CAST(l_quantity AS INTEGER) % 14 AS nights,
         CAST(l_extendedprice AS DECIMAL(10,2)) AS total_price
  FROM lineitem)"""

BOOKINGS = STAYS + """, bookings AS (
  SELECT s.id, s.property_id, s.guests, s.check_in, s.check_out, s.nights, s.total_price,
         o.o_custkey AS user_id, 'Guest ' || o.o_custkey AS guest_name,
         'guest' || o.o_custkey || '@example.com' AS email, '+48' || (500000000 + o.o_custkey) AS phone,
         CASE WHEN o.o_orderstatus = 'F' THEN 'confirmed' ELSE 'pending' END AS status,
         o.o_orderdate AS created_at
  FROM stays s JOIN orders o ON s.l_orderkey = o.o_orderkey)"""

NEWEST = ("l_shipdate DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, "
          "l_discount DESC, l_tax DESC")
OLDEST = "l_shipdate, l_extendedprice, l_partkey, l_suppkey, l_quantity, l_discount, l_tax"

MARKETING = """SELECT event_type AS event, CAST(user_id AS INTEGER) AS property_id,
       'guest' || user_id || '@example.com' AS guest_email, value AS booking_value,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp"
FROM events"""
