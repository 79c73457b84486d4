"""Column expressions over bookings and events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stayflow import fixed_values as V


def iso_date(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def iso_timestamp(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def money(c: Column) -> Column:
    return c.cast("decimal(10,2)")


def booking_key(ts: Column, property_id: Column) -> Column:
    return F.concat(F.lit("BK-"), F.date_format(ts, "yyyyMMddHHmmss"), F.lit("-"), property_id.cast("string"))


def nights(check_in: Column, check_out: Column) -> Column:
    return F.datediff(check_out, check_in)


def nights_shown(check_in: Column, check_out: Column) -> Column:
    return F.greatest(F.lit(0), nights(check_in, check_out))


def quote(price: Column, night_count: Column) -> Column:
    """Price for the stay, NULL unless it has at least one night."""
    return F.when(night_count > 0, price * night_count)


def amenity_list(text: Column) -> Column:
    """A JSON array of texts; anything else is an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def normal_key(c: Column) -> Column:
    """Trimmed lower case; blank counts as missing, so that it matches nothing."""
    cleaned = F.lower(F.trim(c))
    return F.when(cleaned != "", cleaned)


def days_left(end: Column, now: Column) -> Column:
    return F.floor((F.unix_timestamp(end) - F.unix_timestamp(now)) / 86400)


def parse_not_after(text: Column) -> Column:
    """UTC wall time of a certificate date; days may be padded with a blank."""
    single = F.regexp_replace(text, " +", " ")
    return F.try_to_timestamp(single, F.lit(V.NOT_AFTER_FORMAT)).cast("timestamp_ntz")


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the broken rules with commas between them, empty when none is. A NULL rule counts as broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.concat_ws(",", *broken)


def valid_email(c: Column) -> Column:
    return c.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def request_reasons() -> Column:
    """The broken rules of a request with commas between, empty when it can be taken."""
    return reasons({
        "id": F.col("id") != "", "property_id": F.col("property_id").isNotNull(), "guest_name": F.trim("guest_name") != "",
        "email": valid_email(F.col("email")), "guests": F.coalesce("guests", F.lit(1)) > 0, "check_in": F.col("check_in").isNotNull(),
        "check_out": F.col("check_out") > F.col("check_in"), "total_price": F.col("total_price") >= 0,
    })
