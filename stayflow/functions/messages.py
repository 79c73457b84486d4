"""Decoding of incoming JSON messages and building of outgoing ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayflow import fixed_values as V
from stayflow import schemas
from stayflow.functions import scalars as X


def parse(messages: DataFrame, schema: T.StructType, keep: list[str] | None = None) -> DataFrame:
    """The fields of the JSON text in `value`, each NULL when the text is unreadable.

    `inline` keeps Spark from copying the parser into every later expression and filter that uses a field,
    so each text is parsed once.
    """
    return messages.select(*(keep or []), F.inline(F.array(F.from_json("value", schema))))


def decode_marketing(messages: DataFrame) -> DataFrame:
    """The five read fields of a marketing message."""
    return parse(messages, schemas.MARKETING)


def with_event_time(decoded: DataFrame) -> DataFrame:
    """Add `event_time`; a bad or missing time is NULL and belongs to no window."""
    return decoded.withColumn("event_time", F.try_to_timestamp("timestamp"))


def read_booking(messages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Booking messages as text fields under their own names."""
    return parse(messages, schemas.BOOKING_TEXT, keep)


def cast_booking(raw: DataFrame) -> DataFrame:
    """Typed booking columns with defaults, and the reasons why a record is rejected.

    Required values that are missing or cannot be cast reject their record only.
    """
    typed = {
        "property_id": F.col("property_id").try_cast("long"),
        "guests": F.coalesce(F.col("guests"), F.lit(str(V.DEFAULT_GUESTS))).try_cast("int"),
        "check_in": F.col("check_in").try_cast("date"),
        "check_out": F.col("check_out").try_cast("date"),
        "nights": F.col("nights").try_cast("int"),
        "total_price": F.col("total_price").try_cast("decimal(10,2)"),
        "description": F.coalesce(F.col("description"), F.lit("")),
    }
    needed = ["booking_id", "property_id", "guest_name", "email", "guests", "check_in", "check_out", "nights", "total_price"]
    return raw.withColumns(typed).withColumn("rejected", X.reasons({n: F.col(n).isNotNull() for n in needed}))


def accepted(cast: DataFrame) -> DataFrame:
    return cast.filter(F.col("rejected") == "").drop("rejected")


def rejects(cast: DataFrame) -> DataFrame:
    return cast.filter(F.col("rejected") != "")


def dedup_key() -> Column:
    return F.coalesce(F.col("event_id"), F.col("booking_id"), F.lit(V.DEFAULT_KEY))


def with_dedup_key(messages: DataFrame) -> DataFrame:
    """Add the key by which a repeated message is known, without reading the rest of the message."""
    ids = T.StructType([f for f in schemas.BOOKING_TEXT.fields if f.name in ("event_id", "booking_id")])
    found = parse(messages, ids, messages.columns)
    return found.withColumn("dedup_key", dedup_key()).drop("event_id", "booking_id")


def recipient() -> Column:
    return F.coalesce(F.col("email"), F.col("guest_email"))


def _amount() -> Column:
    return F.col("total_price").cast("double")


def booking_payload(sent_at: Column) -> Column:
    return F.to_json(
        F.struct(
            F.lit(V.EVENT_BOOKING).alias("event"), F.col("id").alias("booking_id"), "property_id", "guest_name",
            "email", "phone", X.iso_date("check_in").alias("check_in"), X.iso_date("check_out").alias("check_out"),
            "nights", _amount().alias("total_price"), X.iso_timestamp(sent_at).alias("timestamp"),
        )
    )


def invoice_payload() -> Column:
    return F.to_json(
        F.struct(
            F.lit(V.EVENT_INVOICE).alias("event"), F.col("id").alias("booking_id"), "email", "guest_name",
            _amount().alias("total_price"), "property_id", X.iso_date("check_in").alias("check_in"),
            X.iso_date("check_out").alias("check_out"),
        )
    )


def marketing_payload(sent_at: Column) -> Column:
    return F.to_json(
        F.struct(
            F.lit(V.EVENT_MARKETING).alias("event"), "property_id", F.col("email").alias("guest_email"), "guest_name",
            _amount().alias("booking_value"), X.iso_timestamp(sent_at).alias("timestamp"),
        )
    )


def fan_out(bookings: DataFrame, sent_at: str = "created_at", keep: list[str] | None = None) -> DataFrame:
    """Three messages per booking, built in one pass over the bookings, with the columns to keep.

    Booking and invoice messages are keyed by booking, marketing messages by property.
    """
    sent = F.col(sent_at)

    def message(topic: str, key: Column, value: Column) -> Column:
        return F.struct(F.lit(topic).alias("topic"), key.cast("string").alias("key"), value.alias("value"))

    three = F.array(
        message(V.TOPIC_BOOKINGS, F.col("id"), booking_payload(sent)),
        message(V.TOPIC_INVOICES, F.col("id"), invoice_payload()),
        message(V.TOPIC_MARKETING, F.col("property_id"), marketing_payload(sent)),
    )
    return bookings.select(*(keep or []), F.inline(three))


def fill(template: str, *values: Column) -> Column:
    """The template with its %s replaced in order; plain concatenation, which is faster than a formatter."""
    pieces = template.split("%s")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        parts += [value.cast("string"), F.lit(piece)]
    return F.concat(*parts)


MAIL_FIELDS = T.StructType(
    [f for f in schemas.BOOKING_TEXT.fields
     if f.name in ("booking_id", "guest_name", "email", "guest_email", "check_in", "check_out", "total_price")]
)


def _mails(number: Column, guest: Column, check_in: Column, check_out: Column, price: Column, brand: str, to: dict[str, Column]) -> dict[str, Column]:
    """By topic, the mail that its messages call for, from the texts in a message; `to` names the recipients."""
    name, sender = F.coalesce(guest, F.lit(V.DEFAULT_GUEST_NAME)), F.lit(brand)
    texts = {
        V.TOPIC_BOOKINGS: (fill(V.CONFIRMATION_SUBJECT, number), fill(V.CONFIRMATION_BODY, name, check_in, check_out, sender)),
        V.TOPIC_INVOICES: (fill(V.INVOICE_SUBJECT, sender, number), fill(V.INVOICE_BODY, name, number, price, sender)),
        V.TOPIC_MARKETING: (F.lit(V.MARKETING_SUBJECT), fill(V.MARKETING_BODY, name)),
    }
    return {t: F.struct(to[t].alias("recipient"), subject.alias("subject"), body.alias("body")) for t, (subject, body) in texts.items()}


def outbox(messages: DataFrame, brand: str = V.BRAND) -> DataFrame:
    """One mail per message, with the text that its topic calls for.

    A message that lacks a field its text needs gives a mail without that text, which is not to be sent.
    """
    to = {V.TOPIC_BOOKINGS: recipient(), V.TOPIC_INVOICES: recipient(), V.TOPIC_MARKETING: F.coalesce("guest_email", "email")}
    mails = _mails(F.col("booking_id"), F.col("guest_name"), F.col("check_in"), F.col("check_out"), F.col("total_price"), brand, to)
    topic = F.col("topic")
    mail = F.when(topic == V.TOPIC_BOOKINGS, mails[V.TOPIC_BOOKINGS]).when(topic == V.TOPIC_INVOICES, mails[V.TOPIC_INVOICES]).otherwise(
        mails[V.TOPIC_MARKETING])
    known = messages.filter(topic.isin(V.TOPICS))
    return parse(known, MAIL_FIELDS, ["topic"]).select("topic", mail.alias("mail")).select("topic", "mail.*")


def booking_mails(bookings: DataFrame, brand: str = V.BRAND) -> DataFrame:
    """The rows of `outbox(fan_out(bookings))`, without writing each booking into three JSON texts and reading them again."""
    to = dict.fromkeys(V.TOPICS, F.col("email"))
    # A message carries the price as a JSON number, whose text is that of the double.
    mails = _mails(F.col("id"), F.col("guest_name"), X.iso_date("check_in"), X.iso_date("check_out"), _amount(), brand, to)
    told = [F.struct(F.lit(t).alias("topic"), *(m[c].alias(c) for c in ("recipient", "subject", "body"))) for t, m in mails.items()]
    return bookings.select(F.inline(F.array(*told)))


def route(event_type: Column, routes: dict[str, str]) -> Column:
    """Topic of an event type; NULL for a type that no handler takes."""
    result = F.lit(None).cast("string")
    for kind, topic in routes.items():
        result = F.when(event_type == kind, topic).otherwise(result)
    return result
