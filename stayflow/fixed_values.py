"""Texts, thresholds and formats that results must match exactly."""

# Topics.
TOPIC_BOOKINGS = "bookings-created"
TOPIC_INVOICES = "email-invoices"
TOPIC_MARKETING = "marketing-actions"
TOPICS = [TOPIC_BOOKINGS, TOPIC_INVOICES, TOPIC_MARKETING]

# Event names on the three topics.
EVENT_BOOKING = "booking_created"
EVENT_INVOICE = "invoice_request"
EVENT_MARKETING = "new_booking"

# Defaults used when a field is missing.
DEFAULT_GUESTS = 2
DEFAULT_GUEST_NAME = "Gosc"
DEFAULT_KEY = "unknown"
DEFAULT_IMAGE = "🏠"
DEFAULT_RATING = 4.8
STATUS_PENDING = "pending"
STATUS_CONFIRMED = "confirmed"
PIPELINE_LABEL = "Redis -> Kafka -> PostgreSQL"

# Labels shown in place of another guest's data.
MASKED_NAME = "Zastrzeżone (dane gościa ukryte)"
MASKED_EXPORT_NAME = "ZASTRZEŻONE"

# Header of the booking export.
EXPORT_HEADER = ["ID", "Nieruchomość", "Gość", "Email", "Check-in", "Check-out", "Nocy", "Kwota", "Status"]

# Mail texts. %s are filled in the order given; the brand is a parameter.
CONFIRMATION_SUBJECT = "Potwierdzenie rezerwacji nr %s"
CONFIRMATION_BODY = (
    "Cześć %s,\n\n"
    "Twoja rezerwacja (%s - %s) została potwierdzona.\n"
    "W załączeniu (proforma) prosimy o dokonanie płatności przed przyjazdem.\n\n"
    "Pozdrawiamy,\n%s"
)
MARKETING_SUBJECT = "Sprawdź nasze najnowsze oferty!"
MARKETING_BODY = "Cześć %s, mamy dla Ciebie nowe promocje na pobyty krótkoterminowe."
INVOICE_SUBJECT = "Faktura Proforma - %s - %s"
INVOICE_BODY = (
    "Witaj %s!\n\nTwoja rezerwacja zostala potwierdzona.\nNumer: %s\nKwota: %s zl\n\n"
    "Faktura proforma. Prosze o platnosc w terminie 24h.\n\nPozdrawiamy,\nZespol %s"
)
BRAND = "Stayflow"

# Starting catalogue (id, name, location, price, guests, description, amenities).
SEED_PROPERTIES = [
    (1, "Apartament Premium - Warszawa", "warsaw", "450.00", 4, "Luksusowy apartament w centrum",
     '["WiFi","Klimatyzacja","Balkon","Parking"]'),
    (2, "Studio Modern - Krakow", "krakow", "320.00", 2, "Stylowe studio obok Rynku",
     '["WiFi","Smart TV","Kuchnia"]'),
    (3, "Villa nad Morzem - Gdansk", "gdansk", "680.00", 6, "Willa 200m od plazy",
     '["WiFi","Ogrodek","Grill","Parking"]'),
    (4, "Loft Industrial - Wroclaw", "wroclaw", "280.00", 3, "Industrialny loft",
     '["WiFi","Projektor","Klimatyzacja"]'),
    (5, "Penthouse View - Warszawa", "warsaw", "850.00", 4, "Ekskluzywny penthouse",
     '["WiFi","Basen","Silownia","Concierge"]'),
    (6, "Apartament Royal - Krakow", "krakow", "390.00", 4, "Elegancki apartament w Kazimierzu",
     '["WiFi","Klimatyzacja","Balkon"]'),
]

# Offset metric in the metrics text.
OFFSET_METRIC = "kafka_topic_partition_current_offset"

# Date text of a certificate's end of validity, and the texts of its metrics.
NOT_AFTER_FORMAT = "MMM d HH:mm:ss yyyy 'GMT'"
CERT_HEADER = [
    "# HELP cert_not_after_seconds Czas wygasniecia certyfikatu (unix).",
    "# TYPE cert_not_after_seconds gauge",
    "# HELP cert_days_remaining Dni do wygasniecia certyfikatu.",
    "# TYPE cert_days_remaining gauge",
]
CERT_SECONDS_LINE = 'cert_not_after_seconds{secret="%s"} %d'
CERT_DAYS_LINE = 'cert_days_remaining{secret="%s"} %d'

# Version prefix of encrypted values.
CIPHER_PREFIX = "vault:v"
CIPHER_VERSION_PATTERN = r"^vault:v(\d+):"

# Lengths of login and password.
MIN_LOGIN = 3
MIN_PASSWORD = 6

# Seconds kept by the key-value entries.
TTL_PROCESSED = 86400
TTL_BOOKING = 3600

# Retention and staleness in days.
RETENTION_DAYS = 14
STALE_DAYS = 35
STALE_HOLD_SECONDS = 3600

# Event time window, watermark and trigger of the revenue stream.
WINDOW = "5 minutes"
WATERMARK = "10 minutes"
TRIGGER = "10 seconds"

# Alert notification timing.
GROUP_WAIT_SECONDS = 30
GROUP_INTERVAL_SECONDS = 5 * 60
REPEAT_INTERVAL_SECONDS = 4 * 3600
RESOLVE_TIMEOUT_SECONDS = 5 * 60
#: A series without samples for this long is no longer true.
STALENESS = "5 minutes"
