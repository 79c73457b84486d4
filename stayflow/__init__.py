"""Booking-event analytics for short-stay rentals, written as Spark jobs."""
