"""Check-consistency analytics on Spark."""
