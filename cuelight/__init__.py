"""cuelight: batch retrieval and evaluation over timed multi-modal tables, on Spark."""
