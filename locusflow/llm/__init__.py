"""Training-data operators: dedup, filtering, redaction, packing, formatting and scoring."""
