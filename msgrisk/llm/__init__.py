"""Training-data operators: formatting, dedup, filters, scoring, tokens and packing."""
