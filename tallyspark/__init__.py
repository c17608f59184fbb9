"""Source-line analytics on Spark: scan, classify, aggregate, compare, report."""
