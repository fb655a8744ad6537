"""pawgrid — listing matching on Spark: filters, scores, vector top-k, text, pages, logs."""

__version__ = "0.1.0"
