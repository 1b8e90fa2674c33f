"""Files, tables, stores and reports in and out of Spark."""
