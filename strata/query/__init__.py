"""The search language: parsing, translation to Spark SQL and planning."""
