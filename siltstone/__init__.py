"""Spark-first analytics engine: relational helpers, versioned tables, ingestion and declarative pipelines."""
