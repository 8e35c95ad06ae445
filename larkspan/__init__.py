"""larkspan: a Spark-first analytics engine for relational, statistical and graph work on large tables."""
