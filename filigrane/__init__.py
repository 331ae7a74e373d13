"""filigrane: a Spark-first analytics engine for large collections of disclosure documents."""
