"""tessera: a Spark-first analytics engine for auditing and composing question benchmarks."""
