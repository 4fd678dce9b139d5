"""factline: Spark-first analytics over knowledge triples and repeated model-evaluation runs."""
