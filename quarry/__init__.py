"""quarry: a Spark-first analytics engine of lazy DataFrame and SQL operators."""
