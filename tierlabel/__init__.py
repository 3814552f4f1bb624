"""Product classification on Spark: table preparation, text vectors, voting and evaluation."""
