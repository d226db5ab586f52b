"""Section-tally analytics as plain Spark DataFrame operators."""
