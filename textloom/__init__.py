"""textloom: building, mixing, auditing and evaluating text corpora on Spark."""
