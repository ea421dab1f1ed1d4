"""Price-pattern analytics over many symbols as Spark DataFrame transforms."""
