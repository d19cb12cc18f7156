"""Column functions: text, hashing and score helpers built from Spark built-ins."""
