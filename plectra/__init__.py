"""Contact-matrix analytics and corpus preparation as plain Spark DataFrame plans."""
