"""Training-data operators: each is a DataFrame -> DataFrame function with a thin registered query."""
