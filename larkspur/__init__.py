"""A small relational engine and training-data operators on PySpark."""
