"""Dictionary compression of string columns with random access, on PySpark."""
