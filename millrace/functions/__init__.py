"""The scalar functions of the language as Spark columns."""
