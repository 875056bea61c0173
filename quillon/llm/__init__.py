"""Operators for preparing language-model training data on Spark.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is there.
"""
