"""Thematic analysis of large document tables on Spark.

Every step is a function from DataFrame to DataFrame.  The language model is a
*responder*: a Python callable run on the executors, or a Spark ``Column``.
"""
