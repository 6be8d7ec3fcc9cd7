"""Booking no-show risk analytics on Spark.

Every public operator is a ``DataFrame -> DataFrame`` function built from
native Spark SQL expressions, so batch jobs and Structured Streaming
queries share the same code.
"""

__version__ = "0.1.0"
