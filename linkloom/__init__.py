"""linkloom: collecting and curating links from feeds and web pages on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function.  Functions that
depend on the current time take an explicit ``as_of`` instead of reading the
clock, so that a run can be repeated and checked.
"""

__version__ = "0.1.0"
