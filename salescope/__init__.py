"""salescope: sales analytics as lazy Spark DataFrame operators.

Every operator takes DataFrames and returns DataFrames, so it composes with
``df.transform`` and leaves planning to Catalyst. See ``README.md`` for a tour.
"""

__version__ = "0.1.0"
