"""fieldlark: a Spark-native analytics engine for multi-sensor field observations.

Column expressions live in ``functions``, DataFrame operators in ``operators``,
readers and fixed dimension tables in ``sources``, whole queries in ``plans`` and
Structured Streaming twins in ``streaming``.
"""

__version__ = "0.1.0"
