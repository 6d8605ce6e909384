"""corploom: corpus analytics on Spark.

Subpackages: sources (readers), functions (column functions), operators
(DataFrame to DataFrame), plans (named queries and their SQL), streaming.
The subpackage for training-data text operators is optional; nothing here imports it.
"""

__version__ = "0.1.0"
