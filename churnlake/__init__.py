"""churnlake: customer-churn analytics as Spark DataFrame operators.

Every operator takes and returns a ``pyspark.sql.DataFrame`` (or a Column),
so Catalyst plans the whole chain; driver-side work is limited to bounded
metadata (column lists, category lists, fitted models).
"""

__version__ = "0.1.0"
