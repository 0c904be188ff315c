"""churnlift: customer-value, churn-labelling and uplift analytics on Spark.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects
and leaves physical planning to Catalyst and AQE.  Column names are
parameters with defaults that follow the canonical retail schema
(FACT_ORDER_TABLE, FACT_OPERATION_TABLE, PRODUCT_MASTER, STORE_MASTER,
USER_MASTER).
"""

__version__ = "0.1.0"
