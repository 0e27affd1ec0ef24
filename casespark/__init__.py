"""casespark: case-cohort building and prediction auditing on Spark DataFrames.

Every operator is a plain function ``DataFrame(s), params -> DataFrame``; nothing
is collected to the driver.  Sub-packages:

* ``sources``   – typed readers/writers and the adapter views over the test tables
* ``functions`` – reusable Column expressions (hash draws, list rendering, text rules)
* ``operators`` – cleaning, cohort, codes, rendering, responses, metrics, reports
* ``plans``     – composed end-to-end queries (the registry used by ``__spark_entry__``)
* ``streaming`` – incremental response ingestion (Structured Streaming)
"""

from casespark.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
