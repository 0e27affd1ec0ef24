"""Operators of a training-data pipeline and their queries.

Nothing else in the library imports this subpackage.  ``queries()`` and
``oracle_sql()`` give what ``__spark_entry__`` registers.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value: their Python needs no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def queries() -> dict:
    from casespark.llm.plans import QUERIES
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from casespark.llm.plans import ORACLES
    return dict(ORACLES)
