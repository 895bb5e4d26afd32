"""chartloom: record-set operators for clinical documents, written for Spark.

Every operator takes DataFrames and returns DataFrames (or a ``(good, failed)``
pair).  Nothing in the library collects rows to the driver, and all order
dependent operators take an explicit ordinal column, because a distributed
input has no row order of its own.
"""

import sys

from pyspark import cloudpickle

from chartloom.session import checkpoint_folder, get_session

__all__ = ["checkpoint_folder", "get_session"]

# Python steps travel to the executors with their code: nothing to install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
