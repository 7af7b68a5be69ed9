"""Operators for preparing large training-data corpora.

Each module holds one operator with a general interface; ``queries`` holds
the registered ``opN_<name>`` queries, which only read a table, call the
operator and choose columns.  Nothing outside this subpackage (and
``corpus_pipeline.py``, which counts as part of it) imports it.

Functions of this subpackage that run in tasks are pickled by value, so
executors need PySpark, numpy and pyarrow, but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
