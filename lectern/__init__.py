"""Catalogue, interaction and retrieval analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the jobs, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
