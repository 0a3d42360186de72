"""Spark jobs for lattice-model and disordered-system data."""

import sys

from pyspark import cloudpickle

#: Functions that run on executors travel with the task, so executors needn't have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
