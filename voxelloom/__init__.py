"""Pattern search and patch analytics over 3-D sampled volumes, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from .schema import PatchShape
from .session import build_session

# Functions that run in Python workers travel with the job, so executors do
# not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["PatchShape", "build_session"]
