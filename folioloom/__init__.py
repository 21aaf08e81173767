"""Corpus digests on Spark: select files or rows, classify, clean, count, order and write them."""

import sys

from pyspark import cloudpickle

from folioloom.config import Processing, Rendering, Selection
from folioloom.plans.digest import Digest

__all__ = ["Digest", "Processing", "Rendering", "Selection"]

# The few functions that run in Python workers travel with the tasks, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
