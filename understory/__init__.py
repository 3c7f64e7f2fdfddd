"""Pixel-level canopy-height analytics as plain Spark DataFrame operators.

Scene observations, multi-band pixels and sparse laser-altimeter footprints are
ordinary tables; every operator takes and returns DataFrames and leaves physical
planning to Catalyst and adaptive execution.
"""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
