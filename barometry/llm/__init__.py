"""Operators for text corpora: counting, cleaning, deduplicating, scoring and packing.

Nothing outside this folder imports it.  Functions that run on the executors travel
there with the query, so that the executors need no copy of the package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
