"""Operators of a training-data pipeline: filters, deduplication, scoring, tokens and shards.

Each module holds one operator with its own general interface; ``queries`` applies them to the
given tables. Nothing outside this package imports it.
"""

from pyspark import cloudpickle

import gatherum

# Python workers may start in another folder: send the package's functions along by value.
cloudpickle.register_pickle_by_value(gatherum)
