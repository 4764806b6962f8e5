"""Operators of a training-data pipeline: near copies, packing, leaks, licenses, chats, pages, quality, urls, repeats, language.

Functions that run in tasks are sent to the executors by value, so that these need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
