"""Operators for preparing training text.

Every module is one operator; :mod:`.queries` applies each to the shared tables.
Functions of this package travel with their tasks, so executors need not have it
on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
