"""Operators a training-data pipeline needs, over document tables.

Task code travels inside the jobs by value, so that workers need no copy of this package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
