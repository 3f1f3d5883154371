"""Operators for preparing large language-model training corpora.

Nothing outside this subpackage imports it; ``queries.py`` holds its queries and SQL.
Functions that run on executors travel by value, so workers need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
