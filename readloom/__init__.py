"""readloom: sequencing-read analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames (or Columns), so plans stay lazy and
Catalyst sees the whole query.  Sub-packages: ``functions`` (Column functions),
``operators`` (DataFrame operators), ``sources`` (readers and writers), ``plans``
(registered queries with their SQL), ``streaming`` (Structured Streaming forms).
"""

import sys

from pyspark import cloudpickle

# Python workers get the functions themselves, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
