"""labweave: experimental and simulated process data on Spark.

Every public operator takes and returns Spark ``DataFrame`` / ``Column``
objects and stays lazy unless its docstring names the small statistic it
collects.
"""

import sys

from pyspark import cloudpickle

from labweave.session import build_session, local_table, shared_dir

# batch functions travel to the workers by value, so these need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "local_table", "shared_dir"]
