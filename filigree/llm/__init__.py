"""Operators for preparing training corpora; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors may not have this repository installed: functions of this subpackage travel inside the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
