"""Bulk table export and audit on Spark."""

import sys as _sys

from pyspark import cloudpickle as _pickle

from haulage.policy import EXPORT_PROFILES, ExportOptions, Policy
from haulage.session import get_session

__all__ = ["EXPORT_PROFILES", "ExportOptions", "Policy", "get_session"]

# Functions of this package travel to Python workers with their code, so executors need not
# have the package installed.
_pickle.register_pickle_by_value(_sys.modules[__name__])
