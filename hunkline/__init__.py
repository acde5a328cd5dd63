"""hunkline: change-set (unified git diff) analytics as Spark DataFrame jobs.

Public API is a set of ``DataFrame -> DataFrame`` transforms (use them with
``df.transform(...)``) plus fixture builders that derive change-set tables
from the driver's parquet tables.
"""

from hunkline.session import get_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
