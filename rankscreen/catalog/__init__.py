"""Every registered query with the SQL that checks it."""

from . import graphs, measuring, picking, projecting, ranking, reconciling, reporting, resampling  # noqa: F401
from .core import ENTRIES

__all__ = ["ENTRIES"]
