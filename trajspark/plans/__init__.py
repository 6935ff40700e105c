"""Registered queries and their SQL."""

from . import more  # noqa: F401
from .queries import ORACLE_SQL, QUERIES  # noqa: F401
