"""Named queries over the test tables and their SQL counterparts."""

from . import live, logs, responses, tables, validation  # noqa: F401
from .catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
