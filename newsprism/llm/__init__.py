"""Operators for large training-data pipelines, each with its registered query.

``queries()`` and ``oracle_sql()`` are what the driver contract adds; nothing
else in the library imports this subpackage.
"""

from __future__ import annotations

from . import registry


def queries():
    return registry.queries()


def oracle_sql():
    return registry.oracle_sql()
