"""Every query of this subpackage by name, with its SQL."""

from __future__ import annotations

from . import problems_paths, problems_text, problems_values

QUERIES: dict = {}
ORACLE: dict = {}
for part in (problems_paths, problems_values, problems_text):
    QUERIES |= part.QUERIES
    ORACLE |= part.ORACLE
