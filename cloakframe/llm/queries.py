"""All queries of the subpackage."""

from __future__ import annotations

from cloakframe.llm import queries_selection, queries_tables, queries_text  # noqa: F401  they register
from cloakframe.llm.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
