"""All registered queries."""

from __future__ import annotations

from siltscope.plans import catalog_text  # noqa: F401
from siltscope.plans import catalog_code  # noqa: F401
from siltscope.plans import catalog_history  # noqa: F401
from siltscope.plans import catalog_misc  # noqa: F401
from siltscope.plans.catalog_history import worst_documents
from siltscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "worst_documents"]
