"""Every report and operator as a named query, most with an equivalent SQL check."""

from dugout.plans.registry import endpoints, ingest, library, presentation, quality, storage, summaries  # noqa: F401
from dugout.plans.registry.base import ENTRIES

__all__ = ["ENTRIES"]
