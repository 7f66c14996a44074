"""Named queries on the provided tables."""

from scholia.plans import learner_queries, linkage_queries, repair_queries, signal_queries, source_queries, stream_queries, text_queries  # noqa: F401
from scholia.plans.registry import REGISTRY  # noqa: F401
