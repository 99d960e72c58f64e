"""All queries of the library but those of ``llm``: importing the operators registers them."""

from quillstream.operators import attribution, audits, commerce, context, experiments, exports, graphs, plans, records, result_rules, retrieval, telemetry, text  # noqa: F401
from quillstream.plans.registry import QUERIES, SQL
from quillstream.sources import json_array  # noqa: F401
from quillstream.streaming import event_streams, stateful  # noqa: F401

__all__ = ["QUERIES", "SQL"]
