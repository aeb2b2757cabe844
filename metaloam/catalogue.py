"""All registered queries of the library but those of the training-data subpackage."""

from __future__ import annotations

from metaloam.plans import agreement, cleaning, joins, mapping, models, neighbours, relational, sampling, sources, text, transfer, trees, validation, vector_tables  # noqa: F401  they register their queries
from metaloam.registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "knn_purity_blocked"
