"""All registered queries of the library: name -> Spark function, name -> SQL for another engine."""

from __future__ import annotations

from siftline.plans import clusters, features, files, groups, joins, metrics, reports, scalars, scorer, sequences, shared_passages, windows  # noqa: F401  (they register queries)
from siftline.registry import QUERIES, SQL  # noqa: F401

flagship = shared_passages.peaks_shared_passages
