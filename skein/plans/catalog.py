"""Every registered query of the library, by name, and its SQL."""

from skein.plans import corpus, curation, datasets, evaluation, intervals, labels, reports, retrieval, routing, rules, signals, storage, streams  # noqa: F401  they register
from skein.plans.registry import QUERIES, SQL  # noqa: F401
