"""All registered queries and their oracles."""

from tessella.plans import answering, building, corpus, generation, slots, training  # noqa: F401
from tessella.plans.base import ORACLES, QUERIES  # noqa: F401
