"""Imports every plan module, so that its queries are registered."""

from cellweave.plans import biology, dynamic, knowledge, matrix, records, rollout, search, spatial, streams, tissue  # noqa: F401
from cellweave.plans.matrix import flagship  # noqa: F401
