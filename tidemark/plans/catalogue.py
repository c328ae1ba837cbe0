"""Importing this module fills the query catalogue."""

from tidemark.plans import (  # noqa: F401
    drift, evaluation, files, labels, lineage, predictions, profiling, raster, scalars, streams, telemetry)
from tidemark.plans.registry import CATALOGUE  # noqa: F401
