"""Registered queries: operators bound to the driver's tables, with SQL for the same rows."""

from riskloom.plans import (  # noqa: F401
    aggregates,
    contracts,
    evaluation,
    harmonisation,
    joins,
    models,
    ordering,
    resampling,
    scalars,
    screening,
    sources,
    streams,
    studies,
    voxels,
)
