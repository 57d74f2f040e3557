from cohortry.plans import (  # noqa: F401
    aggregates,
    evaluation,
    explanation,
    personalization,
    preparation,
    projections,
    reporting,
    streams,
    tables,
    training,
    windows,
)
from cohortry.plans.catalog import ORACLES, QUERIES  # noqa: F401
