"""Registered queries and their SQL: importing the operator modules fills the tables."""

from .operators import audit, dedup, identity, labels, media, reports, scalars, spatial, windows  # noqa: F401
from .plans.dialect import QUERIES, SQL  # noqa: F401
