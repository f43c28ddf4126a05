"""All registered raster queries and the SQL that checks them."""

from rastrel.plans import grid_queries, pixel_queries, scaling_queries  # noqa: F401  each registers its queries
from rastrel.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
