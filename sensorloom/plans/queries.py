"""All registered queries of the perception operators."""

from __future__ import annotations

from . import chain_queries, detail_queries, extra_queries, frame_queries, mask_queries, raster_queries, scene_queries, source_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
