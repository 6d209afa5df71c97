"""All queries of the library; importing the modules registers them."""

from __future__ import annotations

from . import analyses, features, graphs, lanes, lexicons, matches, meanings, ranks, reviews, sources, streams, supplies, texts  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
