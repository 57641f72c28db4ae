"""All named queries; importing this module fills the registry."""

from squelch.plans import (  # noqa: F401
    detection,
    maintenance,
    rankings,
    segments,
    sounds,
    stored,
    timelines,
    training,
    transcripts,
)
from squelch.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
