"""All registered queries; importing the modules fills the two tables."""

from . import logs, facts, coordination, replay, sequences, retrieval, evaluation, streams  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
