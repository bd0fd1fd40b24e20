"""Whole analyses composed of the operators."""

from .analyze import analyze
from .explore import Exploration, explore
from .ingest import Ingested, ingest
from .model import Modeling, model

__all__ = ["Exploration", "Ingested", "Modeling", "analyze", "explore", "ingest", "model"]
