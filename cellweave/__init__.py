"""Spatial context for place names, as PySpark DataFrame plans."""

from .config import BuildConfig, SentenceConfig, StaticSlot, default_preset
from .operators.resolve import ContextResolver
from .plans.build import build
from .cellsystem import CellSystem, ContainmentMode, PlanarGrid

__all__ = ["BuildConfig", "ContextResolver", "build", "SentenceConfig", "StaticSlot", "default_preset", "CellSystem", "ContainmentMode", "PlanarGrid"]
