"""Long-term conversational memory as PySpark tables and operators."""

from .operators import consolidate, core_memory, evaluate, extract, model_stage, retrieve, store, vectors
from .settings import DEFAULT, Settings
from .system import MemorySystem

__all__ = ["DEFAULT", "MemorySystem", "Settings", "consolidate", "core_memory", "evaluate", "extract", "model_stage", "retrieve", "store", "vectors"]
