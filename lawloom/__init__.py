"""lawloom: retrieval, question answering and training-data processing over structured document corpora, on Spark."""

from lawloom.config import EngineConfig

__all__ = ["EngineConfig"]
__version__ = "0.1.0"
