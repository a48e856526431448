"""Biosignal features and subject-level evaluation as Spark DataFrame jobs."""

from epochwise.config import Band, Settings

__all__ = ["Band", "Settings"]
