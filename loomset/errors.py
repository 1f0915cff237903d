"""Errors of the data model."""

from __future__ import annotations


class ReadOnlyError(TypeError):
    """A write to something that only changes by new versions."""


class ConstraintViolationError(ValueError):
    """A change that a constraint refuses; the version before it stays as it was."""
