"""Arrow batches cut by bytes of text."""

from cloakframe.functions.arrow_parts import slices

__all__ = ["slices"]
