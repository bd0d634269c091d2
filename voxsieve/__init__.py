"""voxsieve: speech and transcript moderation analytics as Spark DataFrame operators."""

from .settings import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]
