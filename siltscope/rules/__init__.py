"""Rule tables as data.  Patterns, severities, categories and confidences are fixed values."""

from siltscope.rules.model import Rule

__all__ = ["Rule"]
