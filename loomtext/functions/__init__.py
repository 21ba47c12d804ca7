"""Column functions: the language's single operations for use in any DataFrame expression."""

from .text import collapse, concept, expand, fuzzy, keep, replace, split_gaps, split_matches

__all__ = ["collapse", "concept", "expand", "fuzzy", "keep", "replace", "split_gaps", "split_matches"]
