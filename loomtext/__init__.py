"""Structural text analytics on Spark: short programs that select, rewrite and aggregate spans of text."""

from .api import Program, Result, compile
from .lang.pattern import ProgramError

__all__ = ["Program", "ProgramError", "Result", "compile"]
