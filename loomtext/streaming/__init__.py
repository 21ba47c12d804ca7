"""Re-running programs as files arrive or change."""

from .watch import poll, watch

__all__ = ["poll", "watch"]
