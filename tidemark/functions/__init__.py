"""Column expressions with the engine's exact integer rules."""

from .integers import truncated_average, wrap_int32, zero_filled

__all__ = ["truncated_average", "wrap_int32", "zero_filled"]
