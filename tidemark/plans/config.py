"""What a series is: columns, capacity, and the limits that hold for them."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

#: Limits and sizes of the record format.
MAX_COLUMNS, MAX_EXTRAS, DEFAULT_STRIDE = 64, 48, 380
BLOCK_BYTES, BLOCK_HEADER, RESERVE_PERCENT = 1024, 8, 5


class SeriesStateError(RuntimeError):
    """The series is closed, deleted, or already in the state asked for."""


class CapacityError(RuntimeError):
    """It does not fit the space there is."""


class CommitConflict(RuntimeError):
    """Another writer committed first."""


@dataclass
class SeriesConfig:
    """Options of a series. The memory options are accepted for compatibility; Spark manages memory."""

    path: str
    num_params: int
    param_names: list[str] | None = None
    max_records: int = 0
    index_stride: int = 0
    free_space: Callable[[], int | None] | None = None
    min_free_bytes: int = 0
    buffer_pool_size: int | None = None
    alloc_strategy: str | None = None
    use_paged_allocation: bool | None = None
    page_size: int | None = None
    columns: list[str] = field(init=False)

    def __post_init__(self) -> None:
        if not 1 <= self.num_params <= MAX_COLUMNS:
            raise ValueError(f"num_params must be 1 to {MAX_COLUMNS}")
        if self.max_records < 0 or self.index_stride < 0:
            raise ValueError("max_records and index_stride must not be negative")
        if self.param_names is not None and len(self.param_names) != self.num_params:
            raise ValueError("param_names must have num_params names")
        self.columns = checked_names(self.param_names or [f"p{k}" for k in range(self.num_params)])
        self.index_stride = self.index_stride or DEFAULT_STRIDE
        if ignored := [k for k in ("buffer_pool_size", "alloc_strategy", "use_paged_allocation", "page_size") if getattr(self, k) is not None]:
            warnings.warn(f"ignored, Spark manages memory: {', '.join(ignored)}", stacklevel=3)


def checked_names(names: list[str]) -> list[str]:
    names = list(names)
    if not 1 <= len(names) <= MAX_COLUMNS:
        raise ValueError(f"1 to {MAX_COLUMNS} columns are allowed")
    lower = [n.lower() for n in names]
    if len(set(lower)) != len(lower) or not all(names) or {"seq", "ts"} & set(lower):
        raise ValueError("column names must be distinct whatever their case, not empty, and other than seq and ts")
    return names


def capacity_for(storage_bytes: int, num_params: int) -> int:
    """Records that fit a storage budget."""
    return (storage_bytes - 2048) // (4 + 2 * num_params)


def records_per_block(num_params: int) -> int:
    return (BLOCK_BYTES - BLOCK_HEADER) // (4 + 2 * num_params)


@dataclass(frozen=True)
class SizeModel:
    """The logical size of a series in blocks; budgets for migrations are checked against it."""

    num_params: int
    max_records: int
    index_stride: int

    @property
    def fixed(self) -> int:
        entries = self.max_records // self.index_stride + 1 if self.max_records else 256
        return (2048 if self.num_params > 16 else 1024) + 8 * entries

    def bytes_for(self, records: int) -> int:
        return self.fixed + -(-records // records_per_block(self.num_params)) * BLOCK_BYTES

    def fit(self, budget: int) -> int:
        """Records that fit the budget, in whole blocks."""
        return max(0, budget - self.fixed) // BLOCK_BYTES * records_per_block(self.num_params)


def usable(free_space_bytes: int) -> int:
    """What a migration may use of the free space."""
    return free_space_bytes - free_space_bytes // 100 * RESERVE_PERCENT
