"""Settings that change results."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

# Rows of one group handled by one task wherever order matters (running balances,
# row numbers, joins back to rows). Groups above it are split into row blocks.
BLOCK_ROWS = 100_000

# Rows of a file of records: tasks that count the values of cells hold all different ones that they read.
RECORD_ROWS = 8_192

# Longest list of columns (file and position) that is broadcast.
BROADCAST_COLUMNS = 500_000


@dataclass(frozen=True)
class ProfilingConfig:
    version: str = "1.0.0"
    max_rows: int | None = None  # rows examined per file; None examines all
    max_samples: int = 5
    null_percentage_threshold: float = 50.0
    balance_tolerance: Decimal = Decimal("0.01")
    encodings: tuple[str, ...] = ("utf-8-sig", "utf-8")

    def __post_init__(self) -> None:
        if self.max_rows is not None and self.max_rows <= 0:
            raise ValueError("max_rows must be positive")
        if not 0 < self.max_samples <= 100:
            raise ValueError("max_samples must be between 1 and 100")
        if not 0 <= self.null_percentage_threshold <= 100:
            raise ValueError("null_percentage_threshold must be between 0 and 100")
        if self.balance_tolerance < 0:
            raise ValueError("balance_tolerance must not be negative")


@dataclass(frozen=True)
class RegistrationConfig:
    max_bytes: int | None = None  # largest file accepted; None accepts all
    # File extensions and MIME types that stand for delimited text.
    extensions: tuple[str, ...] = (".csv",)
    mime_types: tuple[str, ...] = (
        "text/csv",
        "application/csv",
        "application/vnd.ms-excel",
        "text/plain",
        "application/octet-stream",
    )
