"""Limits of an import."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """Sizes beyond which a file, record or cell is refused, and the size of a chunk."""

    file_bytes: int = 512 * 1024 * 1024
    chunk_rows: int = 10_000
    chunk_bytes: int = 5 * 1024 * 1024
    record_bytes: int = 16 * 1024
    sample_bytes: int = 8192
    code_chars: int = 64
    name_chars: int = 255
    description_chars: int = 2000
    purpose_chars: int = 1000
    message_chars: int = 1000
