"""Readers of allocation metadata: each takes (partition, mode) and gives a Usage, or raises Bad with the reason why the partition
must be kept whole. In mode "copy" a file system must also be clean; "estimate" believes its maps as they are."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Usage:
    """used: ranges (start, end) relative to the partition. end: where the file system ends; beyond, everything is kept."""

    used: list[tuple[int, int]]
    end: int
    label: str | None = None
    name: str | None = None


@dataclass
class Found:
    """What a reader knows before it fails: the label, say."""

    label: str | None = None
    extra: dict = field(default_factory=dict)
