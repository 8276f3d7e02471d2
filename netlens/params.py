"""Parameters of flow assembly."""

from __future__ import annotations

from dataclasses import dataclass

MICROS = 1_000_000


@dataclass(frozen=True)
class FlowParams:
    """Timeouts in seconds.

    ``slice_s`` is the width of the time slices by which one endpoint pair is
    spread over tasks; it never exceeds ``cap_s`` (see ``operators.flows``).
    ``parity`` selects the quirks of the original meter where the default is a
    corrected definition. ``per_file`` keeps captures apart. ``arrival_gaps``
    measures gaps in order of ``seq`` instead of time, so late packets show.
    """

    idle_s: float = 5
    cap_s: float | None = 90
    clump_s: float = 1
    active_s: float = 5
    bulk_bound: int = 4
    parity: bool = False
    per_file: bool = False
    arrival_gaps: bool = False
    slice_s: float | None = None

    @property
    def idle_us(self) -> int:
        return round(self.idle_s * MICROS)

    @property
    def cap_us(self) -> int | None:
        return None if self.cap_s is None else round(self.cap_s * MICROS)

    @property
    def clump_us(self) -> int:
        return round(self.clump_s * MICROS)

    @property
    def active_us(self) -> int:
        return round(self.active_s * MICROS)

    @property
    def slice_us(self) -> int:
        width = round((self.slice_s or 4 * self.idle_s) * MICROS)
        return width if self.cap_us is None else min(width, self.cap_us)

    @property
    def key_columns(self) -> list[str]:
        """Columns of the direction-free flow key."""
        key = ["lo_ip", "lo_port", "hi_ip", "hi_port"]
        if not self.parity:
            key.append("protocol")
        if self.per_file:
            key.append("source_file")
        return key
