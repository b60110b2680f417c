"""Column roles of a cycle table (stream id, cycle number, event time, label,
series columns) and the names of derived columns."""

from __future__ import annotations

from dataclasses import dataclass, field

# Names of the derived columns (target, split, next time).
TARGET = "CycleTime_sec"
SPLIT = "split"
NEXT_TS = "next_ts"


@dataclass(frozen=True)
class ColumnRoles:
    stream: str | None = "A"          # stream id; None = one global stream
    cycle: str | None = "B"           # cycle number
    time: str = "C"                   # event time
    label: str | None = "D"           # kept, never a feature
    series: tuple[str, ...] = field(default_factory=tuple)
    target: str = TARGET
    split: str = SPLIT

    @classmethod
    def from_config(cls, cfg: dict) -> "ColumnRoles":
        """Roles from a configuration mapping with the keys
        time_series_columns, id_column, cycle_number_column,
        timestamp_column and good_bad_label_column.  An id of "", "none" or
        "null" means one global stream."""
        sid = cfg.get("id_column")
        if sid is None or str(sid).strip().lower() in ("", "none", "null"):
            sid = None
        return cls(stream=sid, cycle=cfg.get("cycle_number_column"),
                   time=cfg.get("timestamp_column", "C"), label=cfg.get("good_bad_label_column"),
                   series=tuple(cfg.get("time_series_columns") or ()))

    def meta(self) -> list[str]:
        """Columns that are never features."""
        out = [c for c in (self.stream, self.cycle, self.time, self.label) if c]
        return out + [self.split, self.target, NEXT_TS]

    def order(self) -> list[str]:
        """Trainer order of rows: time, stream, cycle."""
        return [c for c in (self.time, self.stream, self.cycle) if c]
