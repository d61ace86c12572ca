"""What a schema can't say: which fields are text, the time field, aliases, and how absence is read."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime


class Refused(ValueError):
    """The request can't be answered exactly; it is refused rather than answered wrong."""


@dataclass
class EngineConfig:
    """``attributes`` maps field-name globs to a map or JSON column that holds them under the rest of the name."""

    text_fields: set[str] = field(default_factory=set)
    time_field: str | None = None
    id_field: str = "_id"
    field_mapping: dict[str, str] = field(default_factory=dict)
    attributes: dict[str, str] = field(default_factory=dict)
    empty_as_missing: bool = False
    timezone: str = "UTC"
    now: datetime | None = None
    exact_cardinality: bool = True
    list_threshold: int = 1000
    composite_stream: bool = False

    def moment(self) -> datetime:
        return (self.now or datetime.now(UTC)).astimezone(UTC) if self.now is None or self.now.tzinfo else self.now.replace(tzinfo=UTC)
