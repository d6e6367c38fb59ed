"""Job parameters with the defaults the pipeline runs under."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    min_content_length: int = 100
    max_content_length: int = 50_000
    max_retries: int = 3
    rejection_percent: int = 90
    created_at_unit: str = "s"

    @property
    def rejection_threshold(self) -> float:
        return self.rejection_percent / 100.0


DEFAULTS = Settings()
