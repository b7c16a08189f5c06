"""Limits and choices of a run: defaults, then a TOML file, then the environment; all checked."""

from __future__ import annotations

import os
import tomllib
from dataclasses import asdict, dataclass, fields
from pathlib import Path

PREFIX, FILE, SECTION = "TRIAGELAKE_", "triagelake.toml", "triagelake"
# The least and most of each number.
BOUNDS = {
    "max_input_bytes": (1, 10 << 30), "max_whole_document_bytes": (1, 512 << 20), "max_json_depth": (1, 512), "max_json_nodes": (1, 20_000_000), "max_record_bytes": (1, 1 << 30),
    "max_analysis_workers": (1, 256), "max_model_calls": (0, 10_000_000), "repair_retries": (0, 10), "max_run_disk_bytes": (1, 2 << 40), "max_stage_peak_rss_mb": (1, 131_072), "max_run_seconds": (1, 7 * 24 * 3600),
}
BACKENDS = ("offline", "mock")


@dataclass(frozen=True)
class Settings:
    max_input_bytes: int = 1 << 30
    max_whole_document_bytes: int = 64 << 20
    max_json_depth: int = 64
    max_json_nodes: int = 2_000_000
    max_record_bytes: int = 8 << 20
    max_analysis_workers: int = 8
    max_model_calls: int = 0
    repair_retries: int = 1
    max_run_disk_bytes: int = 128 << 30
    max_stage_peak_rss_mb: int = 8192
    max_run_seconds: int = 6 * 3600
    backend: str = "offline"
    model: str = "offline"

    def __post_init__(self) -> None:
        for name, (least, most) in BOUNDS.items():
            value = getattr(self, name)
            if type(value) is not int or not least <= value <= most:
                raise ValueError(f"{name} must be an integer between {least} and {most}")
        if self.backend not in BACKENDS:
            raise ValueError(f"backend must be one of {', '.join(BACKENDS)}")
        if not isinstance(self.model, str) or not self.model.strip():
            raise ValueError("model must be named")

    def public(self) -> dict:
        """For a run's manifest; there are no secrets among them."""
        return asdict(self)


def located(start: str | None = None) -> Path | None:
    """The named file, else the nearest one in this folder or those above it."""
    if start:
        return Path(start) if Path(start).is_file() else None
    here = Path.cwd()
    return next((p / FILE for p in (here, *here.parents) if (p / FILE).is_file()), None)


def load(path: str | None = None, env: dict[str, str] | None = None) -> Settings:
    found, env = located(path), dict(os.environ) if env is None else env
    raw = tomllib.loads(found.read_text(encoding="utf-8")) if found else {}
    values = dict(raw.get(SECTION, raw))
    for f in fields(Settings):
        said = env.get(PREFIX + f.name.upper())
        if said is not None:
            values[f.name] = int(said) if f.name in BOUNDS else said
    return Settings(**{f.name: values[f.name] for f in fields(Settings) if f.name in values})
