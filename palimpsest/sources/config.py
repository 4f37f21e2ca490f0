"""Settings of the engine: defaults, then a file, then the command line."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

log = logging.getLogger("palimpsest")

#: The keys and their defaults.
DEFAULTS = {
    "index_path": "",
    "lock_acquisition_timeout": "30",
    "config_scan_dot_paths": "false",
    "config_path_to_scan": "",
    "config_updated_files_only": "true",
    "config_threads_to_use": "1",
    "config_local_index_memory": "50000",
    "config_min_log_level": "3",
    "config_exact_match": "false",
    "config_min_char_for_match": "4",
}
REQUIRED = ("index_path", "config_path_to_scan")
LEAST_MEMORY = 50_000


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class EngineConfig:
    index_path: str
    path_to_scan: str
    lock_timeout: int = 30
    scan_dot_paths: bool = False  # accepted; hidden paths are never scanned
    updated_files_only: bool = True
    threads: int = 1
    memory: int = LEAST_MEMORY
    log_level: int = 3
    exact_match: bool = False
    min_char: int = 4


def parse_lines(lines: Iterable[str]) -> dict[str, str]:
    """Known keys of ``key=value`` lines, split at the first ``=``. Other lines and empty values give nothing."""
    pairs = (line.partition("=") for line in lines)
    return {k: v for k, sign, v in pairs if sign and v and k in DEFAULTS}


def read_pairs(path: str | Path) -> dict[str, str]:
    """The pairs of a file; a missing one has none."""
    try:
        return parse_lines(Path(path).read_text().splitlines())
    except OSError:
        return {}


def load(overrides: dict[str, str] | None = None, file: str | Path | None = None) -> EngineConfig:
    given = DEFAULTS | (read_pairs(file) if file else {}) | {k: v for k, v in (overrides or {}).items() if k in DEFAULTS}
    missing = [k for k in REQUIRED if not given[k]]
    if missing:
        raise ConfigError(f"not set: {', '.join(missing)}")

    def number(key: str) -> int:
        try:
            return int(given[key])
        except ValueError:
            raise ConfigError(f"{key} is not a number: {given[key]!r}") from None

    def yes(key: str) -> bool:
        return given[key] == "true"

    timeout, level, memory = number("lock_acquisition_timeout"), number("config_min_log_level"), number("config_local_index_memory")
    return EngineConfig(
        index_path=given["index_path"],
        path_to_scan=given["config_path_to_scan"],
        lock_timeout=min(max(timeout, 0), 30_000),
        scan_dot_paths=yes("config_scan_dot_paths"),
        updated_files_only=yes("config_updated_files_only"),
        threads=max(1, number("config_threads_to_use")),
        memory=memory if memory > LEAST_MEMORY else LEAST_MEMORY,
        log_level=level if 1 <= level <= 4 else 3,
        exact_match=yes("config_exact_match"),
        min_char=number("config_min_char_for_match"),
    )
