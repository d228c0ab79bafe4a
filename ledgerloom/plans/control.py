"""What a run needs on the driver: settings, the lock, retries, exit codes."""

from __future__ import annotations

import enum
import errno
import fcntl
import json
import os
import random
import sys
import time
import tomllib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import TextIO

from ..schema import REPLICATED_KINDS, SOURCE_KINDS


class Exit(enum.IntEnum):
    # Process exit codes.
    OK = 0
    RUN_HAD_ERRORS = 2
    CONFIG_INVALID = 64
    CATALOG_INVALID = 65
    LEGACY_CONFIG = 66
    LEDGER_UNAVAILABLE = 67
    CREDENTIAL_FAILED = 71
    CONFLICT_FAILURE = 72
    LOCK_CONFLICT = 73
    INTERACTIVE_REQUIRED = 74
    FILES_ACCESS_FAILED = 75
    FIRST_PASS_REVIEW_REQUIRED = 76
    COLD_START_LISTING_FAILED = 77
    INCONSISTENCY_DETECTED = 78


class SettingsError(ValueError):
    """A setting that is unknown, missing or out of range, by its dotted path."""


@dataclass(frozen=True)
class SourceSettings:
    name: str
    kind: str
    root: str = ""


@dataclass(frozen=True)
class ReplicationSettings:
    pairs: tuple[tuple[str, str], ...] = ()
    on_key_conflict: str = "skip"
    fail_on_conflict: bool = False
    delete_propagation: str = "none"
    tombstone_retention_days: int = 30
    fail_on_inconsistency: bool = False


@dataclass(frozen=True)
class DuplicateSettings:
    canonical_source_priority: tuple[str, ...] = ()
    quarantine_retention_days: int = 30


@dataclass(frozen=True)
class ImportSettings:
    source: str = ""
    destination: str = ""


@dataclass(frozen=True)
class RetrySettings:
    max_retries: int = 5
    initial_backoff_ms: int = 500
    max_backoff_ms: int = 30_000


@dataclass(frozen=True)
class RuntimeSettings:
    folder: str = "./catalog"
    max_concurrent_transfers: int = 4
    keep_runs: int = 5  # of these last runs the intermediate tables stay


@dataclass(frozen=True)
class Settings:
    sources: tuple[SourceSettings, ...] = ()
    replication: ReplicationSettings = field(default_factory=ReplicationSettings)
    duplicates: DuplicateSettings = field(default_factory=DuplicateSettings)
    imports: ImportSettings = field(default_factory=ImportSettings)
    retries: RetrySettings = field(default_factory=RetrySettings)
    runtime: RuntimeSettings = field(default_factory=RuntimeSettings)

    @property
    def replicated(self) -> list[str]:
        return [s.name for s in self.sources if s.kind in REPLICATED_KINDS]


_RANGES = {"tombstone_retention_days": (1, 3650), "quarantine_retention_days": (1, 3650), "max_retries": (1, 10), "initial_backoff_ms": (100, 10_000), "max_backoff_ms": (1000, 300_000), "max_concurrent_transfers": (1, 64), "keep_runs": (1, 1000)}
_CHOICES = {"kind": SOURCE_KINDS, "on_key_conflict": ("skip", "rename", "overwrite"), "delete_propagation": ("none", "soft", "hard")}
MAX_BYTES = 1 << 20


def _made(kind: type, values: object, path: str):
    if not isinstance(values, dict):
        raise SettingsError(f"{path}: a table is expected")
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(values) - set(known)):
        raise SettingsError(f"{path}{unknown[0]}: unknown setting")
    out = {}
    for name, value in values.items():
        at = f"{path}{name}"
        default = getattr(kind(), name) if kind is not SourceSettings else ""
        if name == "sources":
            value = tuple(_made(SourceSettings, v, f"{at}[{i}].") for i, v in enumerate(value))
        elif is_dataclass(default):
            value = _made(type(default), value, f"{at}.")
        elif isinstance(default, tuple):
            value = tuple(tuple(v) if isinstance(v, list) else v for v in value)
        elif type(value) is not type(default):
            raise SettingsError(f"{at}: {type(default).__name__} is expected")
        if name in _RANGES and not _RANGES[name][0] <= value <= _RANGES[name][1]:
            raise SettingsError(f"{at}: out of range")
        if name in _CHOICES and value not in _CHOICES[name]:
            raise SettingsError(f"{at}: one of {', '.join(_CHOICES[name])} is expected")
        out[name] = value
    try:
        return kind(**out)
    except TypeError as e:
        raise SettingsError(f"{path}: {e}") from None


def parse_settings(text: str, form: str = "toml") -> Settings:
    """Settings from TOML or JSON text of one MiB at most."""
    if len(text.encode()) > MAX_BYTES:
        raise SettingsError("settings exceed 1 MiB")
    try:
        return _made(Settings, tomllib.loads(text) if form == "toml" else json.loads(text), "")
    except (tomllib.TOMLDecodeError, json.JSONDecodeError) as e:
        raise SettingsError(str(e)) from None


def print_settings(settings: Settings) -> str:
    """TOML that parses to the same settings."""
    text = lambda v: "[" + ", ".join(map(text, v)) + "]" if isinstance(v, tuple) else json.dumps(v)
    out = []
    for f in fields(Settings):
        value = getattr(settings, f.name)
        for head, section in [(f"[[{f.name}]]", v) for v in value] if f.name == "sources" else [(f"[{f.name}]", value)]:
            out += [head, *(f"{g.name} = {text(getattr(section, g.name))}" for g in fields(section)), ""]
    return "\n".join(out)


def run_file(kind: str, now: str, run_id: str) -> str:
    """Name of a run's file: kind, start without separators, and run."""
    stamp = now.replace("-", "").replace(":", "")
    return f"{kind}-{stamp}-{run_id}.{'txt' if kind == 'reconciliation' else 'jsonl'}"


def write_whole(path: str, text: str) -> None:
    """The file holds the old text or the new one, never a part."""
    beside = f"{path}.{os.getpid()}.tmp"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    try:
        with open(beside, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, path)
    finally:
        if os.path.exists(beside):
            os.remove(beside)


class LockConflict(RuntimeError):
    pass


@contextmanager
def writer_lock(path: str, run_id: str, timeout_s: float = 5.0, poll_s: float = 0.1) -> Iterator[None]:
    """One writer at a time. The kernel drops a dead holder's lock, so a stale file is no obstacle."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    deadline = time.monotonic() + timeout_s
    while True:
        fd = os.open(path, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            fcntl.flock(fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            os.close(fd)
            if e.errno not in (errno.EAGAIN, errno.EACCES):
                raise
            if time.monotonic() >= deadline:
                raise LockConflict(Path(path).read_text()) from None
            time.sleep(poll_s)
            continue
        if os.path.exists(path) and os.stat(path).st_ino == os.fstat(fd).st_ino:
            break
        os.close(fd)  # someone removed the file between the two calls
    try:
        os.ftruncate(fd, 0)
        os.write(fd, json.dumps({"pid": os.getpid(), "run_id": run_id}).encode())
        yield
    finally:
        os.unlink(path)
        os.close(fd)


class Transient(RuntimeError):
    def __init__(self, message: str = "", retry_after_s: float = 0.0):
        super().__init__(message)
        self.retry_after_s = retry_after_s


class RetriesExhausted(RuntimeError):
    pass


class FilesAccessFailed(RuntimeError):
    """The folder of a read-only store is out of reach."""


class CredentialFailed(RuntimeError):
    pass


class LegacySettings(RuntimeError):
    """Secrets in a settings file of the old kind."""


class InteractiveRequired(RuntimeError):
    """A decision that needs a person, where nobody is there to ask."""


_CODES = {
    SettingsError: Exit.CONFIG_INVALID, LegacySettings: Exit.LEGACY_CONFIG, CredentialFailed: Exit.CREDENTIAL_FAILED, LockConflict: Exit.LOCK_CONFLICT,
    InteractiveRequired: Exit.INTERACTIVE_REQUIRED, FilesAccessFailed: Exit.FILES_ACCESS_FAILED,
}


def exit_code(error: BaseException) -> Exit:
    """The process exit code of an error; any other is that of a run with errors."""
    return next((code for kind, code in _CODES.items() if isinstance(error, kind)), Exit.RUN_HAD_ERRORS)


def asks(out: TextIO, read: Callable[[], str] = input, present: bool | None = None) -> Callable[[int, int], bool]:
    """What a run calls with the count and the bytes it would quarantine: yes only by ``y`` or ``yes``."""

    def confirm(count: int, size: int) -> bool:
        if not (sys.stdin.isatty() if present is None else present):
            raise InteractiveRequired(f"{count} objects of {size} bytes wait for a confirmation")
        out.write(f"{count} objects of {size} bytes go to quarantine. Continue? [y/N]: ")
        try:
            return read().strip().lower() in ("y", "yes")
        except EOFError:
            return False

    return confirm


def retried(f: Callable, retries: RetrySettings, sleep: Callable[[float], None] = time.sleep):
    """``f()``, again after transient errors; waits double, heed the server and are capped."""
    for attempt in range(retries.max_retries + 1):
        try:
            return f()
        except Transient as e:
            if attempt == retries.max_retries:
                raise RetriesExhausted(f"{attempt + 1} attempts: {e}") from e
            backoff = min(retries.initial_backoff_ms * 2**attempt, retries.max_backoff_ms)
            sleep(min(max(backoff, int(e.retry_after_s * 1000)), retries.max_backoff_ms) / 1000)


def new_run_id() -> str:
    return f"{random.getrandbits(64):016x}"
