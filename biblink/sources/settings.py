"""Three saved settings, each as given, as in the environment, or as saved."""

from __future__ import annotations

import json
import os
import stat
from pathlib import Path

FIELDS = ("library_user", "library_key", "mailto")
ENVIRONMENT = {f: f"BIBLINK_{f.upper()}" for f in FIELDS}


def settings_path() -> Path:
    override = os.environ.get("BIBLINK_SETTINGS")
    return Path(override).expanduser() if override else Path.home() / ".biblink" / "settings.json"


def load(path: Path | None = None) -> dict[str, str]:
    """Known settings with a value; nothing of a missing or broken file."""
    try:
        data = json.loads((path or settings_path()).read_text("utf-8"))
    except (OSError, ValueError):
        return {}
    return {k: v for k, v in data.items() if k in FIELDS and isinstance(v, str) and v} if isinstance(data, dict) else {}


def save(values: dict[str, str], path: Path | None = None) -> Path:
    """What is saved, with these values over it; empty values change nothing.  Only the owner may read it."""
    path = path or settings_path()
    path.parent.mkdir(parents=True, exist_ok=True)
    merged = load(path) | {k: v for k, v in values.items() if k in FIELDS and v}
    descriptor = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, stat.S_IRUSR | stat.S_IWUSR)
    with os.fdopen(descriptor, "w", encoding="utf-8") as f:
        f.write(json.dumps(merged, indent=2) + "\n")
    return path


def forget(path: Path | None = None) -> bool:
    """Whether there was anything to forget."""
    try:
        (path or settings_path()).unlink()
    except FileNotFoundError:
        return False
    return True


def chosen(given: dict[str, str], path: Path | None = None) -> dict[str, str]:
    saved = load(path)
    return {f: given.get(f) or os.environ.get(ENVIRONMENT[f]) or saved.get(f, "") for f in FIELDS}


def shown(values: dict[str, str]) -> dict[str, str]:
    """For display: of a key only its end."""
    return {f: ("…" + v[-4:] if len(v) > 4 else "…") if f.endswith("_key") and v else v for f, v in values.items()}
