"""Settings from Markdown files with front matter, on the driver."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    language: str = "en"
    depth: str = "detailed"
    runtime: str = "extractive"
    target_ms: int = 300_000
    maximum_ms: int = 600_000
    overlap_ms: int = 15_000
    instructions: str = ""


def _front_matter(head: str) -> dict[str, object]:
    """The front matter as YAML where a parser is installed, else as ``name: value`` lines."""
    try:
        import yaml
    except ImportError:
        pairs = [line.partition(":") for line in head.splitlines() if line.strip() and not line.lstrip().startswith("#")]
        if bad := [name for name, colon, _ in pairs if not colon]:
            raise ValueError(f"no name and value: {bad[0].strip()}") from None
        return {name.strip(): value.strip().strip("'\"") for name, _, value in pairs}
    found = yaml.safe_load(head) or {}
    if not isinstance(found, dict):
        raise ValueError("the front matter has no names and values")
    return found


def parse(text: str) -> dict[str, str | int]:
    """The ``name: value`` lines between a pair of ``---`` lines at the start, and what follows as ``instructions``."""
    head, body = "", text
    if text.startswith("---\n"):
        head, mark, body = text[4:].partition("\n---")
        if not mark:
            raise ValueError("the front matter isn't closed")
    known = {f.name: f.type for f in fields(Settings)}
    out: dict[str, str | int] = {}
    for name, value in _front_matter(head).items():
        if name not in known:
            raise ValueError(f"unknown setting: {name}")
        out[name] = int(value) if known[name] == "int" else str(value)
    if body.strip("- \n"):
        out["instructions"] = body.lstrip("-").strip()
    return out


def merged(*layers: dict[str, str | int]) -> Settings:
    """Later layers win; their instructions are added to the earlier ones instead, with a blank line between."""
    values: dict[str, str | int] = {}
    texts = []
    for layer in layers:
        values |= {k: v for k, v in layer.items() if k != "instructions"}
        texts += [str(layer["instructions"])] if layer.get("instructions") else []
    made = replace(Settings(), **values, instructions="\n\n".join(texts))
    if not 0 < made.target_ms <= made.maximum_ms or made.overlap_ms < 0:
        raise ValueError("a target must be positive and no longer than the maximum, an overlap not negative")
    return made


def nearest(name: str, start: Path) -> Path | None:
    """The file of that name in the folder or the nearest one above it."""
    return next((p / name for p in (start, *start.parents) if (p / name).is_file()), None)
