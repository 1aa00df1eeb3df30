"""Run settings from YAML: the subtree ``training`` or the root, over defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any, TypeVar

C = TypeVar("C")


@dataclass(frozen=True)
class TrainConfig:
    input_path: str = "data/training.jsonl"
    output_dir: str = "out"
    run_name: str = "run"
    split: str = "train"
    seed: int = 17
    max_steps: int = 100
    groups_per_step: int = 8
    save_every: int = 0
    lambda_invariance: float = 0.0
    parse_fail_reward: float = -2.0
    punctuation_loop_reward: float = -2.0
    advantage_scale: float = 1.0
    advantage_clip: float = 5.0


def load_yaml(path: str) -> dict[str, Any]:
    try:
        import yaml
    except ImportError:
        return _plain(Path(path).read_text(encoding="utf-8"))
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def _plain(text: str) -> dict[str, Any]:
    """Mappings of scalars by indentation, where no YAML library is installed."""
    import ast

    root: dict[str, Any] = {}
    stack: list[tuple[int, dict[str, Any]]] = [(-1, root)]
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        indent, (key, _, value) = len(body) - len(body.lstrip()), body.strip().partition(":")
        while stack[-1][0] >= indent:
            stack.pop()
        value = value.strip()
        if not value:
            stack[-1][1][key] = {}
            stack.append((indent, stack[-1][1][key]))
            continue
        known = {"true": True, "false": False, "null": None, "~": None}
        try:
            stack[-1][1][key] = known[value.lower()] if value.lower() in known else ast.literal_eval(value)
        except (ValueError, SyntaxError):
            stack[-1][1][key] = value
    return root


def load_config(path: str, kind: type[C] = TrainConfig) -> C:
    found = load_yaml(path)
    found = found.get("training", found) or {}
    return kind(**{f.name: found[f.name] for f in fields(kind) if f.name in found})
