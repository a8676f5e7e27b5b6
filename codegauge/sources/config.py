"""Driver-side settings: environment files and gate files."""

from __future__ import annotations

from pathlib import Path

GATE_FILES = (".quality.yaml", ".quality-gates.yaml")
#: Default thresholds. Keys other than registered metric names match no metric and are skipped, unless keys are normalised.
DEFAULT_GATES = {"overall": {"quality_score": 0.6}, "metrics": {"security": 0.8, "cyclomatic_complexity": 0.7, "cognitive_complexity": 0.7, "maintainability_index": 0.7}}


def parse_env(text: str) -> dict[str, str]:
    """KEY=VALUE lines; # comments, an `export ` before, one layer of quotes; the first = parts them."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        key, found, value = line.removeprefix("export ").partition("=")
        key, value = key.strip(), value.strip()
        if not found or not key:
            continue
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out[key] = value
    return out


def find_up(start: str, name: str = ".env") -> Path | None:
    """The nearest file of that name in a folder or those above it."""
    at = Path(start).resolve()
    return next((p / name for p in [at, *at.parents] if (p / name).is_file()), None)


def load_env(start: str) -> dict[str, str]:
    found = find_up(start)
    return parse_env(found.read_text(encoding="utf-8")) if found else {}


def parse_gates(text: str) -> dict[str, dict[str, float]]:
    """The scopes `overall` and `metrics` of a gate file; thresholds that aren't numbers are left out."""
    import yaml

    root = yaml.safe_load(text)
    gates = root.get("quality_gates") if isinstance(root, dict) else None
    if not isinstance(gates, dict):
        raise ValueError("a gate file must contain a 'quality_gates' section")

    def numbers(x) -> dict[str, float]:
        return {str(k): float(v) for k, v in x.items() if isinstance(v, int | float) and not isinstance(v, bool)} if isinstance(x, dict) else {}

    return {scope: numbers(gates.get(scope)) for scope in ("overall", "metrics")}


def find_gates(folder: str) -> Path | None:
    return next((Path(folder) / n for n in GATE_FILES if (Path(folder) / n).is_file()), None)
