"""Reports as files: JSON, text that must be new, Markdown tables, and a published summary."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from ..functions.values import plain


def write_json(path: str | Path, value: Any) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False, default=plain) + "\n", encoding="utf-8")


def write_new_text(path: str | Path, text: str) -> None:
    """Fails if the file is there."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "x", encoding="utf-8") as out:
        out.write(text)


def write_new_json(path: str | Path, value: Any) -> None:
    write_new_text(path, json.dumps(value, indent=2, ensure_ascii=False, default=plain) + "\n")


def markdown(rollups: DataFrame) -> str:
    """The rows of a score's rollups as a Markdown table: by mode, then gate, then world."""
    lines = ["| Level | Mode | Of | Passed | Total | Rate |", "| --- | --- | --- | ---: | ---: | ---: |"]
    for r in rollups.orderBy("level", "mode", "gate", "world").collect():  # a row per mode, gate and world
        of = r["world"] if r["level"] == "world" else r["gate"]
        lines.append(f"| {r['level']} | {r['mode']} | {of} | {r['passed']} | {r['total']} | {100 * r['pass_rate']:.1f}% |")
    return "\n".join(lines) + "\n"


def publish(folder: str | Path, run_id: str, report: dict[str, Any], rollups: DataFrame) -> None:
    """The report in its run's folder and as the latest, and the summary as JSON and Markdown."""
    folder = Path(folder)
    write_new_json(folder / run_id / "report.json", report)
    write_json(folder / "latest.json", report)
    write_json(folder / "summary.json", [r.asDict() for r in rollups.orderBy("level", "mode", "gate", "world").collect()])
    (folder / "summary.md").write_text(markdown(rollups), encoding="utf-8")
