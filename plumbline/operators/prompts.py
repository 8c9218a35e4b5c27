"""Prompt texts from a context: the paired prompts differ in one block only."""

from __future__ import annotations

from typing import Any

from ..plans.governance import field_tokens

_HEAD = "Write one SQL SELECT statement for the task. Return SQL only.\n"


def fields_text(context: dict[str, Any]) -> str:
    lines = []
    for f in context["fields"]:
        labels = sorted(field_tokens(f))
        note = f" -- {f['description']}" if f.get("description") else ""
        lines.append(f"- {f['fieldPath']} {f.get('nativeDataType') or 'UNKNOWN'}{' [' + ', '.join(labels) + ']' if labels else ''}{note}")
    return "\n".join(lines)


def context_block(context: dict[str, Any] | None) -> str:
    if context is None:
        return "No schema is available.\n"
    return f"The only table is {context['table_name']}:\n{fields_text(context)}\nUse no other table and no other column.\n"


def system_prompt(context: dict[str, Any] | None) -> str:
    """With a context grounded, without one blind."""
    return f"{_HEAD}<context>\n{context_block(context)}</context>\n"


def repair_prompt(sql: str, report: dict[str, Any], task: str) -> str:
    import json

    return f"Task:\n{task}\n\nThe candidate failed a gate:\n{json.dumps(report, indent=2, ensure_ascii=False)}\n\nCandidate:\n{sql}\n\nReturn one repaired query that takes only the allowed actions.\n"
