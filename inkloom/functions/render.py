"""Reports: Markdown tables, outlines and HTML (survey K4, K8-K10, F28, H23, L14)."""

from __future__ import annotations

import html
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def template(text: str, values: Mapping[str, str]) -> str:
    """Prompt with its {names} filled in; a missing one is an error."""
    missing = {n for n in re.findall(r"\{(\w+)\}", text)} - set(values)
    if missing:
        raise KeyError(", ".join(sorted(missing)))
    return re.sub(r"\{(\w+)\}", lambda m: str(values[m.group(1)]), text)


def ranked_table(rows: Mapping[str, Mapping[str, float]], digits: int = 2) -> str:
    """Markdown table, the best of each column bold and the second underlined (K9)."""
    columns = list(dict.fromkeys(c for r in rows.values() for c in r))
    order = {c: sorted({round(r[c], 12) for r in rows.values() if c in r}, reverse=True) for c in columns}

    def cell(r: Mapping[str, float], c: str) -> str:
        if c not in r:
            return "–"
        text = f"{r[c]:.{digits}f}"
        place = order[c].index(round(r[c], 12))
        return f"**{text}**" if place == 0 else f"<u>{text}</u>" if place == 1 else text

    head = ["| method | " + " | ".join(columns) + " |", "|---" * (len(columns) + 1) + "|"]
    return "\n".join([*head, *(f"| {m} | " + " | ".join(cell(r, c) for c in columns) + " |" for m, r in rows.items())])


def merge_outlines(fragments: Sequence[Sequence[tuple[int, str]]], title: str) -> str:
    """Fragments of (level, heading) as one outline with running numbers (K4)."""
    out, counts = [title], [0] * 6
    for level, heading in (x for f in fragments for x in f):
        counts[level - 1] += 1
        counts[level:] = [0] * (6 - level)
        out.append("  " * (level - 1) + ".".join(str(n) for n in counts[:level]) + " " + re.sub(r"^\s*\d+(\.\d+)*\.?\s*", "", heading))
    return "\n".join(out)


def to_html(title: str, markdown: str) -> str:
    """A page of a Markdown article: headings, lists, tables, code and citations that
    link to the references (K10)."""
    out, lines, i = [], markdown.split("\n"), 0

    def inline(t: str) -> str:
        t = html.escape(t, quote=False)
        t = re.sub(r"\[\^(\d+)\]", r'<sup><a href="#ref-\1">\1</a></sup>', t)
        t = re.sub(r"`([^`]+)`", r"<code>\1</code>", re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", t))
        return re.sub(r"\[([^\]]+)\]\((https?://[^)\s]+)\)", r'<a href="\2">\1</a>', t)

    while i < len(lines):
        line = lines[i]
        if line.startswith("```"):
            end = next((j for j in range(i + 1, len(lines)) if lines[j].startswith("```")), len(lines))
            out.append("<pre><code>" + html.escape("\n".join(lines[i + 1 : end]), quote=False) + "</code></pre>")
            i = end
        elif m := re.match(r"(#{1,6})\s+(.*)", line):
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
        elif line.startswith("|"):
            end = next((j for j in range(i, len(lines)) if not lines[j].startswith("|")), len(lines))
            rows = [[c.strip() for c in x.strip().strip("|").split("|")] for x in lines[i:end] if not re.fullmatch(r"[|\s:\-]+", x)]
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{inline(c)}</td>" for c in r) + "</tr>" for r in rows) + "</table>")
            i = end - 1
        elif re.match(r"\s*[-*]\s+", line):
            end = next((j for j in range(i, len(lines)) if not re.match(r"\s*[-*]\s+", lines[j])), len(lines))
            out.append("<ul>" + "".join(f"<li>{inline(re.sub(r'^\s*[-*]\s+', '', x))}</li>" for x in lines[i:end]) + "</ul>")
            i = end - 1
        elif m := re.match(r"\[\^(\d+)\]:\s*(.*)", line):
            out.append(f'<p id="ref-{m[1]}">[{m[1]}] {inline(m[2])}</p>')
        elif line.strip():
            out.append(f"<p>{inline(line.strip())}</p>")
        i += 1
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body>{"".join(out)}</body></html>'


def rubric(metrics: Mapping[str, str], low: int = 0, high: int = 5) -> str:
    """Text that tells a judge the metrics and the form of its reply."""
    lines = [f"{i}. {name}: {told}" for i, (name, told) in enumerate(metrics.items(), 1)]
    return "\n".join([f"Score each metric from {low} to {high}.", *lines, "Reply with one line per metric: name: score"])


def judged_prompt(task: str, metrics: Mapping[str, str], **fields: Column) -> Column:
    """Prompt column: the task, the rubric and each field under its name; a null field is
    an empty one (H23)."""
    parts = [F.lit(task), F.lit(rubric(metrics))]
    for name, c in fields.items():
        parts.append(F.concat(F.lit(f"[{name}]\n"), F.coalesce(c, F.lit(""))))
    return F.concat_ws("\n\n", *parts)
