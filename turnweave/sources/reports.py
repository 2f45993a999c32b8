"""Sinks of a run: result tables, an HTML page of aggregates, a bundle of both."""

from __future__ import annotations

import html
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame

#: Rows of a table on a page; aggregates have few, anything longer belongs into a table of its own.
PAGE_ROWS = 1000


def _cell(x: object) -> str:
    return html.escape("" if x is None else f"{x:.2f}" if isinstance(x, float) else str(x))


def render_page(title: str, tables: dict[str, DataFrame]) -> str:
    """One page with a table per aggregate; a table that has more than ``PAGE_ROWS`` rows is refused, not cut."""
    parts = []
    for name, table in tables.items():
        rows = table.limit(PAGE_ROWS + 1).collect()
        if len(rows) > PAGE_ROWS:
            raise ValueError(f"{name} has more than {PAGE_ROWS} rows: write it as a table")
        head = "".join(f"<th>{_cell(c)}</th>" for c in table.columns)
        body = "".join("<tr>" + "".join(f"<td>{_cell(x)}</td>" for x in row) + "</tr>" for row in rows)
        parts.append(f"<h2>{_cell(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return f"<!doctype html><meta charset='utf-8'><title>{_cell(title)}</title><h1>{_cell(title)}</h1>{''.join(parts)}"


def bundle(folder: str, target: str) -> int:
    """All files of a local run folder in one archive, by their relative names; returns their number."""
    files = sorted(p for p in Path(folder).rglob("*") if p.is_file() and p.resolve() != Path(target).resolve())
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in files:
            out.write(path, path.relative_to(folder))
    return len(files)
