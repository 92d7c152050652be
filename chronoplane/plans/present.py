"""The presentation edge: a few collected rows as text or HTML. Deterministic: no clock, rows in the order given."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame


def rows_of(df: DataFrame, order: Sequence[str]) -> list[dict]:
    """Rows of a small table (a ledger has one row per assumption) in a fixed order."""
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]


def to_json(rows: list[dict]) -> str:
    return json.dumps(rows, sort_keys=True, indent=2, ensure_ascii=False, default=str, allow_nan=False)


def to_text(rows: list[dict]) -> str:
    if not rows:
        return "(nothing)\n"
    names = list(rows[0])
    cells = [names, *[["" if r[n] is None else str(r[n]) for n in names] for r in rows]]
    wide = [max(len(c[i]) for c in cells) for i in range(len(names))]
    return "".join("  ".join(x.ljust(k) for x, k in zip(c, wide)).rstrip() + "\n" for c in cells)


def to_html(rows: list[dict], title: str) -> str:
    names = list(rows[0]) if rows else []
    line = lambda tag, xs: "<tr>" + "".join(f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>" for x in xs) + "</tr>"
    body = "\n".join([line("th", names), *[line("td", [r[n] for n in names]) for r in rows]])
    return f"<!doctype html>\n<title>{html.escape(title)}</title>\n<table>\n{body}\n</table>\n"
