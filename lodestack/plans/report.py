"""Results as JSON, text or HTML.

``write_parts``, ``text_lines`` and ``html_lines`` leave formatting and writing to Spark, whatever the size. The
others make one small file of an aggregate; ``most`` bounds what reaches the driver.
"""

from __future__ import annotations

import html
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_lines(counted: DataFrame, key: str, n: str, width: int = 30) -> DataFrame:
    """(value): number, key and a bar in proportion to the largest number; a null key is ``(none)``."""
    most = counted.agg(F.max(n).alias("_most"))
    bars = F.expr(f"repeat('#', cast(round({width} * `{n}` / _most) as int))")
    line = F.concat(F.lpad(F.col(n).cast("string"), 12, " "), F.lit("  "), F.coalesce(F.col(key), F.lit("(none)")), F.lit("  "), bars)
    return counted.join(F.broadcast(most)).select(line.alias("value"))


def escaped(text: Column) -> Column:
    """Text for HTML: ampersands, angle brackets and quotes as entities."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def html_lines(rows: DataFrame) -> DataFrame:
    """(value): one table row per row; integers with separators of thousands, nulls empty."""
    cells = []
    for field in rows.schema:
        c = F.col(f"`{field.name}`")
        shown = F.format_number(c, 0) if field.dataType.typeName() in ("long", "integer", "short", "byte") else escaped(c.cast("string"))
        cells.append(F.concat(F.lit("<td>"), F.coalesce(shown, F.lit("")), F.lit("</td>")))
    return rows.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))


def write_parts(parts: dict[str, DataFrame], folder: str) -> None:
    """Each part as lines of JSON in a folder of its own, replaced as a whole when the job commits."""
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def rows_of(df: DataFrame, most: int = 10_000) -> list[dict]:
    """At most ``most`` rows; more raise ValueError, as a report is an aggregate."""
    found = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} rows are no report")
    return found


def write_atomically(path: str | Path, text: str) -> None:
    """Readers see the old file or the new one."""
    path = Path(path)
    with tempfile.NamedTemporaryFile("w", dir=path.parent, delete=False, encoding="utf-8") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    os.replace(out.name, path)


def write_json(parts: dict[str, DataFrame], path: str | Path) -> None:
    write_atomically(path, json.dumps({name: rows_of(df) for name, df in parts.items()}, default=str, indent=2, sort_keys=True))


def bar(n: float, most: float, width: int = 30) -> str:
    return "#" * (round(width * n / most) if most else 0)


def text_section(title: str, df: DataFrame, key: str, n: str) -> str:
    rows = rows_of(df)
    most = max((r[n] for r in rows), default=0)
    return "\n".join([f"## {title}", *(f"{r[n]:>12,}  {r[key]}  {bar(r[n], most)}" for r in rows)]) + "\n"


def html_table(title: str, df: DataFrame) -> str:
    cell = lambda x: f"{x:,}" if isinstance(x, int) else f"{x:.4g}" if isinstance(x, float) else html.escape("" if x is None else str(x))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(r[c])}</td>" for c in df.columns) + "</tr>" for r in rows_of(df))
    return f"<h2>{html.escape(title)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def write_site(pages: dict[str, dict[str, DataFrame]], folder: str | Path) -> None:
    """One page per entry, each with a menu of all pages, and ``data.json`` with everything."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    menu = " | ".join(f'<a href="{html.escape(p)}.html">{html.escape(p)}</a>' for p in pages)
    for name, parts in pages.items():
        body = "".join(html_table(title, df) for title, df in parts.items())
        write_atomically(folder / f"{name}.html", f"<!doctype html><meta charset=utf-8><title>{html.escape(name)}</title><nav>{menu}</nav><h1>{html.escape(name)}</h1>{body}")
    write_json({f"{page}/{title}": df for page, parts in pages.items() for title, df in parts.items()}, folder / "data.json")
