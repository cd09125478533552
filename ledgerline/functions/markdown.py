"""A small Markdown renderer (headings, lists, tables, quotes, code, inline marks) as a pandas UDF."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerline.functions.text import slug

_INLINE = [
    (re.compile(r"\*\*(.+?)\*\*"), r"<strong>\1</strong>"),
    (re.compile(r"(?<!\*)\*([^*\s][^*]*?)\*(?!\*)"), r"<em>\1</em>"),
    (re.compile(r"\[([^\]]+)\]\(([^)\s]+)\)"), r'<a href="\2">\1</a>'),
]
_ITEM = re.compile(r"^(\s*)([-*]|\d+\.)\s+(.*)$")


def inline(text: str) -> str:
    """Code spans are kept apart; the rest is escaped and marked up."""
    parts = re.split(r"(`[^`]+`)", text)
    out = []
    for part in parts:
        if len(part) > 2 and part[0] == part[-1] == "`":
            out.append(f"<code>{html.escape(part[1:-1], quote=False)}</code>")
            continue
        part = html.escape(part, quote=False)
        for pattern, to in _INLINE:
            part = pattern.sub(to, part)
        out.append(part)
    return "".join(out)


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def _items(lines: list[str]) -> str:
    """Nested lists, by indentation."""
    out, stack = [], []
    for line in lines:
        indent, mark, body = _ITEM.match(line).groups()
        kind, depth = ("ol" if mark[0].isdigit() else "ul"), len(indent)
        while stack and depth < stack[-1][0]:
            out.append(f"</li></{stack.pop()[1]}>")
        if stack and depth == stack[-1][0]:
            out.append("</li>")
        else:
            stack.append((depth, kind))
            out.append(f"<{kind}>")
        out.append(f"<li>{inline(body)}")
    while stack:
        out.append(f"</li></{stack.pop()[1]}>")
    return "".join(out)


def render(text: str | None) -> str | None:
    if text is None:
        return None
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        line = lines[i]
        take = i + 1
        if not line.strip():
            pass
        elif line.startswith("```"):
            while take < len(lines) and not lines[take].startswith("```"):
                take += 1
            out.append(f"<pre><code>{html.escape(chr(10).join(lines[i + 1 : take]), quote=False)}</code></pre>")
            take += 1
        elif m := re.match(r"^(#{1,6})\s+(.*)$", line):
            body, n = inline(m[2].strip()), len(m[1])
            out.append(f"<h{n}>{body}</h{n}>")
        elif re.match(r"^(-{3,}|\*{3,})\s*$", line):
            out.append("<hr>")
        elif "|" in line and take < len(lines) and re.match(r"^\s*\|?[\s:|-]*-[\s:|-]*$", lines[take]):
            head = "".join(f"<th>{inline(c)}</th>" for c in _cells(line))
            take += 1
            rows = []
            while take < len(lines) and "|" in lines[take]:
                rows.append("<tr>" + "".join(f"<td>{inline(c)}</td>" for c in _cells(lines[take])) + "</tr>")
                take += 1
            out.append(f"<table><tr>{head}</tr>{''.join(rows)}</table>")
        elif _ITEM.match(line):
            while take < len(lines) and _ITEM.match(lines[take]):
                take += 1
            out.append(_items(lines[i:take]))
        elif line.startswith(">"):
            while take < len(lines) and lines[take].startswith(">"):
                take += 1
            out.append(f"<blockquote>{render(chr(10).join(x.lstrip('>').lstrip() for x in lines[i:take]))}</blockquote>")
        else:
            while take < len(lines) and lines[take].strip() and not re.match(r"^(#|>|```|\s*[-*] |\s*\d+\. )", lines[take]):
                take += 1
            out.append(f"<p>{inline(' '.join(x.strip() for x in lines[i:take]))}</p>")
        i = take
    return "\n".join(out)


@F.pandas_udf(StringType())
def markdown_html(s: pd.Series) -> pd.Series:
    return s.map(render)


def with_heading_ids(html: Column) -> Column:
    """Headings get the slug of their text as id."""
    body = lambda p: F.regexp_extract(p, "(?s)^<h[1-6]>(.*?)</h[1-6]>", 1)
    marked = lambda p: F.concat(F.substring(p, 1, 3), F.lit(' id="'), slug(body(p)), F.lit('"'), F.substring(p, F.lit(4), F.length(p)))
    return F.array_join(F.transform(F.split(html, "(?=<h[1-6]>)"), lambda p: F.when(p.rlike("^<h[1-6]>"), marked(p)).otherwise(p)), "")
