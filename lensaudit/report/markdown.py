"""Markdown fragments, the final report, and its HTML form."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass


@dataclass
class Section:
    """A part of a report: facts (name, value), tables (caption, column names, rows), and lines that name single rows."""

    title: str
    facts: Sequence[tuple] = ()
    tables: Sequence[tuple[str, Sequence[str], Sequence[tuple]]] = ()
    lines: Sequence[str] = ()
    remark: str = ""

    def markdown(self, level: int = 2) -> str:
        blocks = [f"{'#' * level} {self.title}", self.remark]
        if self.facts:
            blocks.append(pipe_table(("fact", "value"), self.facts))
        for caption, names, rows in self.tables:
            blocks += [f"{caption}:", pipe_table(names, rows)]
        blocks.append("\n".join(f"- {x}" for x in self.lines))
        return "\n\n".join(filter(None, blocks)) + "\n"


def pipe_table(names: Sequence[str], rows: Iterable[tuple]) -> str:
    """A table whose last column is aligned to the right; pipes inside values are shown as a broken bar."""
    shown = lambda cells: "| " + " | ".join(str(c).replace("|", "\u00a6") for c in cells) + " |"
    return "\n".join([shown(names), shown(["---"] * (len(names) - 1) + ["---:"]), *map(shown, rows)])


def report(title: str, settings: Mapping, sections: Iterable[Section]) -> str:
    """Contents, the sections in their order, and the settings last."""
    parts = [*sections, Section("Settings", lines=[f"{k}: `{v}`" for k, v in settings.items()])]
    contents = "\n".join(f"- {s.title}" for s in parts)
    return "\n".join([f"# {title}\n\n{contents}\n", *(s.markdown() for s in parts)])


#: What opens and closes a marked part of a line; nothing inside it is looked at again.
_FENCES = {"`": "code", "**": "strong", "*": "em"}
_FENCE = re.compile(r"`|\*\*|\*")


def inline(text: str) -> str:
    """Escaped text with `code`, **strong** and *emphasis* as elements."""
    out, at = [], 0
    while found := _FENCE.search(text, at):
        fence, begin = found[0], found.end()
        end = text.find(fence, begin + 1)
        if end < 0 or (fence == "*" and "*" in text[begin:end]):
            out.append(html.escape(text[at:begin]))
            at = begin
            continue
        tag = _FENCES[fence]
        out += [html.escape(text[at : found.start()]), f"<{tag}>", html.escape(text[begin:end]), f"</{tag}>"]
        at = end + len(fence)
    return "".join(out) + html.escape(text[at:])


def _row(line: str, tag: str) -> str:
    return "<tr>" + "".join(f"<{tag}>{inline(x.strip())}</{tag}>" for x in line.strip("|").split("|")) + "</tr>"


def _kind(line: str) -> str:
    if len(line) > 0 and line[0] == line[-1] == "|":
        return "table"
    if not line.strip():
        return "blank"
    return "item" if line.startswith("- ") else "text"


def html_body(markdown: str) -> str:
    """Headings of three levels, lists, fenced code, pipe tables (the second row is the rule) and paragraphs, one block a line."""
    out: list[str] = []
    lines = markdown.splitlines()
    at = 0
    while at < len(lines):
        line = lines[at]
        if line.startswith("```"):
            end = next((i for i in range(at + 1, len(lines)) if lines[i].startswith("```")), len(lines))
            out += ["<pre><code>", *map(html.escape, lines[at + 1 : end]), "</code></pre>"]
            at = end + 1
            continue
        kind = _kind(line)
        end = at + 1
        if kind in ("table", "item"):
            while end < len(lines) and _kind(lines[end]) == kind and not lines[end].startswith("```"):
                end += 1
        block = lines[at:end]
        if kind == "table":
            out += ["<table>", f"<thead>{_row(block[0], 'th')}</thead>", "<tbody>", *(_row(x, "td") for x in block[2:]), "</tbody></table>"]
        elif kind == "item":
            out += ["<ul>", *(f"<li>{inline(x[2:])}</li>" for x in block), "</ul>"]
        elif kind == "blank":
            out.append("")
        elif heading := re.match(r"(#{1,3}) ", line):
            level = len(heading[1])
            out.append(f"<h{level}>{inline(line[level + 1 :])}</h{level}>")
        else:
            out.append(f"<p>{inline(line)}</p>")
        at = end
    return "\n".join(out)


_STYLE = "body{font:16px/1.5 sans-serif;max-width:60rem;margin:2rem auto;padding:0 1rem;color:#222}table{border-collapse:collapse}th,td{border:1px solid #ccc;padding:.3rem .6rem}code{background:#f2f2f2}pre{background:#f2f2f2;padding:1rem;overflow:auto}"


def html_page(markdown: str, title: str = "Image audit") -> str:
    return f'<!doctype html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<meta name="viewport" content="width=device-width, initial-scale=1">\n<title>{html.escape(title)}</title>\n<style>{_STYLE}</style>\n</head>\n<body>\n<main>\n{html_body(markdown)}\n</main>\n</body>\n</html>\n'
