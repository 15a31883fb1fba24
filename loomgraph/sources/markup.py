"""Tags of pages and templates with their offsets; the scripts and styles embedded in them, at their own lines and columns.

A small scanner walks a text once: comments, tags with quoted attributes that may hold any mark, and elements whose inside is raw
(scripts and styles) up to their own closing tag. Everything else follows from its tags. Spark spreads the
texts; a task holds one at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose inside is no markup, and elements that divide a page.
RAW = ("script", "style")
REGIONS = ("main", "body", "section", "article", "template", "div")
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_SPACE = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"[^\s=>/]+|=[^\s=>/]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]+")
_CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_NOT_BREAK = re.compile(r"[^\n\r]")


@dataclass
class Tag:
    """A tag from its ``<`` at ``start`` to after its ``>``; names in lower case, of repeated attributes the first."""

    name: str
    start: int
    end: int
    closing: bool = False
    empty: bool = False
    attributes: dict[str, str] = field(default_factory=dict)
    places: dict[str, int] = field(default_factory=dict)


def _attributes(text: str, tag: Tag, at: int, lacking: set[str]) -> int:
    """Read a tag's attributes from ``at``; gives the place after its ``>``, or that of the end of the text."""
    n = len(text)
    while True:
        space = _SPACE.match(text, at)
        end = space.end()  # type: ignore[union-attr]
        if end >= n:
            return n
        if text[end] == ">":
            tag.empty = text[at:end].rstrip().endswith("/")
            return end + 1
        name = _ATTRIBUTE.match(text, end)
        key, value_at = name[0].lower(), name.end()  # type: ignore[index,union-attr]
        at, value, place = value_at, "", end
        if equals := _EQUALS.match(text, value_at):
            at = equals.end()
            quote = text[at : at + 1]
            close = text.find(quote, at + 1) if quote in ('"', "'") and quote not in lacking else -1
            if close >= 0:
                value, place, at = text[at + 1 : close], at + 1, close + 1
            else:
                if quote in ('"', "'"):
                    lacking.add(quote)  # no such mark follows anywhere, so none is looked for again
                if bare := _BARE.match(text, at):
                    value, place, at = bare[0], at, bare.end()
        if key not in tag.attributes:
            tag.attributes[key], tag.places[key] = value, place


def tags(text: str) -> Iterator[Tag]:
    """The tags of a text in order; comments and the insides of raw elements hold none."""
    at, lacking = 0, set()  # type: ignore[var-annotated]
    while (at := text.find("<", at)) >= 0:
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            if end < 0:
                return
            at = end + 3
            continue
        name = _NAME.match(text, at)
        if not name:
            at += 1
            continue
        tag = Tag(name[2].lower(), at, 0, bool(name[1]))
        at = tag.end = _attributes(text, tag, name.end(), lacking)
        yield tag
        if tag.name in RAW and not tag.closing and not tag.empty:
            close = _CLOSING[tag.name].search(text, at)
            if not close:
                return  # the rest is its inside
            at = close.start()


class Lines:
    """Lines (from 1) and columns (from 1) of a text's places."""

    def __init__(self, text: str) -> None:
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, place: int) -> tuple[int, int]:
        line = bisect_right(self.starts, place)
        return line, place - self.starts[line - 1] + 1


@dataclass
class Region:
    """The inside of a raw element, from ``start`` to ``end``; ``opening`` is where its tag starts, ``closing`` where its closing tag ends."""

    kind: str
    opening: int
    start: int
    end: int
    closing: int
    language: str | None


def regions(text: str) -> list[Region]:
    """The scripts and styles of a text that are closed."""
    out: list[Region] = []
    open_: Tag | None = None
    for tag in tags(text):
        if tag.name not in RAW:
            continue
        if open_ and tag.closing and tag.name == open_.name:
            out.append(Region(tag.name, open_.start, open_.end, tag.start, tag.end, open_.attributes.get("lang")))
            open_ = None
        elif not tag.closing and not tag.empty:
            open_ = tag
    return out


def blank_outside(text: str, keep: list[tuple[int, int]]) -> str:
    """A text with all but some ranges as blanks: its length and its line breaks stay."""
    out, at = [], 0
    for start, end in sorted(keep):
        if start > at:
            out.append(_NOT_BREAK.sub(" ", text[at:start]))
        if end > at:
            out.append(text[max(at, start) : end])
            at = end
    out.append(_NOT_BREAK.sub(" ", text[at:]))
    return "".join(out)


def script_alone(text: str) -> str:
    """A page with its scripts alone."""
    return blank_outside(text, [(r.start, r.end) for r in regions(text) if r.kind == "script"])


def _fenced_head(text: str) -> tuple[int, int] | None:
    start = len(text) - len(text.lstrip())
    if not text.startswith("---", start):
        return None
    line = text.find("\n", start + 3)
    end = text.find("\n---", line + 1) if line >= 0 else -1
    return (line + 1, end) if end >= 0 else None


def _inline(text: str, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Outermost braced expressions outside of some ranges: not blocks, tags or spreads (``{#``, ``{:``, ``{/``, ``{@``, ``{...``)."""
    out: list[tuple[int, int]] = []
    stack: list[int] = []
    quote, skip = "", iter([*sorted(covered), (len(text), len(text))])
    hole = next(skip)
    for m in re.finditer(r"\\.|['\"`{}]", text, re.S):
        at = m.start()
        while at >= hole[1] and hole[1] < len(text):
            hole = next(skip)
        if hole[0] <= at < hole[1] or m[0][0] == "\\" or (quote and m[0] != quote):
            continue
        if m[0] in "'\"`":
            quote = "" if quote else m[0] if stack else ""
        elif m[0] == "{":
            stack.append(at)
        elif stack:
            start = stack.pop()
            while out and out[-1][0] > start:
                out.pop()  # inside this one
            out.append((start, at + 1))
    return [(a, b) for a, b in out if text[a + 1 : a + 2] not in ("#", ":", "/", "@") and text[a + 1 : a + 4] != "..."]


def template(text: str, kind: str) -> tuple[str, str, list[Region]]:
    """(script, language of the script, styles) of a ``vue``, ``svelte`` or ``astro`` file: the script at its own lines and columns.

    A svelte file's script also holds its inline expressions, an astro file's its fenced head, which is typescript.
    """
    found = regions(text)
    scripts = [r for r in found if r.kind == "script"]
    keep = [(r.start, r.end) for r in scripts]
    language = "typescript" if any((r.language or "").lower() in ("ts", "typescript") for r in scripts) else "javascript"
    if kind == "astro" and (head := _fenced_head(text)):
        keep.append(head)
        language = "typescript"
    if kind == "svelte":
        keep += _inline(text, [(r.opening, r.closing) for r in found])
    return blank_outside(text, keep), language, [r for r in found if r.kind == "style"]


# Over frames


def _each(sources: DataFrame, key: str, shape: str, rows_of: Callable[..., Iterator[tuple]], *more: str) -> DataFrame:
    """``rows_of`` each source's text and further columns, the key before each row."""
    names = [c.split()[0] for c in shape.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *row) for k, text, *own in zip(b["key"], b["text"], *[b[c] for c in more]) for row in rows_of(text or "", *own)]
            yield pd.DataFrame(rows, columns=["key", *names])

    kind = dict(sources.dtypes)[key]
    return sources.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text"), *more).mapInPandas(run, f"key {kind}, {shape}").withColumnRenamed("key", key)


def embedded_regions(sources: DataFrame, key: str = "path") -> DataFrame:
    """(key, ordinal, kind, start, line, col, language, content) of the scripts and styles in sources (key, text)."""

    def rows(text: str) -> Iterator[tuple]:
        lines = Lines(text)
        for i, r in enumerate(regions(text), 1):
            yield (i, r.kind, r.start, *lines.at(r.start), r.language, text[r.start : r.end])

    return _each(sources, key, "ordinal int, kind string, start int, line int, col int, language string, content string", rows)


def scripts_of_pages(sources: DataFrame, key: str = "path") -> DataFrame:
    """(key, script): pages with their scripts alone."""
    return _each(sources, key, "script string", lambda text: iter([(script_alone(text),)]))


def scripts_of_templates(sources: DataFrame, key: str = "path") -> DataFrame:
    """(key, script, language, styles) of template files (key, text, dialect)."""

    def rows(text: str, dialect: str) -> Iterator[tuple]:
        script, language, styles = template(text, dialect)
        yield script, language, len(styles)

    return _each(sources, key, "script string, language string, styles int", rows, "dialect")


def page_units(sources: DataFrame, key: str = "path") -> DataFrame:
    """(key, ordinal, role, name, line, col, parent): regions, ids (each once), classes, and what scripts and links refer to.

    An id or class belongs to the nearest region on its line or above, a class else to the nearest id.
    A line has one region, its first.
    """

    def rows(text: str) -> Iterator[tuple]:
        lines, region, last_id, ids, n = Lines(text), None, None, set(), 0
        for tag in tags(text):
            if tag.closing:
                continue
            line, col = lines.at(tag.start)
            found: list[tuple] = []
            if tag.name in REGIONS and region != f"region:{line}":
                region = f"region:{line}"
                found.append(("region", region, line, col, None))
            where = lambda name, tag=tag: lines.at(tag.places[name])  # noqa: E731, B008
            own = tag.attributes.get("id")
            if own and own not in ids:
                ids.add(own)
                last_id = own
                found.append(("id", own, *where("id"), region))
            found += [("class", c, *where("class"), region or last_id) for c in tag.attributes.get("class", "").split()]
            target = {"script": "src", "link": "href", "a": "href"}.get(tag.name)
            if target in tag.attributes:
                found.append((tag.name, tag.attributes[target], *where(target), region))  # type: ignore[index,arg-type]
            for row in found:
                n += 1
                yield (n, *row)

    return _each(sources, key, "ordinal int, role string, name string, line int, col int, parent string", rows)
