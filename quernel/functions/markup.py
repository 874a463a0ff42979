"""Plain text from Markdown, XML and HTML."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities that HTML text is decoded by, in this order. Fixed values.
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'"}
#: Characters that count as white space; narrower than Python's. Fixed values.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BREAKS = r"(?i)<(br|p|div|h[1-6]|li|tr)(\s[^>]*)?>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _balanced(text: str, at: int) -> int:
    """The place behind the parenthesis that closes the one at ``at``, or -1."""
    depth = 0
    for k in range(at, len(text)):
        depth += {"(": 1, ")": -1}.get(text[k], 0)
        if not depth:
            return k + 1
    return -1


def _target_end(line: str, at: int) -> int:
    """The place behind the link target that begins at ``at``, the line's end for one that is never closed, or ``at``."""
    if line[at : at + 1] != "(":
        return at
    end = _balanced(line, at)
    return len(line) if end < 0 else end


def strip_links(line: str) -> str:
    """``[text](target)`` and ``[text]`` become text, and a bracket that is never closed goes; targets may hold parentheses."""
    out, at = [], 0
    while (a := line.find("[", at)) >= 0:
        b = line.find("]", a)
        out.append(line[at:a])
        if b < 0:
            return "".join([*out, line[a + 1 :]])
        out.append(line[a + 1 : b])
        at = _target_end(line, b + 1)
    return "".join([*out, line[at:]])


def strip_images(line: str) -> str:
    """Cuts what is left of images inside links, ``![text](target)``; their texts may hold brackets."""
    out, at = [], 0
    while (a := line.find("![", at)) >= 0:
        depth, k = 1, a + 2
        while k < len(line) and depth:
            depth += {"[": 1, "]": -1}.get(line[k], 0)
            k += 1
        out.append(line[at:a])
        at = _target_end(line, k)
    return "".join([*out, line[at:]])


def strip_markdown_text(text: str) -> str:
    """Headings, emphasis, links, images and list marks (with their indentation) are cut; fence lines at the margin and
    empty lines are dropped, while fenced lines, indented fences and lines of blanks stay."""
    out = []
    for line in text.split("\n"):
        line = line[:-1] if line.endswith("\r") else line
        if line.startswith("#"):
            line = line.lstrip("#").lstrip(WHITE)
        line = strip_images(strip_links(line.replace("*", "").replace("_", "")))
        if line.startswith(("```", "~~~")):
            continue
        bare = line.lstrip(WHITE)
        line = bare[2:] if bare.startswith(("- ", "+ ")) else line
        if line:
            out.append(line)
    return "\n".join(out)


def strip_markdown(text: Column | str) -> Column:
    """``strip_markdown_text`` over Arrow batches: nested parentheses in link targets need more than a pattern."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else strip_markdown_text(t))

    return run(text)


def strip_xml(text: Column | str) -> Column:
    """Tags are cut, and what follows an unclosed one; entities stay."""
    return F.replace(F.regexp_replace(_col(text), r"(?s)<[^>]*(>|$)", ""), F.lit(">"), F.lit(""))


def html_text(html: Column | str) -> Column:
    """The text of a page: scripts and styles cut, block tags as line breaks, entities decoded; null if nothing is left."""
    t = F.regexp_replace(_col(html), r"(?is)<script[^>]*>.*?</script[^>]*>", "")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style[^>]*>", "")
    t = F.regexp_replace(F.regexp_replace(t, BREAKS, "\n"), r"<[^>]*>", "")
    for entity, char in ENTITIES.items():
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\r]+\n", "\n"), r"^\s+|\s+$", "")
    return F.nullif(t, F.lit(""))
