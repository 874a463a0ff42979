"""Symbols of source files in twenty languages.

Python files are read by the standard library's parser, and those that it refuses by their statements' indentation, with
strings and brackets passed over. For the others, strings and comments are blanked in place, so that declarations can be
found by their keywords and ends by matching brackets or keywords; offsets stay those of the source.
"""

from __future__ import annotations

import ast
import inspect
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions import detect
from quernel.functions.chunking import chunk_id
from quernel.session import spread

MAX_FILE = 1 << 20

_C = r"//[^\n]*|/\*.*?\*/"
_STR = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_HASH = r"#[^\n]*"
_BLANK = {
    "rust": rf"{_C}|r(?P<h>#*)\".*?\"(?P=h)|b?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\[^\n]{{1,9}}?)'",
    "javascript": rf"{_C}|{_STR}|`(?:[^`\\]|\\.)*`", "typescript": rf"{_C}|{_STR}|`(?:[^`\\]|\\.)*`", "java": rf"{_C}|\"\"\".*?\"\"\"|{_STR}", "go": rf"{_C}|`[^`]*`|{_STR}",
    "c": rf"{_C}|{_STR}", "cpp": rf"{_C}|{_STR}", "csharp": rf"{_C}|@\"(?:[^\"]|\"\")*\"|{_STR}", "swift": rf"{_C}|\"\"\".*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"", "scala": rf"{_C}|\"\"\".*?\"\"\"|{_STR}",
    "dart": rf"{_C}|'''.*?'''|\"\"\".*?\"\"\"|{_STR}", "kotlin": rf"{_C}|\"\"\".*?\"\"\"|{_STR}", "php": rf"{_C}|{_HASH}|{_STR}", "ruby": rf"{_HASH}|{_STR}", "bash": rf"(?<![\w$]){_HASH}|\"(?:[^\"\\]|\\.)*\"|'[^']*'",
    "lua": r"--\[\[.*?\]\]|--[^\n]*|" + _STR, "r": rf"{_HASH}|{_STR}", "perl": rf"{_HASH}|{_STR}", "sql": r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'",
}
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|sealed|partial|async|synchronized|native|default|open|data|inline|suspend|lateinit|case|implicit|lazy|extern|readonly|unsafe|mutating|class|fileprivate|external|factory|const|export|declare|inner|companion|operator|infix|tailrec|strictfp|transient|volatile)\s+)*"
_TYPE = r"[A-Za-z_][\w.]*(?:\s*<[^;{}()=]*>)?(?:\s*\[\s*\])*[?*&]*"
#: Declarations: pattern (with a group ``name``) and kind. Order matters where two match at one place.
_DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "rust": [(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+(?:\S+\s+)?)*fn\s+(?P<name>\w+)", "function")]
    + [(rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?{w}\s+(?:mut\s+)?(?P<name>\w+)", k) for w, k in (("struct", "struct"), ("enum", "enum"), ("trait", "trait"), ("type", "type_alias"), ("mod", "module"), ("const(?!\\s+fn)", "constant"), ("static", "variable"))],
    "javascript": [(r"(?:^|(?<=[;{}(=\s]))(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)", "function"), (r"(?:^|(?<=[;{}(=\s]))class\s+(?P<name>[\w$]+)", "class"), (r"^[ \t]*(?:(?:static|async|get|set)\s+)*\*?\s*(?P<name>#?[\w$]+)\s*(?=\([^;]*?\)\s*\{)", "method")],
    "typescript": [(r"(?:^|(?<=[;{}(=\s]))(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)", "function"), (r"(?:^|(?<=[;{}(=\s]))class\s+(?P<name>[\w$]+)", "class"), (r"(?:^|(?<=[;{}\s]))interface\s+(?P<name>[\w$]+)", "interface"), (r"^[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)\s+)*\*?\s*(?P<name>#?[\w$]+)\s*(?:<[^;{}()]*>)?\s*(?=\([^;]*?\)\s*(?::[^;{}]+)?\{)", "method")],
    "java": [(rf"^[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*{_MODS}{w}\s+(?P<name>\w+)", k) for w, k in (("class", "class"), ("record", "class"), ("interface", "interface"), ("enum", "enum"))] + [(rf"^[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*{_MODS}(?:<[^{{}};()]*>\s*)?(?:{_TYPE}\s+)?(?P<name>\w+)\s*(?=\([^;{{}}]*\)\s*(?:throws[\w\s.,]+)?[{{;])", "method")],
    "php": [(rf"^[ \t]*{_MODS}function\s+&?(?P<name>\w+)", "function")] + [(rf"^[ \t]*{_MODS}{w}\s+(?P<name>\w+)", k) for w, k in (("class", "class"), ("interface", "interface"), ("trait", "trait"), ("enum", "enum"))],
    "ruby": [(r"^[ \t]*def\s+(?:self\.)?(?P<name>[\w?!=]+)", "method"), (r"^[ \t]*class\s+(?P<name>[\w:]+)", "class"), (r"^[ \t]*module\s+(?P<name>[\w:]+)", "module")],
    "bash": [(r"^[ \t]*function\s+(?P<name>[\w:.-]+)\s*(?:\(\s*\))?", "function"), (r"^[ \t]*(?P<name>[\w:.-]+)\s*\(\s*\)", "function")],
    "go": [(r"^func\s+\([^)]*\)\s*(?P<name>\w+)", "method"), (r"^func\s+(?P<name>\w+)", "function"), (r"^(?:type\s+|\t)(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b", "struct"), (r"^(?:type\s+|\t)(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b", "interface"), (r"^const\s+\(?\s*(?P<name>\w+)", "constant")],
    "c": [(r"^(?!\s*(?:return|else|typedef)\b)[ \t]*(?:[A-Za-z_][\w*]*[\s*]+)+(?P<name>\w+)\s*(?=\([^;{}]*\)\s*\{)", "function"), (r"^[ \t]*(?:typedef\s+)?(?:struct|union)\s+(?P<name>\w+)\s*(?=\{)", "struct"), (r"^[ \t]*(?:typedef\s+)?enum\s+(?P<name>\w+)\s*(?=\{)", "enum"), (r"^[ \t]*typedef\b[^;{}]*?(?:\{[^{}]*\})?\s*(?P<name>\w+)\s*(?=;)", "type_alias"), (r"^[ \t]*#[ \t]*define\s+(?P<name>\w+)", "constant")],
    "csharp": [(rf"^[ \t]*(?:\[[^\]]*\]\s*)*{_MODS}{w}\s+(?P<name>[\w.]+)", k) for w, k in (("class", "class"), ("record", "class"), ("interface", "interface"), ("struct", "struct"), ("enum", "enum"), ("namespace", "module"))] + [(rf"^[ \t]*(?:\[[^\]]*\]\s*)*{_MODS}{_TYPE}\s+(?P<name>\w+)\s*(?:<[^;{{}}()]*>)?\s*(?=\([^;{{}}]*\)\s*(?:where[^{{;]*)?(?:[{{;]|=>))", "method")],
    "swift": [(rf"^[ \t]*{_MODS}func\s+(?P<name>\w+)", "function"), (rf"^[ \t]*{_MODS}enum\s+(?P<name>\w+)", "enum"), (rf"^[ \t]*{_MODS}protocol\s+(?P<name>\w+)", "interface")],
    "scala": [(rf"^[ \t]*{_MODS}def\s+(?P<name>[\w$]+)", "function"), (rf"^[ \t]*{_MODS}(?:class|object)\s+(?P<name>\w+)", "class"), (rf"^[ \t]*{_MODS}trait\s+(?P<name>\w+)", "trait")],
    "dart": [(rf"^[ \t]*{_MODS}class\s+(?P<name>\w+)", "class"), (r"^[ \t]*mixin\s+(?P<name>\w+)", "trait"), (r"^[ \t]*enum\s+(?P<name>\w+)", "enum"), (rf"^{_TYPE}\s+(?P<name>\w+)\s*(?=\([^;{{}}]*\)\s*(?:async\s*)?(?:\{{|=>))", "function"), (rf"^[ \t]+{_MODS}{_TYPE}\s+(?P<name>\w+)\s*(?=\([^;{{}}]*\)\s*(?:async\s*)?(?:\{{|=>))", "method")],
    "lua": [(r"^[ \t]*(?:local\s+)?function\s+(?P<name>[\w.:]+)", "function"), (r"^[ \t]*(?:local\s+)?(?P<name>[\w.]+)\s*=\s*function\b", "function")],
    "r": [(r"^[ \t]*(?P<name>[\w.]+)\s*(?:<-|=)\s*function\b", "function"), (r"(?P<name>set(?:Ref)?Class)\s*(?=\()", "class")],
    "perl": [(r"^[ \t]*sub\s+(?P<name>[\w:]+)", "function"), (r"^[ \t]*package\s+(?P<name>[\w:]+)", "module"), (r"^[ \t]*class\s+(?P<name>[\w:]+)", "class")],
    "kotlin": [(rf"^[ \t]*{_MODS}fun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(?P<name>\w+)", "function"), (rf"^[ \t]*{_MODS}(?:enum\s+)?(?:class|interface)\s+(?P<name>\w+)", "class"), (rf"^[ \t]*{_MODS}object\s+(?P<name>\w+)", "class"), (rf"^[ \t]*{_MODS}typealias\s+(?P<name>\w+)", "type_alias")],
    "sql": [(r"\bcreate\s+(?:or\s+replace\s+)?(?:function|procedure)\s+(?P<name>[\w.\"]+)", "function"), (r"\bcreate\s+(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"]+)", "class"), (r"\bcreate\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+(?P<name>[\w.\"]+)", "struct")],
}
_DECLARATIONS["cpp"] = [(r"^[ \t]*(?:template\s*<[^;{}]*>\s*)?(?!(?:return|else|new|typedef)\b)(?:[A-Za-z_](?:\w|::|[<>,*&\s])*[\s*&]+)(?P<name>~?[\w:]+)\s*(?=\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?\{)", "function"), (r"^[ \t]*(?:template\s*<[^;{}]*>\s*)?class\s+(?P<name>\w+)\s*(?=[^;(){}]*\{)", "class"), (r"^[ \t]*(?:template\s*<[^;{}]*>\s*)?(?:struct|union)\s+(?P<name>\w+)\s*(?=[^;(){}]*\{)", "struct"), (r"^[ \t]*enum\s+(?:class\s+)?(?P<name>\w+)", "enum"), (r"^[ \t]*namespace\s+(?P<name>[\w:]+)\s*(?=\{)", "module"), (r"^[ \t]*typedef\b[^;{}]*?\s(?P<name>\w+)\s*(?=;)", "type_alias")]
_FLAGS = re.M | re.I
#: Languages whose declarations may follow a bracket or semicolon on the same line.
_INLINE = ("rust", "javascript", "typescript", "java", "php", "csharp", "swift", "scala", "dart", "kotlin", "cpp")
_DECLARATIONS |= {k: [(re.sub(r"^\^\[ \\t\]\*", r"(?:^|(?<=[{};]))[ \\t]*", p), kind) for p, kind in _DECLARATIONS[k]] for k in _INLINE}
_COMPILED = {k: [(re.compile(p, _FLAGS if k == "sql" else re.M), kind) for p, kind in v] for k, v in _DECLARATIONS.items()}
_BLANKER = {k: re.compile(v, re.S) for k, v in _BLANK.items()}
_NOT_NAMES = set("if for while switch catch return else do try new throw function with await typeof case sizeof using lock foreach synchronized super this elseif when match guard unless until assert yield in".split())
_KEYWORD_END = {"ruby": re.compile(r"^[ \t]*(?:def|class|module|if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|\n]*\|)?[ \t]*$|^[ \t]*end\b|(?<![\w.])end\b", re.M), "lua": re.compile(r"\b(?:function|if|do|repeat|end|until)\b")}


def kinds_of(language: str) -> list[str]:
    """The kinds of symbols that are found in a language."""
    if language == "python":
        return ["function", "class", "method"]
    found = [kind for _, kind in _DECLARATIONS.get(language, [])] + (["method"] if language == "rust" else [])
    return list(dict.fromkeys(found))


def _blank(text: str, language: str) -> str:
    """Strings and comments as spaces of the same length; line breaks stay."""
    return _BLANKER[language].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _close(text: str, at: int, pair: str) -> int:
    depth = 0
    for m in re.compile(rf"[{re.escape(pair)}]").finditer(text, at):
        depth += 1 if m.group() == pair[0] else -1
        if not depth:
            return m.end()
    return len(text)


def _end(text: str, language: str, at: int) -> int:
    """Where the declaration whose head ends at ``at`` ends."""
    if language in _KEYWORD_END:
        depth = 1
        for m in _KEYWORD_END[language].finditer(text, at):
            w = m.group().split()[0] if m.group().split() else ""
            if language == "lua":
                depth += {"end": -1, "until": -1}.get(w, 1) if w != "do" or not re.search(r"\b(?:for|while)\b[^\n]*$", text[text.rfind("\n", 0, m.start()) + 1 : m.start()]) else 1
            else:
                depth += -1 if w == "end" else 1
            if not depth:
                return m.end()
        return len(text)
    if language == "sql":
        m = re.compile(r";|\$\$.*?\$\$\s*(?:language\s+\w+)?\s*;?", re.S | re.I).search(text, at)
        return m.end() if m else len(text)
    m = re.compile(r"[{;(]|=>|\n(?=\s*\n)").search(text, at)
    while m and m.group() == "(":
        m = re.compile(r"[{;(]|=>|\n(?=\s*\n)").search(text, _close(text, m.start(), "()"))
    if not m:
        return len(text)
    if m.group() == "{":
        return _close(text, m.start(), "{}")
    if m.group() == "=>":
        m = re.compile(r";|\n").search(text, m.end())
        return m.end() if m else len(text)
    return m.start() if m.group() == "\n" else m.end()


def _params(text: str, at: int) -> str | None:
    m = re.compile(r"\s*(?:<[^(){};]*>)?\s*\(").match(text, at)
    if not m:
        return None
    return text[m.end() : _close(text, m.end() - 1, "()") - 1]


def doc_above(lines: list[str], row: int) -> str:
    """Documentation in the lines above a row, read upwards: blank lines are passed, marks of line comments are cut, a
    block comment ends the search, as do an empty comment, one of ``!``, TODO and FIXME, and any other line."""
    found: list[str] = []
    block: list[str] | None = None
    for k in range(row - 1, -1, -1):
        line = lines[k].strip()
        if block is not None:
            opened = line.startswith("/*")
            text = re.sub(r"^/\*+!?|^\*+(?!/)", "", line).strip() if opened or line.startswith("*") else line
            if text:
                block.append(text)
            if opened:
                return " ".join([*reversed(block), *reversed(found)]).strip()
            continue
        if not line:
            continue
        if line.startswith("/*") and line.endswith("*/"):
            found.append(re.sub(r"^/\*+!?\s*|\s*\*+/$", "", line))
            break
        if line.endswith("*/"):
            block = [t] if (t := line[:-2].strip(" *")) else []
            continue
        mark = next((p for p in ("//", "#", "--") if line.startswith(p)), None)
        if mark is None:
            break
        while line.startswith(mark):
            line = line[len(mark) :]
        line = line.strip()
        if not line or line == "!" or line.startswith(("TODO", "FIXME")):
            break
        found.append(line.removeprefix("!").strip())
    return " ".join(reversed(found)).strip()


def _python(text: str) -> Iterator[dict]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    lines = text.split("\n")

    def row(node, kind: str) -> dict:
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        code = "\n".join(lines[node.lineno - 1 : node.end_lineno])
        head = re.match(r"\s*(?:async\s+)?(?:def|class)\s+\w+", code)
        params = _params(code, head.end()) if head and kind != "class" else None
        doc = doc_above(lines, first - 1) or (ast.get_docstring(node) or "")
        name = node.name
        sig = f"{name}({params})" if params is not None else name
        return {"name": name, "kind": kind, "signature": sig, "code": code, "doc": doc or None, "line_start": node.lineno, "line_end": node.end_lineno, "is_public": False, "is_async": isinstance(node, ast.AsyncFunctionDef)}

    def inside(node, kind: str) -> Iterator[dict]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                yield row(child, kind)
            elif isinstance(child, ast.ClassDef):
                if kind == "function":
                    yield row(child, "class")
                yield from inside(child, "method")
            else:
                yield from inside(child, kind)

    yield from inside(tree, "function")


_PY_TOKEN = re.compile(
    r"(?P<nl>\n)|(?P<ws>[ \t\f\r]+|\\\r?\n)|(?P<cm>#[^\n]*)"
    r"|(?P<str>[rRbBuUfFtT]{0,2}(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'))"
    r"|(?P<id>[^\W\d]\w*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<op>:)|(?P<any>[\s\S])"
)
_PY_CONFLICT = re.compile(r"(?:<{7}|>{7}|\|{7}|={7})(?![<>|=])[^\n]*")
_PY_START = re.compile(r"[ \t\f]*(?:(?:async[ \t]+)?def[ \t]+\w+[ \t]*[(\[]|class[ \t]+\w+[ \t]*[(:\[]|@[A-Za-z_][\w.]*[ \t]*(?:\(|\r?$))", re.M)
_PY_HEAD = re.compile(r"(?:async\s+)?(def|class)\s+(\w+)")


def _statements(text: str) -> Iterator[tuple[int, int, int, bool, list[tuple[str, int, int]]]]:
    """(indentation, start, end, whether brackets are closed, tokens) of each logical line, valid or not. Strings cannot
    end a line, nor can open brackets, unless a definition or a decorator begins on one: then the bracket was never closed."""
    at, n, depth = (1 if text[:1] == "\ufeff" else 0), len(text), 0
    tokens: list[tuple[str, int, int]] = []

    def line():
        begin = tokens[0][1]
        lead = text[text.rfind("\n", 0, begin) + 1 : begin].replace("\ufeff", "")
        return len(lead[lead.rfind("\f") + 1 :].expandtabs(8)), begin, tokens[-1][2], not depth, tokens

    while at < n:
        if (not at or text[at - 1] == "\n") and (m := _PY_CONFLICT.match(text, at)):
            at = m.end()
            continue
        m = _PY_TOKEN.match(text, at)
        kind, at = m.lastgroup, m.end()
        if kind == "nl":
            if tokens and (not depth or _PY_START.match(text, at)):
                yield line()
                tokens, depth = [], 0
        elif kind not in ("ws", "cm"):
            depth = depth + 1 if kind == "open" else max(0, depth - 1) if kind == "close" else depth
            if kind == "any" and m.group() in "\"'" and not text.startswith(m.group() * 3, m.start()):
                at = text.find("\n", at) if "\n" in text[at:] else n  # a string that is never closed ends with its line
            elif kind == "any" and m.group() in "\"'":
                at += 2
            tokens.append((kind, m.start(), at))
    if tokens:
        yield line()


def python_blocks(text: str) -> list[dict]:
    """Functions and classes of a Python text that need not parse, in source order, with those that hold them: ``start`` and
    ``end`` are offsets, ``first`` that of the first decorator, ``outer`` the words ``def`` and ``class`` around it."""
    found: list[dict] = []
    open_: list[tuple[int, dict]] = []
    first = fresh = None
    pending: list[dict] = []  # a head without a colon or with an open bracket, until deeper lines follow
    for indent, start, end, closed, tokens in _statements(text):
        for b in pending:
            if indent <= b["indent"]:
                found.remove(b)
        pending = []
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        for _, b in open_:
            b["end"] = end
        if fresh is not None and open_ and open_[-1][1] is fresh and all(k == "str" for k, _, _ in tokens):
            fresh["string"] = text[start:end]
        fresh = None
        if text[start] == "@":
            first = start if first is None else first
            continue
        m = _PY_HEAD.match(text, start)
        if m:
            b = {"word": m.group(1), "name": m.group(2), "is_async": m.group().startswith("async"), "indent": indent, "start": start, "end": end, "first": start if first is None else first, "outer": [x["word"] for _, x in open_], "string": ""}
            depth, head = 0, None
            for k, (kind, a, z) in enumerate(tokens):
                depth += (kind == "open") - (kind == "close")
                if kind == "op" and not depth:
                    head = k
                    break
            if head is None and not closed:  # the bracket stays open: the head ends with the line whose colon a deeper line follows
                inner = re.compile(r":[ \t]*(?:#[^\n]*)?\r?\n(?=(?:[ \t]*\r?\n)*([ \t]+)\S)").search(text, start, end)
                if inner and len(inner.group(1).expandtabs(8)) > indent:
                    head = len(tokens)
            if head is None:
                pending.append(b)
            elif head < len(tokens) - 1 and all(k == "str" for k, _, _ in tokens[head + 1 :]):
                b["string"] = text[tokens[head + 1][1] : end]
            elif head == len(tokens) - 1:
                fresh = b
            found.append(b)
            open_.append((indent, b))
            if not closed and head is None:
                found.remove(b)
                open_.pop()
                pending = []
        first = None
    for b in pending:
        found.remove(b)
    return found


def _python_broken(text: str) -> Iterator[dict]:
    """As ``_python``, for texts that do not parse."""
    lines = text.split("\n")
    for b in python_blocks(text):
        if "def" in b["outer"] or (b["word"] == "class" and "class" in b["outer"]):
            continue
        begin, last = text.count("\n", 0, b["start"]), text.count("\n", 0, b["end"])
        code = "\n".join(lines[begin : last + 1])
        head = re.match(r"\s*(?:async\s+)?(?:def|class)\s+\w+", code)
        params = _params(code, head.end()) if head and b["word"] == "def" else None
        doc = doc_above(lines, text.count("\n", 0, b["first"]))
        if not doc and b["string"]:
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    value = ast.literal_eval(f"({b['string']})")
            except (SyntaxError, ValueError, RecursionError):
                value = ""
            doc = inspect.cleandoc(value) if isinstance(value, str) else ""
        kind = "class" if b["word"] == "class" else "method" if "class" in b["outer"] else "function"
        sig = f"{b['name']}({params})" if params is not None else b["name"]
        yield {"name": b["name"], "kind": kind, "signature": sig, "code": code, "doc": doc or None, "line_start": begin + 1, "line_end": last + 1, "is_public": False, "is_async": b["is_async"]}


def extract_symbols(text: str, language: str) -> list[dict]:
    """Symbols of a text in source order; in Rust, what is nested comes before what holds it."""
    if language == "python":
        try:
            return list(_python(text))
        except (SyntaxError, ValueError, RecursionError):
            return list(_python_broken(text))
    if language not in _COMPILED:
        return []
    bare, lines = _blank(text, language), text.split("\n")
    hits: dict[int, tuple[re.Match, str]] = {}
    for pattern, kind in _COMPILED[language]:
        for m in pattern.finditer(bare):
            if m.group("name") and (m.group("name") not in _NOT_NAMES or language in ("rust", "go") and m.group("name") in ("new", "with", "lock", "get", "until", "when", "function")):
                hits.setdefault(m.start("name"), (m, kind))
    classes = [(m.end(), _end(bare, language, m.end())) for m, k in hits.values() if k in ("class", "interface", "enum", "trait", "struct")]
    impls = [(m.end(), _close(bare, m.end() - 1, "{}")) for m in re.finditer(r"^[ \t]*(?:unsafe\s+)?impl\b[^;{]*\{", bare, re.M)] if language == "rust" else []
    out = []
    for at in sorted(hits):
        m, kind = hits[at]
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        end = _end(bare, language, m.end()) if not (language in ("c", "cpp") and kind == "constant") else (bare.find("\n", m.end()) if "\n" in bare[m.end() :] else len(bare))
        if kind == "method" and language in ("javascript", "typescript", "java", "csharp", "dart") and not any(a <= start < b for a, b in classes):
            continue
        if language == "rust" and kind == "function" and any(a <= start < b for a, b in impls):
            kind = "method"
        if language == "rust" and kind in ("function", "method") and text[end - 1 : end] == ";":
            continue  # a declaration without a body
        if language == "java" and kind == "method" and re.match(r"\s*(?:return|new|throw|else)\b", m.group()):
            continue
        name = m.group("name").strip('"')
        params = _params(text, m.end("name")) if kind in ("function", "method") else None
        row = bare.count("\n", 0, start)
        before = text[text.rfind("\n", 0, start) + 1 : start] + text[start : m.start("name")]
        out.append(
            {
                "name": name, "kind": kind, "signature": f"{name}({params})" if params is not None else name, "code": text[start:end], "doc": doc_above(lines, row) or None,
                "line_start": row + 1, "line_end": row + 1 + text.count("\n", start, end), "is_public": bool(re.search(r"\bpub\b|\bexport\b", before)), "is_async": bool(re.search(r"\basync\b", before)),
            }
        )
    if language == "rust":
        out.sort(key=lambda s: (s["line_end"], -s["line_start"]))
    return out


def symbols(files: DataFrame, compat_language: bool = False, tracked: list[str] | None = None) -> DataFrame:
    """Symbol rows of a table (repo, branch, commit, path, content).

    Files above 1 MiB, null contents and unsupported languages give none; ``tracked`` keeps only some languages.
    """
    rows = files.where(F.octet_length("content") <= MAX_FILE).withColumn("language", detect.language_by_path("path"))
    rows = rows.where(F.col("language").isin(tracked) if tracked else F.col("language").isNotNull())
    names = ["repo", "branch", "commit", "path", "language", "content"]
    fields = ["name", "kind", "signature", "code", "doc", "line_start", "line_end", "is_public", "is_async"]
    schema = "repo string, branch string, commit string, file_path string, language string, ordinal int, name string, kind string, signature string, code string, doc string, line_start bigint, line_end bigint, is_public boolean, is_async boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for repo, branch, commit, path, language, content in p[names].itertuples(index=False):
                try:
                    found = extract_symbols(content, language)
                except Exception:  # noqa: BLE001 - one file must not stop the job
                    found = []
                shown = "unknown" if compat_language else language
                out += [(repo, branch, commit, path, shown, i, *(s[f] for f in fields)) for i, s in enumerate(found)]
            yield pd.DataFrame(out, columns=["repo", "branch", "commit", "file_path", "language", "ordinal", *fields])

    got = spread(rows.select(*names), "path").mapInPandas(run, schema)
    empty = F.lit("")
    key = chunk_id(F.col("repo"), F.col("file_path"), F.col("ordinal").cast("string"), F.col("kind"), F.col("name"))
    return got.withColumns({"id": key, "module_path": empty, "parent": F.lit(None).cast("string"), "column_start": F.lit(0).cast("bigint"), "column_end": F.lit(0).cast("bigint"), "is_static": F.lit(False)})


def with_module(symbols_: DataFrame, module: str) -> DataFrame:
    """The same symbols under another module path."""
    return symbols_.withColumn("module_path", F.lit(module))


def qualified_name(scope, name):
    """``scope::name``; the name alone where the scope is empty or null."""
    s, n = (F.col(x) if isinstance(x, str) else x for x in (scope, name))
    return F.concat_ws("::", F.nullif(s, F.lit("")), n)
