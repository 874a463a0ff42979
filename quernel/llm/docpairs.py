"""Problem 2: functions paired with their documentation.

Functions of files are found by the grammars: the rule of a function is charted alone wherever one can begin, so that valid
functions of broken files come out.

The head of a function is charted by a generalised LL grammar on graph-structured stacks (``gll``) with recovery: a token
that the chart does not take is skipped, so heads of broken files still lead to their bodies. A string at the start of a
Python body is documentation, as is the ``doc`` column. Documentation is trivial when nothing is left of it but the
function's own words, filler, tasks, directives, licence lines, disabled code or bare tags; and a description that recurs
word for word, its function's own words aside, under very many different names is a template and dropped by hash count.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.symbols import doc_above, python_blocks
from quernel.llm import gll, syntax
from quernel.llm.tokens import strings
from quernel.session import spread, stage

TEMPLATE_SHARE = 0.002  # of all documented names, under which one description makes a template
TEMPLATE_NAMES = 3  # names that are the least evidence of a repetition; the share asks for more from 1,500 names on

HEAD = r"""
file = decorator* 'async'? 'def' name? tparams? params ('->' token+)? ':' (NEWLINE INDENT)? ;
decorator = '@' token+ NEWLINE ;
name = ID | 'match' | 'case' | 'type' | '_' ;
tparams = '[' inside* ']' ;
params = '(' inside* ')' ;
inside = ANY_TOKEN | '(' inside* ')' | '[' inside* ']' | '{' inside* '}' ;
token = ID | NUM | STR | '.' | ',' | BINOP | '|' | 'None' | name | '(' inside* ')' | '[' inside* ']' | '{' inside* '}' ;
"""
_DEF = re.compile(r"^\s*(?:@|async\s+def\b|def\b)")
_STRING = re.compile(r"[rRbBuUfF]{0,2}(\"\"\"|'''|\"|')([\s\S]*?)(?:\1|\Z)")
_OPEN_HEAD = re.compile(r"\s*(?:@[^\n]*\n\s*)*(?:async\s+)?def\b[^\n]*:[ \t]*\n\s*[rRbBuUfF]{0,2}(\"\"\"|''')([\s\S]*?)(?:\1|\Z)")
_heads: list[gll.Grammar] = []


def body_string(code: str) -> str:
    """The string at the start of a Python function's body, or ""."""
    if not _heads:
        _heads.append(gll.Grammar(HEAD, "file"))
    g = _heads[0]
    lang = syntax.language("python")
    most = 64
    while True:
        tokens = syntax._python_tokens(code, lang, most)
        whole = tokens[-1][0] == gll.END
        column = g.first
        for t, at, _ in tokens:
            if column.ends and t == "STR":
                m = _STRING.match(code, at)
                return m.group(2) if m else ""
            after = g.step(column, t)
            if after is None:
                if column.ends:  # an unclosed string of a cut-off body still counts
                    return code[at + 3 :] if code.startswith(('"""', "'''"), at) else ""
                continue  # recovery: the token is skipped
            column = after
        if whole:  # the head never ended: a colon at a line's end closes what is open in it
            m = _OPEN_HEAD.match(code)
            return m.group(2) if m else ""
        most *= 4


_MARKS = re.compile(r"^[ \t]*(?:/\*+!?|//+!?|\*+/|\*(?!\*)|#+!?|--+|;;+|\"\"\"|'''|/(?=\s|$)|%+|<!--)?[ \t]?")
_END = re.compile(r"[ \t]*(?:\*+/|\"\"\"|'''|-->)[ \t]*$")
_WORD = re.compile(r"[^\W\d_]+(?:['’][a-z]+)?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_A-Za-z]+")
_TASK = re.compile(r"(?i)^\W*(?:(?:todo|fixme|xxx|tbd|tba|wip|hack)(?=\W*$|\s*[:(\[!,.–-]|(?:\s+\S+){1,4}\W*$)|to ?do(?=\s*:|\W*$)|pending\W*$|placeholder\W*$|insert (?:doc|desc)\w*|add (?:doc|desc|comment)\w*|(?:write|needs?|missing|no|add|put|fill in) (?:the |some |a |your )?(?:doc|desc|comment)\w*|(?:documentation|description|docs?|docstring|comment)s? (?:to|goes|go|here|missing|pending|needed|tbd|follow)\w*|work in progress|undocumented|not documented|noch (?:zu )?(?:beschreiben|dokumentieren)|à (?:documenter|compléter)|por (?:documentar|completar)|未記入|待补充|待完善|後で書く|あとで書く|n/?a|none|null)\b")
_STUB = re.compile(r"(?i)^\W*(?:auto[- ]?generated|generated) (?:\w+ )?(?:stub|method|function|doc\w*|comment)\b|^\W*\{?@inherit[- ]?doc\b\}?\W*$|^\W*(?:\{@inheritDoc\})\W*$|^\W*see (?:above|below)\W*$")
_DIRECTIVE = re.compile(
    r"(?i)^\W*(?:noqa\b|type:\s*ignore|pragma\b|pylint\b|flake8\b|mypy\b|pyright\b|fmt:\s*(?:on|off|skip)|isort\b|yapf\b|black:|ruff\b|nosec\b|bandit\b|nolint\b|lint:|go:\w+|\+build\b|eslint\b|jshint\b|jslint\b|tslint\b|prettier\b|istanbul\b|c8 ignore|v8 ignore|ts-(?:ignore|expect-error|nocheck|check)|flow\b|clippy::|rustfmt|allow\(|deny\(|warn\(|cfg\(|inline\b\W*$|must_use\b|derive\(|#?(?:end)?region\b|suppress\w*\b|checkstyle\b|sonar\w*\b|nosonar\b|formatter:|spotless:|coverage\b|cspell\b|codespell\b|webpack\w*:|@?(?:deprecated|override|internal|private|public|protected|ignore|hidden|nodoc|test|since|version|author|see|todo|inheritdoc|final|static|abstract|async|function|method|class|export|api|override|readonly|constructor|memberof|module|namespace|package)\b\W*$|-\*-.*-\*-|vim?:|coding[:=]|language=|language\s*:\s*\w+$|doctest:|skipcq|gofmt|golint|safety:?\W*$|unsafe\W*$)"
)
_LICENCE = re.compile(r"(?i)^\W*(?:spdx-|copyright\b|\(c\)\s|©|licen[sc]ed? |all rights reserved|distributed under|released under|this (?:file|code|source) is (?:part of|licen)|permission is hereby|the .{0,20}licen[sc]e|mit licen|apache licen|bsd licen|gnu )")
_TAG = re.compile(r"^\W{0,3}(?:[@:\\](?P<tag>param(?:eter)?s?|arg(?:ument)?s?|returns?|retval|throws?|raises?|exceptions?|type|rtype|template|tparam|typeparam|yields?|see|since|version|author|deprecated|example|note|link|default|property|prop|member|var|ivar|cvar|keyword|kwarg|key)\b[ \t:]*)(?P<rest>.*)$", re.I)
_LIST = re.compile(r"^\W{0,3}(?P<n>[A-Za-z_]\w*)\s*(?:\([^)]*\))?\s*(?:-+|–|:)\s*(?P<rest>.*)$")
_SECTION = re.compile(r"(?i)^\W*(?:args|arguments|parameters|params|returns?|raises|throws|yields|examples?|notes?|see also|attributes|errors|panics|safety)\W*$")
_CODE = re.compile(
    r"^\s*(?:(?:return|if|for|while|let|const|var|else|throw|raise|import|from|def|fn|func|switch|case|break|continue|pass|yield|await|del|print|use|pub|match|try|catch|finally|int|String|bool|double|final|public|private)\b(?=.*[=(;:{\[]|\s*\w+;?\s*$|\s*;?\s*$).*|[\w.\[\]\"']+\s*(?:[-+*/%|&^]|<<|>>)?:?=(?!=)\s*\S.*|[\w$]+(?:(?:\.|::|->)[\w$]+)*\s*\(.*\)\s*[;{:]?\s*|[\w$]+(?:(?:\.|::|->)[\w$]+)+\s*;|[}\])]+[;,]?|.*[;{]\s*)$"
)
#: Words that say nothing by themselves, in the languages of the corpus. Fixed values.
FILLER = set(
    (
        "a an the this that these those it its is are be was of for to in on at by with from and or as into given some any all each "
        "function functions method methods func fn procedure routine helper helpers utility util implementation implements impl wrapper stub class struct type object "
        "does do will would can could may shall should used use uses using simply just only that which called call calls named name performs perform performing executes execute executing runs run handles handle "
        "description describes describe doc docs documentation comment summary default main internal here purpose "
        "return returns returning param params parameter parameters arg args argument arguments value values result results self void none "
        "die der das eine ein einen einem funktion methode hilfsfunktion zum zur für und von im "
        "la le les un une fonction méthode de du des pour et "
        "el los las una función método para y del "
        "関数 メソッド する です の を は が 函数 方法 的 用于 一个"
    ).split()
)


def clean(doc: str) -> list[str]:
    """Lines of a documentation without comment marks; blank lines are left out."""
    out = []
    doc = doc.replace("\r", "\n")
    if m := re.match(r"\s*(///?!?|/|#+|--)(?=\s)", doc):  # lines put together with their marks left in
        doc = re.sub(rf"(?<=\s){re.escape(m.group(1))}(?=\s)", "\n" + m.group(1), doc)
    for line in doc.split("\n"):
        line = _END.sub("", line)
        line = _MARKS.sub("", line, count=1)
        line = _MARKS.sub("", line, count=1) if line[:2] in ("//", "* ", "# ") else line
        line = line.strip()
        if line:
            out.append(line)
    return out


def stem(w: str) -> str:
    """A crude stem: endings of verbs and plurals fall away, however they are spelled."""
    w = w.lower().replace("’", "'")
    for end in ("'s", "ing", "ied", "ies", "ed", "es", "s"):
        if w.endswith(end) and not w.endswith(("ss", "eed")):
            rest = w[: -len(end)]
            if len(rest) >= 3 and re.search(r"[aeiouy]", rest):
                w = rest
                break
    if len(w) > 3 and w[-1] == w[-2]:
        w = w[:-1]
    return w.rstrip("eyi") or w


def own_words(name: str, signature: str) -> set[str]:
    return {stem(p) for p in _PART.findall(f"{name} {signature}")}


def says_something(line: str, own: set[str]) -> bool:
    """Whether a line has a word beyond the function's own words and filler."""
    if re.search(r"[぀-ヿ㐀-鿿가-힯]", line):
        rest = re.sub(r"[A-Za-z0-9_\W]+", "", line)
        return len(rest) >= 3
    for w in _WORD.findall(line):
        if w.lower() in FILLER:
            continue
        parts = _PART.findall(w) or [w]
        if any(len(p) > 1 and p.lower() not in FILLER and stem(p) not in own for p in parts):
            return True
    return False


def _tag_text(rest: str, tag: str) -> str:
    """What a tag says beside the name or type it is about."""
    if tag.lower() in ("see", "since", "version", "author", "link", "default", "type", "rtype", "template", "deprecated") and not re.search(r"\w+\s+\w+\s+\w+", rest):
        return ""
    rest = re.sub(r"^\{[^}]*\}\s*", "", rest)
    if tag.lower().startswith(("param", "arg", "throw", "raise", "exception", "prop", "var", "ivar", "member", "key", "kwarg", "type", "tparam")):
        rest = re.sub(r"^\[?[\w.$*<>]+\]?\s*[:\-–]*\s*", "", rest)
    return rest


def description(doc: str, name: str, signature: str) -> str:
    """The lines of a documentation that say something, or "" for a trivial one."""
    own = own_words(name, signature)
    out = []
    for line in clean(doc):
        if _TASK.match(line) or _STUB.match(line) or _DIRECTIVE.match(line) or _LICENCE.match(line) or _SECTION.match(line):
            continue
        m = _TAG.match(line)
        if m:
            text = _tag_text(m.group("rest"), m.group("tag"))
        elif (m := _LIST.match(line)) and stem(_PART.findall(m.group("n"))[0] if _PART.findall(m.group("n")) else "") in own:
            text = m.group("rest")
        else:
            if _CODE.match(line) and not re.search(r"[a-z]+ [a-z]+ [a-z]+ [a-z]+", line):
                continue
            text = line
        if says_something(text, own):
            out.append(line)
    return "\n".join(out)


def template(text: str, name: str, signature: str) -> str:
    """A description with its function's own words and numbers masked."""
    own = own_words(name, signature)
    return " ".join("□" if stem(w) in own else w.lower() for w in _WORD.findall(text))


#: Rules of a function alone, beside the languages' grammars.
_ALONE = {
    "python": "",
    "javascript": "alone = 'static'? ('async'? '*'? prop_name params block | ('get' | 'set') prop_name params block) ;",
    "typescript": "alone = modifier* ('*'? prop_name '?'? sig block | ('get' | 'set') prop_name sig block) ;",
    "rust": "",
    "go": "",
    "java": "alone = modifier* (method | ctor) ;",
}
#: The rule and the words at which a function begins.
_RULES = {"python": ("def", ()), "javascript": ("fn_decl", ("function",)), "typescript": ("fn_decl", ("function",)), "rust": ("fn", ("fn",)), "go": ("func", ("func",)), "java": ("alone", ())}
_SOFT = {"ID", "PRIVATE", "of", "from", "as", "get", "set", "type", "is", "require", "default", "delete", "union", "record", "open", "to", "with", "match", "case", "_"}
_RUST_LEAD = re.compile(r"(?:pub(?:\([^()\n]*\))?\s+|default\s+|const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"\n]*\"\s+)?)*\Z")
_grammars: dict[str, gll.Grammar] = {}


def _grammar(name: str) -> gll.Grammar:
    if name not in _grammars:
        _grammars[name] = gll.Grammar(syntax._GRAMMARS[name] + _ALONE[name], "file")
    _grammars[name].trim()
    return _grammars[name]


def _reach(lang, g: gll.Grammar, rule: str, tokens, at: int) -> int:
    """The index behind the longest text from token ``at`` on that the rule takes and a block ends, or -1; methods of Java's
    interfaces have no block."""
    column, best = g._column({(g.start_of[rule], None)}), -1
    for i in range(at, len(tokens)):
        t = tokens[i]
        after = g.step(column, t[0])
        if after is None and lang.virtual and (t[0] == "}" or (t[2] and lang.virtual == "ASI")):
            between = g.step(column, lang.virtual)
            after = g.step(between, t[0]) if between is not None else None
        if after is None:
            return best
        column = after
        if column.ends and (t[0] in ("}", "DEDENT", "NEWLINE") or t[0] == ";" and rule == "alone" and lang.name == "java"):
            best = i + 1
    return best


def _python_functions(text: str) -> list[dict]:
    """Functions of a Python text. Their heads are looked for statement by statement, past strings and brackets that are
    never closed; from there on the grammar tells where each ends and whether it is valid."""
    lang, g, lines, out = syntax.language("python"), _grammar("python"), text.split("\n"), []
    for b in python_blocks(text):
        if b["word"] != "def":
            continue
        row = text.count("\n", 0, b["start"])
        lead = lines[row][: len(lines[row]) - len(lines[row].lstrip())]
        framed, most = "if x:\n" * bool(lead) + text[b["start"] - len(lead) :], 256
        while True:  # no more of the text is read than the function needs
            tokens = syntax._python_tokens(framed, lang, most)
            first = next(i for i, t in enumerate(tokens) if t[0] in ("def", "async"))
            end = _reach(lang, g, "def", tokens, first)
            if tokens[-1][0] == gll.END or (end >= 0 and end < len(tokens)):
                break
            most *= 4
        if end < 0:
            continue
        stop = max(t[1] for t in tokens[first:end] if t[0] == "NEWLINE")
        head = len("if x:\n") * bool(lead) + len(lead)
        code = "\n".join(x.removeprefix(lead) for x in framed[head:stop].split("\n")).rstrip()
        doc = doc_above(lines, text.count("\n", 0, b["first"]))
        out.append({"name": b["name"], "kind": "method" if lead else "function", "signature": code.split("\n")[0], "code": code, "doc": doc, "line_start": row + 1})
    return out


def functions_of(text: str, name: str) -> list[dict]:
    """The valid functions of a text in a language, whether or not the text is valid as a whole. Wherever a function can
    begin, the grammar's rule for one is charted on its own; what it takes up to the end of a block is the function, and
    where it takes nothing there is none."""
    if name == "python":
        return _python_functions(text)
    lang, g = syntax.language(name), _grammar(name)
    rule, words = _RULES[name]
    tokens, lines, out = syntax.tokenize(text, lang), text.split("\n"), []
    for i, (t, start, _) in enumerate(tokens[:-1]):
        kind, at, which = "function", i, rule
        if t in words:
            if i and tokens[i - 1][0] == "async":
                at = i - 1
            named = next((k for k in range(i + 1, min(i + 3, len(tokens))) if tokens[k][0] in _SOFT), None)
            if name == "go" and tokens[i + 1][0] == "(":
                kind, close = "method", next((k for k in range(i + 1, len(tokens)) if tokens[k][0] == ")"), i)
                named = close + 1 if close + 1 < len(tokens) and tokens[close + 1][0] in _SOFT else None
        elif "alone" in g.start_of and (not i or tokens[i - 1][0] in ("{", "}", ";")) and t not in ("{", "}", ";", "(", gll.END):
            # methods: what stands before the first bracket names them
            bracket = next((k for k in range(i, len(tokens)) if tokens[k][0] in ("(", "{", "}", ";", "=")), i)
            if tokens[bracket][0] != "(" and t != "@":
                continue
            named = next((k for k in range(bracket - 1, i - 1, -1) if tokens[k][0] in _SOFT), None)
            kind, which = "method", "alone"
            if t != "@" and (named is None or tokens[bracket - 1][0] not in _SOFT | {">", "]"}):
                continue
        else:
            continue
        end = _reach(lang, g, which, tokens, at)
        if end < 0 or (named is None and t != "@"):
            continue
        if t == "@":  # annotations come first: the name stands before the parameters' bracket
            depth = [k for k in range(at, end) if tokens[k][0] == "{"][:1]
            opened = [k for k in range(at + 1, depth[0] if depth else end) if tokens[k][0] == "(" and tokens[k - 1][0] in _SOFT]
            if not opened:
                continue
            named = opened[-1] - 1
        begin, stop = tokens[at][1], tokens[end - 1][1] + 1
        if name == "rust":
            begin -= len(_RUST_LEAD.search(text[text.rfind("\n", 0, begin) + 1 : begin]).group())
            kind = "method" if text[text.rfind("\n", 0, begin) + 1 : begin].isspace() else "function"
        code = text[begin:stop]
        called = re.match(r"#?[\w$]+", text[tokens[named][1] :])
        row = text.count("\n", 0, begin)
        out.append({"name": called.group() if called else "", "kind": kind, "signature": code.split("{")[0].rstrip("; \n").strip(), "code": code, "doc": doc_above(lines, row), "line_start": row + 1})
    return out


def file_functions(files: DataFrame) -> DataFrame:
    """file_id, name, line_start, code and description of the valid, documented functions of every source file, those of
    files that do not parse included, without templates of the corpus. Null ids, contents and paths give none; copies count
    once."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for kv in syntax.EXTENSIONS.items() for x in kv])
    rows = files.where(F.col("file_id").isNotNull() & F.col("content").isNotNull() & ext.isin(list(syntax.EXTENSIONS)))

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for key, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strings(batch.column(2))):
                for f in functions_of(text, name):
                    said = description(f["doc"] or "", f["name"], f["signature"])
                    if not said and name == "python":
                        said = description(body_string(f["code"]), f["name"], f["signature"])
                    if said:
                        for column, value in zip(out, (key, f["name"], f["line_start"], f["code"], said, template(said, f["name"], f["signature"]))):
                            column.append(value)
            arrays = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["file_id", "name", "line_start", "code", "description", "template"])

    schema = "file_id bigint, name string, line_start bigint, code string, description string, template string"
    found = spread(rows.select("file_id", kinds[ext].alias("language"), "content"), "file_id").mapInArrow(run, schema)
    return without_templates(found, "file-pairs").select("file_id", "name", "line_start", "code", "description").distinct()


def documented(symbols: DataFrame) -> DataFrame:
    """symbol_id, signature, code and description of every function and method whose documentation is not trivial.

    ``doc`` comes first, the string at the body's start second; where both say something they are joined. Null columns
    count as empty; rows with a null id, or of another kind, are left out; rows of one id with different texts are judged
    each on its own, copies count once; an empty table gives no rows.
    """
    schema = "symbol_id string, name string, signature string, code string, description string, template string"

    def run(batches):
        for batch in batches:
            cols = [strings(batch.column(i)) for i in range(1, 7)]
            keep, text, temp = [], [], []
            for i, (name, signature, path, lang, doc, code) in enumerate(zip(*cols)):
                said = description(doc, name, signature) if doc.strip() else ""
                if not said or not doc.strip():
                    if path.endswith(".py") or lang.lower() == "python" or (not path and _DEF.match(code)):
                        if ('"' in code or "'" in code) and (inside := body_string(code)):
                            said = description(inside, name, signature)
                if said:
                    keep.append(i)
                    text.append(said)
                    temp.append(template(said, name, signature))
            rows = pa.array(keep, pa.int64())
            arrays = [batch.column(0).take(rows), batch.column(1).take(rows), batch.column(2).take(rows), batch.column(6).take(rows), pa.array(text, pa.string()), pa.array(temp, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["symbol_id", "name", "signature", "code", "description", "template"])

    rows = symbols.where(F.col("kind").isin("function", "method") & F.col("id").isNotNull())
    return spread(rows.select("id", "name", "signature", "file_path", "language", "doc", "code"), "id").mapInArrow(run, schema)


def without_templates(found: DataFrame, stage_name: str) -> DataFrame:
    """The rows whose description, of whatever length, is no template of the corpus."""
    found = stage(found.withColumn("h", F.xxhash64("template")).drop("template"), stage_name)
    names = found.select(F.approx_count_distinct("name")).first()[0]
    least = max(TEMPLATE_NAMES, TEMPLATE_SHARE * names)
    repeated = found.groupBy("h").agg(F.approx_count_distinct("name").alias("n")).where(F.col("n") >= least).select("h")
    return found.join(repeated, "h", "left_anti")


def pairs(symbols: DataFrame) -> DataFrame:
    """The code-description pairs without those whose description is a template of the corpus."""
    return without_templates(documented(symbols), "doc-pairs").select("symbol_id", "signature", "code", "description")
