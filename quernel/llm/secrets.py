"""Problem 4: credentials in source code, found by subword statistics and context, and masked in place.

A string is unnatural when a public tokenizer needs many subwords for it: few characters a subword. Every candidate of an
Arrow batch is scored in one call, and none is a secret that has too many. Context decides what an unnatural string is:
the name it is assigned to, a fallback of a setting, an authorization header, the user part
of an address, a field of a connection string, the marks of a private key or of a vendor's token. Placeholders,
references to a secret kept elsewhere, encrypted or hashed values, words and messages are no secrets. Masks are as long
as what they replace and hold letters only, so offsets, quotes and escapes stay as they were.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.tokens import DEFAULT_FILE, encode_texts, strings
from quernel.session import spread

UNNATURAL = 2.3  # characters a subword; words of code and prose have 4 to 6
SOME_UNNATURAL = 3.0  # enough where letters, digits and signs are mixed
READABLE = 4.5  # enough for a word with a number in a password's place; nothing above is a secret
MIN_LENGTH = 6  # of a value in a secret's place (4 in an address); shorter ones are not told from codes and flags

#: Every rule below needs one of these, so rows without any have no candidate to score.
TRIGGER = (
    r"(?i)pass|pwd|secret|token|key|cred|auth|bearer|basic |://[^/\s:@]*:[^/\s@]+@|PRIVATE KEY|AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|[sr]k_live_|AIza|npm_|SG\.|eyJ|pypi-|hf_|dop_v1_|[-_][A-Za-z0-9]{16}|xoxb|glpat|\s-u\s|--user\s|'AIza"
)
_NAME = (
    r"(?:pass(?:word|wd|phrase|code)?|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|signing[_-]?key|encryption[_-]?key|client[_-]?key|master[_-]?key|account[_-]?key|shared[_-]?key|auth[_-]?key|deploy[_-]?key|service[_-]?key|session[_-]?key|hmac[_-]?key|storage[_-]?key|credentials?|authorization|auth|bearer|apikey)"
)
#: Names that end in one of these hold something about a secret, not the secret.
_ABOUT = re.compile(
    r"(?:hash|digest|checksum|sum|id|ids|name|names|label|field|url|uri|path|file|filename|type|kind|length|len|size|count|counts|limit|ttl|expiry|expires|expires_?in|expires_?at|header|prefix|suffix|policy|hint|form|regex|pattern|public|salt|ref|arn|version|index|input|placeholder|error|message|msg|title|description|scope|scopes|alg|algorithm|endpoint|class|column|table|offset|position|provider|reset|column_name|text|env|var|variable|source|format|fingerprint|rules?|strength)$",
    re.I,
)
_LITERAL = r"(?:r#*)?(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)"
_PIECES = re.compile(rf"{_LITERAL}(?:\s*[+.,]?\s*{_LITERAL})*")
_ANY_LITERAL = re.compile(_LITERAL)
_KEYED = re.compile(
    # the name, perhaps quoted, in brackets or with a type; then = := : => or a call; then fallbacks of a setting
    rf"(?<![A-Za-z0-9])(?P<name>[A-Za-z0-9_.-]*{_NAME}(?:[_-]?(?:b64|base64|value|str|string|key|default|raw|plain|old|new|prod|dev|live|\d+))?)(?P<tail>[A-Za-z0-9_-]*)"
    r"[\"'`\]]*\s*(?::\s*[&']?[\w<>\[\], .:&|?*']{1,40}?\s*(?==[^=]))?"
    rf"(?P<op>:=|=>|==?=?|!==?|:|\(|,|\bis\b|\bto\b|>|(?<=\w)[ ](?=[A-Za-z0-9+/_.~@#$%^&*!?=-]{{10,}}(?:\s|$)))\s*(?P<rest>[^\n]*)",
    re.I,
)
_FALLBACK = re.compile(rf"(?:\|\||\?\?|\bor\b|unwrap_or(?:_else)?\(|getOrDefault\(|getenv\([^()]*,|get\([^()]*,|getProperty\([^()]*,|:-)\s*(?:\|_?\|\s*)?(?P<v>{_LITERAL})")
_WRAP = re.compile(r"(?:concat!\s*\(|String::from\(|str\(|new\s+String\(|b(?=[\"'])|f(?=[\"'])|Buffer\.from\(|atob\(|base64\.b64decode\(|\[\]byte\(|&|@|\(|\[|\{)+\s*")
_BARE = re.compile(r"[^\s\"'`,;)}\]<>]+")
_SCHEME = re.compile(r"^(?:Bearer|Basic|Token|ApiKey|Digest|JWT)\s+", re.I)
_USERINFO = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://(?P<user>[^\s/:@\"'`<>]*):(?P<v>[^\s/@\"'`<>]+)@(?P<host>[\w.\[\]{}$%-]+)", re.I)
_FIELD = re.compile(r"(?:^|[;?&\s\"'])(?:password|passwd|pwd|accountkey|sharedaccesskey|secret|client_secret|access_token|api_key|apikey|token|sig)=(?P<v>[^;&\s\"'`<>]+)", re.I)
_HEADER = re.compile(r"\b(?P<k>Bearer|Basic)\s+(?P<v>[A-Za-z0-9+/_.~=-]{12,})")
_OPTION = re.compile(r"(?:(?<![\w-])--?(?:password|passwd|pwd|token|secret|api-?key|access-?token|auth-?token)(?:\s+|=)|(?:\s-u|--user)\s+[\w.-]+:)(?P<q>[\"']?)(?P<v>[^\s\"'`]+)(?P=q)", re.I)
_PEM = re.compile(r"-----BEGIN (?P<k>[A-Z0-9 ]*)PRIVATE KEY(?: BLOCK)?-----(?P<v>.*?)(?:-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|\Z)", re.S)
#: Prefixes that vendors give their tokens; fixed public formats.
_VENDOR = re.compile(
    r"(?<![A-Za-z0-9_-])(?P<v>(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,255}|github_pat_[A-Za-z0-9_]{22,255}|glpat-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|[srp]k_live_[A-Za-z0-9]{10,}"
    r"|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|pypi-[A-Za-z0-9_-]{16,}|hf_[A-Za-z0-9]{30,}|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{32,}|dop_v1_[a-f0-9]{64})(?![A-Za-z0-9_-])"
)
#: Tokens of unknown vendors: a short prefix, perhaps an id, and a long random end in both cases.
_TOKENISH = re.compile(r"(?<![\w-])(?P<v>(?!sha\d|md5|ssh|rsa|data|img|uuid|rev|v\d)[a-z]{2,8}[-_](?:[0-9a-z]{2,16}[-_]){0,3}(?=[A-Za-z0-9]*[a-z])(?=[A-Za-z0-9]*[A-Z])(?=[A-Za-z0-9]*\d)[A-Za-z0-9]{16,})(?![\w-])")
_JOINED = re.compile(rf"{_LITERAL}(?:\s*[+,]\s*{_LITERAL})+")
_STEM = re.compile(r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|[srp]k_live_|AIza|npm_|SG\.|eyJ|hf_)")
_PLACEHOLDER = re.compile(
    r"(?i)^(?:[x*.#_?0•-]{3,}|(?:x{2,}[-_ ]?)+|.*(?:your|my|the|some|any|insert|enter|put|add|change|replace)[-_ ]?(?:own|this|me|it|here|key|token|secret|pass(?:word)?|api|value).*|.*[-_ ]here$|insert[-_].*|<.*>?|\[.*\]?|\(.*\)|.*\*{3,}.*|.*\.\.\.$"
    r"|.*(?:redacted|removed|hidden|masked|omitted|censored|placeholder|changeme|change_me|replaceme|dummy|example|sample|not[-_ ]?(?:a[-_ ]?)?real|fixme|todo|tbd|lorem|foobar|deadbeef).*"
    r"|(?:none|null|nil|undefined|true|false|empty|unset|default|test|testing|demo|fake|mock|user|username|login|root|admin|guest|secret|secrets|password|passwd|passphrase|pass|pwd|token|key|apikey|api[-_]?key|credential|credentials|string|str|value|bearer|basic|hunter2|qwerty|letmein|1234\d*|abc123|foo|bar|baz)\d{0,3})$"
)
_REFERENCE = re.compile(
    r"(?i)^(?:[$%@#!&]?[{(\[<]+.*|\$\w+$|%\w+%$|.*\$\{[^}]*\}.*|.*\{\{.*\}\}.*|.*\$\([^)]*\).*|.*<[^>]+>.*|(?:env|vault|secret|secretref|ssm|sm|kms|aws|gcp|azure|keyvault|op|file|ref|config|conf|arn|projects|parameter|keychain|doppler|sops|k8s|secretsmanager)[:/].*|(?:process\.env|os\.environ|os\.getenv|System\.getenv|env::var|getenv|ENV)\b.*|__\w+__$|@@\w+@@$|#\{.*)"
)
_SEALED = re.compile(r"(?i)^(?:enc(?:rypted)?[\[(:{].*|\{(?:cipher|bcrypt|noop|ssha|sha\d*|pbkdf2|scrypt|argon2)[^}]*\}.*|\$(?:2[abxy]?|5|6|1|argon2\w*|pbkdf2[\w-]*|scrypt|y)\$.*|pbkdf2[_:$].*|(?:sha\d+|md5|hmac)[-:$].*|aqic[a-z0-9].*|vault:v\d.*|age1.*|-----BEGIN (?:AGE|PGP).*|gAAAAA.*|U2FsdGVkX1.*|ssh-(?:rsa|ed25519|dss).*|ecdsa-sha2.*|ssh-.*|data:.*|AgA[A-Za-z0-9+/]{60,}.*)")
_WORDS = re.compile(r"^(?:[A-Za-z]+|\d+)(?:[ _./:,-]+(?:[A-Za-z]+|\d+))*[.!?:;]*$")


def chars_per_subword(values: list[str], path: str = DEFAULT_FILE) -> list[float]:
    return [len(v) / max(1, len(i)) for v, i in zip(values, encode_texts(values, path))]


def _classes(v: str) -> tuple[bool, bool, bool, bool]:
    return any(c.islower() for c in v), any(c.isupper() for c in v), any(c.isdigit() for c in v), any(not c.isalnum() for c in v)


def _excluded(v: str) -> bool:
    return len(v) < MIN_LENGTH or len(set(v)) < 4 or bool(_PLACEHOLDER.match(v) or _REFERENCE.match(v) or _SEALED.match(v)) or "://" in v[:12]


Test = Callable[[float], bool]


def secret_test(v: str, password: bool) -> tuple[str, Test] | None:
    """The string to score and the test of its characters a subword, for a value in a secret's place; None where no score
    could make it one. ``password``: made-up words with digits count, too."""
    v = _SCHEME.sub("", v.strip())
    if _excluded(v) or re.search(r"\s", v):
        return None
    low, up, digit, sign = _classes(v)
    kinds = low + up + digit + sign
    if re.fullmatch(r"[A-Za-z0-9+/_-]{8,}={1,2}", v):  # base64: what it holds decides, if that is text
        try:
            inner = base64.b64decode(v.replace("-", "+").replace("_", "/"), validate=True).decode("ascii")
            if inner.isprintable() and (_PLACEHOLDER.match(inner) or _REFERENCE.match(inner)):
                return None
        except ValueError:
            pass
    words = bool(_WORDS.match(v))
    if words and re.search(r"[ _./:,-]", v):  # a path or a compound of words and numbers
        return None

    def test(ratio: float) -> bool:
        if ratio > READABLE:
            return False
        if ratio <= UNNATURAL and len(v) >= 8 and (kinds >= 2 or digit):
            return not (re.fullmatch(r"[\d.,:+-]+", v) or re.fullmatch(r"\W+", v))
        if words and not password:
            return kinds >= 3 and ratio <= SOME_UNNATURAL and len(v) >= 12 and not re.search(r"[/ ]", v)
        if re.search(r"[{}()\[\]<>|\\ ]", v) and ratio > UNNATURAL:
            return False
        if digit and (low or up) and "/" not in v:
            if sign and re.search(r"[^\w./:-]", v):  # a sign that names and paths do not have
                return sum(c.isalpha() for c in v) >= 3 and len(v) >= 8
            if password and not re.fullmatch(r"[A-Za-z]+(?:[-_.:][A-Za-z]+)*[-_.:]v?\d+(?:\.\d+)*", v):
                return kinds >= 3 or ratio <= SOME_UNNATURAL or bool(re.fullmatch(r"[A-Za-z]+\d{2,}", v))
            return ratio <= SOME_UNNATURAL and kinds >= 3
        return False

    return v, test


def is_secret(v: str, password: bool, path: str = DEFAULT_FILE) -> bool:
    """Whether a value in a secret's place is one."""
    got = secret_test(v, password)
    return got is not None and got[1](chars_per_subword([got[0]], path)[0])


def _literal_spans(text: str, at: int) -> list[tuple[int, int]]:
    """Inner spans of the literals in ``text``, moved by ``at``."""
    out = []
    for m in _ANY_LITERAL.finditer(text):
        raw = len(re.match(r"(?:r#*)?", m.group()).group())
        quote = 3 if m.group()[raw : raw + 3] in ('"""', "'''") else 1
        out.append((at + m.start() + raw + quote, at + m.end() - quote))
    return out


def candidates(code: str) -> list[tuple[str, Test, list[tuple[int, int]]]]:
    """What may be a secret by its context: the string to score, the test of its score, and its character spans; a secret
    written in several pieces has several."""
    found: list[tuple[str, Test, list[tuple[int, int]]]] = []
    value = lambda spans: "".join(code[a:b] for a, b in spans)
    at_most = lambda bound: lambda ratio: ratio <= bound

    def put(v: str, password: bool, spans: list[tuple[int, int]], bound: float = READABLE) -> None:
        if got := secret_test(v, password):
            found.append((got[0], lambda ratio, test=got[1]: ratio <= bound and test(ratio), spans))

    for m in _PEM.finditer(code):
        body = re.sub(r"\\[nr]|[\s\"'`+,#/*]|//", "", m.group("v"))
        if "ENCRYPTED" in m.group("k") or "ENCRYPTED" in m.group("v"):
            continue
        run = max(re.findall(r"[A-Za-z0-9+/=]+", body), key=len, default="")
        if len(run) >= 32 and len(set(run)) > 12:
            a = m.start("v")
            found.append((run, at_most(UNNATURAL), [(a + x.start(), a + x.end()) for x in re.finditer(r"(?<!\\)[A-Za-z0-9+/=]{4,}|(?<=\\n)[A-Za-z0-9+/=]{4,}", m.group("v"))]))
    for m in _VENDOR.finditer(code):
        rest = _STEM.sub("", m.group("v"))
        if not _PLACEHOLDER.match(rest) and len(set(rest)) >= 6:
            found.append((rest, at_most(SOME_UNNATURAL), [m.span("v")]))
    for m in _TOKENISH.finditer(code):
        if not _PLACEHOLDER.match(m.group("v")):
            found.append((re.split(r"[-_]", m.group("v"))[-1], at_most(UNNATURAL), [m.span("v")]))
    for m in _JOINED.finditer(code):
        if "," in _ANY_LITERAL.sub("", m.group()) and not re.search(r"concat!?\s*\(\s*$", code[max(0, m.start() - 12) : m.start()]):
            continue
        spans = _literal_spans(m.group(), m.start())
        v = value(spans)
        if (_VENDOR.fullmatch(v) or _TOKENISH.fullmatch(v)) and not _PLACEHOLDER.match(v):
            found.append((re.split(r"[-_]", v)[-1], at_most(SOME_UNNATURAL), [x for x in spans if x[1] > x[0]]))
    for m in _USERINFO.finditer(code):
        v = m.group("v")
        if not (_PLACEHOLDER.match(v) or _REFERENCE.match(v) or _SEALED.match(v)) and len(v) >= 4 and v.lower() != m.group("user").lower():
            low, up, digit, sign = _classes(v)
            found.append((v, at_most(READABLE if digit or (sign and low) else UNNATURAL), [m.span("v")]))
    for pattern, password in ((_FIELD, True), (_HEADER, False), (_OPTION, True)):
        for m in pattern.finditer(code):
            put(m.group("v"), password, [m.span("v")])
    at = 0
    while m := _KEYED.search(code, at):
        at = m.end("op")
        name, rest, start = m.group("name") + m.group("tail"), m.group("rest"), m.start("rest")
        plain = re.sub(r"[_.-]?(?:b64|base64|value|str|string|default|raw|plain|old|new)$", "", name, flags=re.I)
        if _ABOUT.search(plain) or re.search(r"(?i)public|publish", plain):
            continue
        tail = m.group("tail")
        if tail and not re.fullmatch(r"[A-Z_0-9-][A-Za-z0-9_-]*", tail):  # "passing", "tokenize", "keyed"
            continue
        password = bool(re.search(r"(?i)pass|pwd|secret|cred|key|token|auth", plain))
        op = m.group("op")
        spans: list[tuple[int, int]] = []
        f = _FALLBACK.search(rest)
        wrapped = _WRAP.match(code, start)  # a bracket may open on this line and the literals stand on the next ones
        head = wrapped.end() - start if wrapped else 0
        pieces = _PIECES.match(code, start + head)
        if f:
            spans = _literal_spans(f.group("v"), start + f.start("v"))
        elif pieces:
            text = pieces.group()
            parts = _literal_spans(text, start + head)
            between = _ANY_LITERAL.sub("", text)
            one = len(parts) == 1 or "concat!" in code[start : start + head] or re.search(r"[+.]", between) and "," not in between
            spans = parts if one or "(" in code[start : start + head] and not between.strip() else parts[:1]
        elif op in ("=", ":", "is", "to", ">", ":=", " "):
            b = _BARE.match(rest, _SCHEME.match(rest).end() if _SCHEME.match(rest) else 0)
            if b and (op != ":" or rest[:1] != " " or not re.match(r"\w+\s*[=,){]|(?:the|a|an)\b", rest)):
                word = b.group().rstrip(".")
                after = rest[b.end() : b.end() + 1]
                if after != "(" and "(" not in word and not re.fullmatch(r"[A-Za-z_]\w*(?:\.\w+)*", word):
                    spans = [(start + b.start(), start + b.start() + len(word))]
                elif re.fullmatch(r"[A-Za-z0-9_]{12,}", word) and after != "(":
                    spans = [(start + b.start(), start + b.start() + len(word))]
        if not spans:
            continue
        v = value(spans)
        sch = _SCHEME.match(v)
        if sch and len(spans) == 1:
            spans = [(spans[0][0] + sch.end(), spans[0][1])]
        put(v, password and op not in ("to", ">", ",", " "), [s for s in spans if s[1] > s[0]], UNNATURAL if op in (" ", "to") else READABLE)
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_all(texts: list[str], path: str = DEFAULT_FILE) -> list[list[tuple[int, int]]]:
    """Character spans of the secrets in every text, in order; all candidates are scored in one call."""
    found = [candidates(t) for t in texts]
    values = list(dict.fromkeys(v for c in found for v, _, _ in c))
    score = dict(zip(values, chars_per_subword(values, path)))
    return [merged([s for v, test, spans in c if test(score[v]) for s in spans]) for c in found]


def find_secrets(code: str, path: str = DEFAULT_FILE) -> list[tuple[int, int]]:
    """Character spans of the secrets in a text, in order."""
    return find_all([code], path)[0]


def mask(code: str, spans: list[tuple[int, int]]) -> str:
    """The text with the spans masked; each keeps its length in bytes, so that byte offsets hold, too."""
    out, at = [], 0
    for a, b in spans:
        out += [code[at:a], "X" * len(code[a:b].encode("utf-8", "replace"))]
        at = b
    return "".join([*out, code[at:]])


def secret_records(chunks: DataFrame, symbols: DataFrame, redacted: bool = False, path: str = DEFAULT_FILE) -> DataFrame:
    """record_table and record_id of every row of either table whose ``code`` holds a secret; if asked for, also the
    masked ``code``.

    Rows with null id or code give none; copies of a row give one; rows of one id with other code are judged each on
    its own; empty tables give no rows. Whole texts are searched.
    """
    schema = "record_table string, record_id string" + (", code string" if redacted else "")

    def run(batches):
        for batch in batches:
            keep, masked = [], []
            texts = strings(batch.column(2))
            for i, (code, spans) in enumerate(zip(texts, find_all(texts, path))):
                if spans:
                    keep.append(i)
                    if redacted:
                        masked.append(mask(code, spans))
            rows = pa.array(keep, pa.int64())
            arrays = [batch.column(0).take(rows), batch.column(1).take(rows)] + ([pa.array(masked, pa.string())] if redacted else [])
            yield pa.RecordBatch.from_arrays(arrays, ["record_table", "record_id", "code"][: len(arrays)])

    both = None
    for name, df in (("chunks", chunks), ("symbols", symbols)):
        rows = spread(df.select("id", "code"), "id").where(F.col("id").isNotNull() & F.col("code").rlike(TRIGGER))
        rows = rows.select(F.lit(name).alias("record_table"), F.col("id").alias("record_id"), "code")
        both = rows if both is None else both.unionByName(rows)
    return both.mapInArrow(run, schema).distinct()
