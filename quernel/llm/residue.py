"""Problem 10: template residue, filler and error-page text in documents.

Only prose counts: fenced and inline code, quotations, log lines and task lists are cut out first, so that a document
which discusses or shows such things is not taken for one. Then

* records of one template are aligned to induce its slots. A place of a line is a slot when the corpus has the line with
  more than ``FILLINGS`` fillings at its marked places (whole lines, their ends included), or the two words on either side
  with as many, of one word or several. A slot that still holds a variable's name or a blank is residue, and so is every
  marked place whose name the corpus shows in unmistakable slots (``{{ name }}``, ``[[NAME]]``, ``<INSERT NAME HERE>``...)
  of ``NAMES`` texts. An unmistakable form counts as it stands where the corpus is too small to align it;
* whole pages, numbers and ids masked, that ``REPEATS`` different texts share are error templates when they speak of
  errors, access or scripts; single notices are known by their sentences, filler by its low diversity of words or letters.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.tokens import strings
from quernel.session import spread, stage

FILLINGS = 3  # other fillings that make a place a slot
NAMES = 2  # different texts that must show a name in an unmistakable slot
REPEATS = 3
PAIRS = (2.52, 0.657, 65)  # a line of n >= 65 letter pairs with fewer than 2.52 * n ** 0.657 different ones is filler; prose has more
HELD = 200_000  # contexts or words that a task holds at a time
BLOCK = 40  # words that are looked at together
SLOTS = 1 << 18  # a power of two; fixed, whatever the corpus

_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)", re.M | re.S)
_TICKS = re.compile(r"(`+)(?!`)[^`\n]+?\1")
_QUOTED = re.compile(r'"[^"\n]+"|“[^”\n]+”|„[^“”\n]+[“”]|«[^»\n]+»|「[^」\n]+」|『[^』\n]+』|‘[^’\n]+’(?!\w)')
_LOG = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\d\d:\d\d:\d\d\b|\[?(?:DEBUG|INFO|WARN|TRACE)\b)")
_TASK = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+\[[ xX]\]")

_NAME = r"[A-Za-z][A-Za-z0-9]*(?:[ _.-][A-Za-z0-9]+)*"
#: Slots that no prose has. One level of nesting is covered by the outer form alone.
_SURE = re.compile(
    rf"\{{\{{[-~#/^&>]?\s*(?P<a>{_NAME})[^{{}}\n]*\}}\}}|\{{\{{[^\n]+?\}}\}}|\[\[(?P<b>[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\]\]|<%[=-]?\s*(?P<c>[\w. $\{{}}-]+?)\s*%>"
    rf"|\{{%-?\s*(?:include|block|if|for|extends|set|url)\s+(?P<d>[^%\n]+?)\s*-?%\}}|\$\{{(?P<e>{_NAME})\}}|#\{{(?P<f>{_NAME})\}}|@@(?P<g>[A-Z][A-Z0-9_]*)@@"
    rf"|%\((?P<h>\w+)\)[sdrf]|<(?:INSERT|ENTER|ADD|YOUR|TODO|REPLACE)[ _-](?P<i>[^<>\n]+)>|\[(?:TODO|TBD|FIXME):\s*(?P<j>[^\]\n]+)\]"
    rf"|\[(?:Your|Insert|Enter|Add|Replace|Put)\s+(?P<k>[^\]\n]+?)(?:\s+here)?\](?!\()|(?<![\w%])%(?P<l>[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)%(?![\w%])|(?<!\w)__(?P<m>[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*)__(?!\w)"
)
_DOUBTFUL = re.compile(
    r"<(?P<a>[A-Za-z]+(?:[-_ ][A-Za-z]+)+)>|(?<![$#{\w])\{(?P<b>[A-Za-z]+(?:[_.-][A-Za-z]+)*)\}(?!\})|(?<![\w$])\$(?P<c>[A-Za-z]+(?:[_-][A-Za-z]+)+)\$?(?!\w)"
    r"|(?<![\w\[])\[(?P<d>[A-Za-z]+(?:[_ -][A-Za-z]+)+)\](?![(\[:\w])|(?<!\w)(?P<e>[A-Z]+(?:_[A-Z]+)+)(?!\w)|(?<![\w%])%(?P<f>[a-z]+(?:_[a-z]+)*)%(?![\w%])|(?<!\w):(?P<g>[a-z]+_[a-z]+):(?!\w)|(?<!\w)(?P<h>_{4,}|X{4,})(?!\w)"
)

_SCRIPTS = r"(?:java ?script|ecmascript|client-side (?:scripts?|code)|scripts?|scripting|js|cookies?)"
_PAGE = r"(?:page|site|website|app|application|viewer|document|documentation|content|file|resource|revision|repository(?: browser)?|browser|view|service|portal|url|link|address)"
_STATUS = (
    r"(?:bad request|unauthorized|payment required|forbidden|(?:page |file )?not found|method not allowed|request time-?out|conflict|gone|too many requests|"
    r"internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)"
)
#: Whole sentences of filler, error pages and notices; fixed wordings in several languages. Each is matched from the
#: beginning of a line (after list and heading marks), so that a sentence about them does not count.
_LINES = re.compile(
    "^(?:"
    # status lines, error objects and traces that stand in the place of a page
    rf"(?:http/\d(?:\.\d)?\s+)?(?:error:?\s+)?[45]\d\d\b[\s:,.–—-]*{_STATUS}[.!]?$|{_STATUS}[.!]?$|(?:http )?(?:error|fehler|erreur|errore|erro|エラー|错误|錯誤)(?: code)?[\s:#]*[45]\d\d\b.*"
    r"|\{\s*\"?(?:error|status|message|code|errors)\"?\s*:.*|<error>\s*<code>.*|<\?xml[^>]*>\s*<error>.*"
    r"|upstream (?:connect error|request timeout).*|(?:fatal error|unhandled exception|request failed|uncaught (?:exception|error))\b.*|warning: .*\((?:code|errno|error) ?\d+\).*"
    # missing pages, access, limits, maintenance
    rf"|we (?:could not|couldn.t|cannot|can.t|were unable to) (?:find|locate|display|load|open|show) (?:the|a|an|this|that|your|any) (?:requested )?{_PAGE}\b.*|(?:sorry|oops|uh[- ]oh|whoops)\b.*|something went wrong\b.*|(?:the|this|that|your) (?:requested |{_PAGE} )*{_PAGE} (?:you (?:were|are) looking for |you requested )?(?:(?:was|is|has been|could|can|does|did|no|doesn.t|isn.t|can.t|cannot|may have|is temporarily|is currently)\b).*(?:exist|found|available|unavailable|reached|unreachable|moved|removed|deleted|maintenance|rendered?|displayed|loaded|forbidden|offline|expired|denied|blocked|supported).*"
    rf"|the server (?:could not|cannot|can.t|was unable to|encountered|is (?:temporarily|currently|too)).*|(?:page|file|url|access|permission) (?:not found|denied|forbidden|refused)[.!:]?.{{0,80}}$|access to this {_PAGE} (?:is|was|has been) .*"
    r"|you (?:don.t|do not) have (?:permission|access|the rights)\b.*|you are not (?:authorized|allowed|permitted)\b.*|your session (?:has )?(?:expired|timed out|ended)\b.*|rate limit (?:exceeded|reached)\b.*|too many requests\b.*"
    rf"|(?:this|the|our) {_PAGE} (?:is|will be) (?:down|offline|undergoing|under|unavailable|closed)\b.*maintenance.*|(?:we are|we.re|we will be|we.ll be) (?:down|offline|performing|undergoing|back)\b.*|(?:scheduled |planned )?maintenance (?:in progress|mode|window)\b.*"
    r"|please (?:log|sign) in to (?:continue|view|see|access)\b.*"
    # scripts, cookies, browsers
    rf"|noscript:.*|(?:please |kindly |you(?:.ll| will)? (?:need|have|must|should) (?:to )?|to (?:continue|use|view|see|open)[^.]{{0,60}},? )?(?:please |kindly )?(?:enable|activate|allow|turn on|switch on) (?:{_SCRIPTS})\b.*|(?:please )?(?:turn|switch) (?:{_SCRIPTS}) on\b.*"
    rf"|(?:{_SCRIPTS})(?: and {_SCRIPTS})? (?:is|are|was|were|seems?|must|needs?|has|have|appears?)\b.*(?:off|disabled|blocked|detected|required|enabled|allowed|needed|supported).*"
    rf"|(?:this|the|our|your) (?:{_PAGE} )*{_PAGE} (?:requires?|needs?|uses?|relies on|depends on|works? (?:best )?with|only works with|only runs? with|runs? with|does not (?:work|run|load) (?:without|unless)|doesn.t (?:work|run|load) (?:without|unless)|(?:can.t|cannot|can not) be (?:shown|displayed|viewed|loaded|opened|used) (?:unless|without))\b.*{_SCRIPTS}\b.*"
    r"|your browser (?:is|does|doesn.t|has|isn.t|appears|seems|version)\b.*|(?:please )?(?:update|upgrade|switch|change) (?:to )?(?:your|a|another|an?) (?:\w+ )?browser\b.*|(?:please )?use (?:another|a different|a (?:more )?(?:modern|recent|newer)) browser\b.*"
    rf"|checking your browser\b.*|verify(?:ing)? (?:that )?you are (?:a )?human\b.*|(?:are you|confirm you are) (?:a )?(?:human|robot)\b.*|loading\W+.*{_SCRIPTS}.*|without {_SCRIPTS},? .*"
    # defaults and filler
    rf"|lorem ipsum\b.*|(?:todo|tbd|fixme|xxx)\W*(?:(?:write|add|fill|insert|describe|complete|document|put)\b.*|$)|(?:your|the|add|insert|enter|put|some) .{{0,40}}(?:goes|go|comes|come|belongs) here\b.*|(?:insert|enter|add|put|type|write) (?:your|the|some|a) .{{0,40}}\bhere\W*$"
    rf"|(?:this|the) (?:{_PAGE}|section|text|paragraph|article) (?:is|was|has been) (?:(?:just|only|currently|still) )?(?:an? )?(?:placeholder|empty|stub|blank|intentionally|auto-?generated|under construction|being written|work in progress)\b.*|placeholder (?:text|content|page|for)\b.{{0,80}}$"
    r"|coming soon\b.*|under construction\b.*|content (?:will (?:go|be added|follow)|coming|to be added|goes)\b.*|(?:sample|dummy|example|filler|default) (?:text|content|page|description)\W*$|(?:page|document|project|article) title\W*$|(?:description|text|content|summary) (?:to come|pending|missing)\W*$|type something\W*$"
    # German
    r"|bitte (?:aktivieren|schalten|erlauben|verwenden|nutzen|melden) sie\b.*(?:script|cookies|browser|an\b).*|(?:diese|die) (?:angeforderte |gesuchte )?(?:seite|anwendung|datei|website)\b.*(?:nicht (?:gefunden|verfügbar|angezeigt|erreichbar|unterstützt)|javascript|wartung|existiert nicht|in arbeit|platzhalter).*|(?:ihr|dein) browser\b.*|(?:zugriff|zugang) (?:verweigert|nicht)\b.*|(?:interner )?serverfehler\b.*|(?:wegen )?wartungsarbeiten\b.*|ihre sitzung\b.*|seite nicht gefunden\b.*|javascript ist\b.*"
    r"|hier (?:steht|kommt|folgt|entsteht)\b.*(?:text|inhalt|seite|beschreibung)\b.*|platzhalter\b.*|blindtext\b.*|.*\bbitte ersetzen\W*$"
    # French
    r"|(?:veuillez|merci d.)\s*(?:activer|autoriser|mettre à jour|vous connecter|utiliser)\b.*|(?:cette|la) page\b.*(?:introuvable|n.existe|javascript|maintenance|indisponible|construction).*|accès (?:refusé|interdit)\b.*|page (?:non trouvée|introuvable)\b.*|(?:site|service) (?:en maintenance|indisponible|temporairement)\b.*|(?:le|ce) (?:site|service)\b.*(?:maintenance|indisponible|javascript).*|votre (?:navigateur|session)\b.*|javascript (?:est|doit)\b.*|erreur (?:interne|du serveur|serveur)\b.*|(?:texte|contenu) (?:à venir|de remplissage|provisoire|ici)\b.*|votre (?:texte|description|titre) ici\b.*|page en construction\b.*"
    # Spanish
    r"|(?:por favor,? )?(?:active|activa|habilite|habilita|permita)\b.*(?:javascript|cookies|scripts?).*|(?:esta|la) página\b.*(?:no (?:existe|se encuentra|está disponible)|javascript|mantenimiento|construcción).*|acceso denegado\b.*|página no encontrada\b.*|(?:sitio|servicio) (?:en mantenimiento|no disponible)\b.*|(?:el|este) (?:sitio|servicio|servidor)\b.*(?:mantenimiento|no (?:está )?disponible|javascript).*|su (?:navegador|sesión)\b.*|error (?:interno|del servidor)\b.*|(?:texto|contenido) (?:de relleno|provisional|aquí)\b.*|(?:su|tu) (?:texto|descripción|título) aquí\b.*|próximamente\b.*"
    # Chinese and Japanese
    r"|.*(?:请|請).*(?:启用|啟用|开启|允许|打开).*(?:javascript|脚本|cookie).*|.*(?:服务器|伺服器|服务).*(?:不可用|错误|出错|繁忙).*|.*(?:页面|頁面|网页).*(?:不存在|未找到|找不到|无法|維護|维护|建设中).*|.*(?:访问|存取)(?:被拒绝|受限).*|.*浏览器.*(?:不支持|不受支持|更新|升级).*|.*(?:系统|网站|站点).*(?:维护|升级)中.*|.*(?:此处|这里)(?:填写|输入|插入|为占位).*|占位(?:符|文本).*|(?:内容)?敬请期待.*"
    r"|.*javascript ?(?:を|が).*(?:有効|必要|無効|オン|オフ).*|.*(?:スクリプト|クッキー).*(?:を|が).*(?:有効|必要|無効|許可).*|.*(?:ページ|ファイル|url)(?:は|が|を).*(?:見つかりません|存在しません|表示できません|準備中|工事中|移動).*|.*アクセス(?:が|は|を)?(?:拒否|禁止|できません).*|.*(?:サーバー|サーバ|システム).*(?:エラー|メンテナンス|利用できません|混み合).*|.*メンテナンス中.*|.*ブラウザ.*(?:対応し|サポート|更新).*|ここに.*(?:入力|記入|書いて|説明|本文).*|(?:ダミー|仮の|サンプル)(?:テキスト|文章|の文).*|近日(?:公開|公開予定).*|準備中.*"
    ")",
    re.I,
)
#: Words one of which a repeated page must have to be an error template. Fixed values.
_WEAK = set("javascript ecmascript script scripts scripting js cookie cookies browser navigateur navegador error errors fehler erreur denied forbidden unavailable unreachable expired maintenance wartung placeholder platzhalter traceback exception refused timeout timed".split())
_WEAK_SIGNS = "エラー 错误 维护 浏览器 ブラウザ スクリプト".split()
_TRACE = re.compile(r"^traceback \(most recent call last\):", re.I)
_MARK = re.compile(r"^\s*(?:[-*+•]\s+|#{1,6}\s+|\d+[.)]\s+|(?:Expected|Actual|Q|A|Note|Added|Fixed|Changed|Removed):\s+)*")
_LATIN = re.compile(r"[a-z]+")
_ROWS = set("asdfghjkl;'qwertyuiop")
_CHROME = re.compile(r"^(?:skip to (?:main )?content|.*\|.*\||request id:.*|.* - .* - .*|retry-after:.*|content-type:.*|ray id:.*|\(c\).*|©.*|[-=_*]{3,})$", re.I)


#: First words of the sentences above; a line of plain letters that begins otherwise is none of them. Fixed values.
_FIRST = set(
    (
        "http error bad unauthorized payment forbidden page file not method request conflict gone too internal service gateway fehler erreur errore erro upstream fatal unhandled uncaught warning "
        "we sorry oops uh whoops something the this that your url access permission you rate our scheduled planned maintenance please noscript kindly to enable activate allow turn switch "
        "java javascript ecmascript client script scripts scripting js cookie cookies update upgrade change use checking verify verifying are confirm loading without lorem todo tbd fixme xxx "
        "add insert enter put some type write placeholder coming under content sample dummy example filler default document project article description text summary "
        "bitte diese die ihr dein zugriff zugang interner serverfehler wegen wartungsarbeiten seite hier platzhalter blindtext veuillez merci cette la site le ce votre texte contenu "
        "por active activa habilite habilita permita esta acceso sitio servicio el este su tu texto contenido"
    ).split()
)
_SIGNS, _DIGITS = ".,;:!?()\"'“”*", re.compile(r"\d+")
_WORD1 = re.compile(r"[a-z]+", re.I)
_MARKED = re.compile(r"[{}<>%$@]|#\{|\[|__|XXXX|[A-Z]_[A-Z]|:[a-z]+_")


def prose_lines(text: str) -> list[str]:
    """Lines of prose, stripped; code, quotations, citations, logs and task lists are cut out."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    out = []
    for line in text.split("\n"):
        bare = line.strip()
        if not bare or bare[0] == ">" or line[:4] == "    " or line[:1] == "\t":
            continue
        if bare[0] in "[-*+DIWT0123456789" and (_LOG.match(line) or _TASK.match(line)):
            continue
        if bare[0] not in "{<":
            bare = _QUOTED.sub("“”", _TICKS.sub("``", bare) if "`" in bare else bare).strip()
        out.append(bare)
    return out


def _slot_name(m: re.Match) -> str:
    raw = next((g for g in m.groupdict().values() if g), "")
    words = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", raw)
    return "_".join(w.lower() for w in words if w.lower() not in ("here", "your", "the", "include", "insert"))


class _Plain(dict):
    """Words as contexts hold them: in lower case, without signs at their ends and with numbers masked; remembered."""

    def __missing__(self, w: str) -> str:
        if len(self) > HELD:
            self.clear()
        got = self[w] = _DIGITS.sub("9", w.lower()).strip(_SIGNS)
        return got


_PLAIN = _Plain()


def _plain(words: list[str]) -> list[str]:
    return [_PLAIN[w] for w in words]


def _context(line: str, start: int, end: int) -> tuple[str, str]:
    """The two words on either side of a place, ``^`` and ``$`` beyond the line's ends."""
    left = ["^", "^", *_plain(line[:start].split())[-2:]][-2:]
    right = [*_plain(line[end:].split())[:2], "$", "$"][:2]
    return f"{left[0]} {left[1]}", f"{right[0]} {right[1]}"


def mask(line: str) -> str:
    """A line without what changes from page to page: numbers and long hexadecimal ids."""
    return re.sub(r"\d+", "9", re.sub(r"\b(?=[0-9a-f]*\d)[0-9a-f]{8,}\b", "#", line.lower()))


def is_filler(line: str) -> bool:
    """Whether a line fills space: a few words over and over, or low diversity of letter pairs over different words, as
    made-up Latin and keys struck at random have it."""
    w = _LATIN.findall(line.lower())
    if len(w) >= 2 and w[0] == "lorem" and w[1] == "ipsum":
        return True
    if len(w) < 6 and len(line) < 30:
        return False
    if len(w) >= 6 and len(kinds := set(w)) <= 3 and not _DIGITS.search(line):
        period = next(k for k in (1, 2, 3, len(w)) if k == len(w) or w == (w[:k] * len(w))[: len(w)])
        return period < len(w)
    factor, power, least = PAIRS
    if len(line) > least and line.isascii():
        low = blocks = 0
        for at in range(0, len(w), BLOCK):
            words = set(w[at : at + BLOCK])
            joined = " ".join(words)
            n = len(joined) - 2 * len(words) + 1
            pairs = len(set(zip(joined, joined[1:]))) - len({x[0] for x in words}) - len({x[-1] for x in words})
            if pairs < factor * max(n, 0) ** power:  # a word counts each of its own pairs once
                n = sum(len(set(zip(x, x[1:]))) for x in words)
            if n >= least:
                blocks += 1
                low += pairs < factor * n**power
                if low < blocks:
                    break
        if blocks and low == blocks and sum(map(len, w)) > 0.7 * (len(line) - line.count(" ")):
            return True
    if len(line) < 30 or not line.isascii() or line != line.lower():
        return False
    keys = [c for c in line if not c.isspace()]
    if len(keys) >= 30 and set(keys) <= _ROWS and len(set(keys)) >= 5:
        return keys.count(";") >= 2 or sum(c in "aeiou" for c in keys) < 0.25 * len(keys)
    return False


def is_notice(line: str) -> bool:
    """Whether a line is the sentence of an error page, a notice or a filler."""
    first = _WORD1.match(line)
    if line.isascii() and (first.group().lower() not in _FIRST if first else line[:1] not in "45{<"):
        if not line.lower().rstrip("!. ").endswith("bitte ersetzen"):
            return False
    return bool(_LINES.match(line))


def judge(text: str) -> tuple[list[str], bool, list[dict], str | None]:
    """(prose lines, whether a notice or filler stands in them, marked places, the whole page masked).

    A place has its name, whether its form is unmistakable, its filling, the line with its marked places cut out and the
    words of ``_context``. The page is None where nothing in it speaks of errors, access or scripts.
    """
    lines = prose_lines(text)
    places, certain = [], False
    for line in lines:
        if _MARKED.search(line):
            sure = [(m.start(), m.end(), _slot_name(m), True) for m in _SURE.finditer(line)]
            rest = _SURE.sub(lambda m: " " * len(m.group()), line) if sure else line
            found = sorted(sure + [(m.start(), m.end(), _slot_name(m), False) for m in _DOUBTFUL.finditer(rest)])
            if found:
                at, frame = 0, []
                for a, b, _, _ in found:
                    frame.append(line[at:a])
                    at = b
                frame = "□".join(_plain([*frame, line[at:]]))
                for a, b, name, is_sure in found:
                    left, right = _context(line, a, b)
                    places.append({"name": name, "sure": is_sure, "filling": line[a:b], "frame": frame, "left": left, "right": right})
        bare = _MARK.sub("", line, count=1)
        certain = certain or is_notice(bare) or is_filler(bare)
    body = [x for x in lines if not _CHROME.match(x)]
    low, page = "\n".join(body).lower(), None
    if body:
        if len(body) < len(lines) and any(_TRACE.match(x) for x in body):
            certain = True  # a trace between the parts of a page
        if not _WEAK.isdisjoint(_LATIN.findall(low)) or not low.isascii() and any(x in low for x in _WEAK_SIGNS):
            page = hashlib.md5("\n".join(map(mask, body)).encode("utf-8", "replace")).hexdigest()
    return lines, certain, places, page


_PLACE = "struct<name string, sure boolean, filling string, frame string, left string, right string>"
_ARROW_PLACE = pa.list_(pa.struct([("name", pa.string()), ("sure", pa.bool_()), *((c, pa.string()) for c in ("filling", "frame", "left", "right"))]))


def _fillings(lines, pairs: bytes):
    """(context, filling) of wanted contexts, at most ``FILLINGS`` + 1 fillings of each at a time: more tell nothing, and
    with fewer the sets of all tasks add up to all of them. ``pairs`` has a byte for each hash of two words: 1 where they
    are wanted on the left of a place, 2 on the right."""
    out: dict[str, set] = {}
    sides = _Flags(pairs)
    for line in lines:
        w = ["^", "^", *_plain(line.split()), "$", "$"]
        two = [f"{a} {b}" for a, b in zip(w, w[1:])]
        flags = [sides[x] for x in two]
        n = len(two)
        for i, flag in enumerate(flags):
            if flag & 1:
                for k in range(i + 3, min(i + 6, n)):  # fillings of one to three words
                    if flags[k] & 2:
                        got = out.setdefault(f"{two[i]} □ {two[k]}", set())
                        if len(got) <= FILLINGS:
                            got.add(" ".join(w[i + 2 : k]))
        if len(out) > HELD:
            yield out
            out = {}
    yield out


class _Flags(dict):
    """Flags by the hash, remembered key by key."""

    def __init__(self, flags: bytes):
        super().__init__()
        self.flags, self.last = flags, len(flags) - 1

    def __missing__(self, x: str) -> int:
        if len(self) > HELD:
            self.clear()
        got = self[x] = self.flags[zlib.crc32(x.encode("utf-8", "replace")) & self.last]
        return got


def residue_reasons(documents: DataFrame, all_contexts: bool = True) -> DataFrame:
    """doc_id and reason of every document with residue: ``frame`` (a slot induced by aligned lines), ``context`` (by the
    words around it), ``name`` (by its name), ``form`` (an unmistakable form), ``page`` (a repeated page) or ``notice`` (a
    notice or filler by itself). A document can have several. Without ``all_contexts`` the corpus is searched only for the
    contexts of places that nothing else decides, which changes the reasons but not the documents.

    Null, empty and blank texts and null ids give no row, copies of a row count once, equal texts under several ids are
    judged alike, and only different texts count as repetitions. An empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            texts = strings(batch.column(1))
            got = [judge(t) for t in texts]
            key = [hashlib.md5(t.encode("utf-8", "replace")).hexdigest() for t in texts]
            arrays = [batch.column(0), pa.array(key, pa.string()), pa.array([g[1] for g in got], pa.bool_()), pa.array([g[2] for g in got], _ARROW_PLACE)]
            arrays += [pa.array([g[3] for g in got], pa.string()), pa.array(["\n".join(g[0]) for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "certain", "places", "page", "prose"])

    rows = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != ""))
    kind = dict(documents.dtypes)["doc_id"]
    judged = spread(rows.select("doc_id", "text"), "doc_id").mapInArrow(run, f"doc_id {kind}, key string, certain boolean, places array<{_PLACE}>, page string, prose string")
    judged = stage(judged, "residue")
    texts = judged.where((F.size("places") > 0) | F.col("page").isNotNull()).select("key", "places", "page").dropDuplicates(["key"])
    texts = stage(texts, "residue-marked")
    places = texts.select("key", F.explode("places").alias("p")).select("key", "p.*")

    # a place that stands alone in its line has nothing to be aligned by
    frames = places.where(F.regexp_replace("frame", "[□ ]+", "") != "").groupBy("frame").agg(F.approx_count_distinct("filling", 0.02).alias("n")).where(F.col("n") > FILLINGS).select("frame", F.lit(True).alias("framed"))
    known = places.where("sure AND name <> ''").groupBy("name").agg(F.approx_count_distinct("key", 0.02).alias("n")).where(F.col("n") >= NAMES).select("name", F.lit(True).alias("named"))
    places = stage(places.join(frames, "frame", "left").join(known, "name", "left").select("key", "sure", "left", "right", F.coalesce("framed", F.lit(False)).alias("framed"), F.coalesce("named", F.lit(False)).alias("named")), "residue-places")

    # which of a fixed number of hashes are wanted: the lines are only searched for those, and the join settles it
    open_ = places if all_contexts else places.where("NOT (sure OR framed OR named)")
    open_ = open_.where("NOT (left = '^ ^' AND right = '$ $')")
    sides = open_.select("key", F.concat_ws(" □ ", "left", "right").alias("v")).distinct()
    half = F.array(F.struct(F.lit(1).alias("bit"), F.col("left").alias("x")), F.struct(F.lit(2).alias("bit"), F.col("right").alias("x")))
    wanted = open_.select(F.explode(half).alias("h")).select("h.bit", F.crc32("h.x").bitwiseAND(SLOTS - 1).alias("slot"))
    flags = bytearray(SLOTS)
    for r in wanted.distinct().toArrow().to_pylist():  # 2 * SLOTS at most
        flags[r["slot"]] |= r["bit"]
    held = documents.sparkSession.sparkContext.broadcast(bytes(flags))

    def fillings(batches):
        lines = (x for batch in batches for prose in strings(batch.column(0)) for x in prose.split("\n"))
        for found in _fillings(lines, held.value):
            keys = [k for k, v in found.items() for _ in v]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([x for v in found.values() for x in v], pa.string())], ["v", "filling"])

    reasons = [places.where(c).select("key", F.lit(r).alias("reason")) for c, r in (("framed", "frame"), ("named", "name"), ("sure", "form"))]
    if any(flags):
        filled = judged.select("prose").mapInArrow(fillings, "v string, filling string").join(sides.select("v").distinct(), "v", "left_semi")
        # the place's own filling is one of those seen
        induced = filled.groupBy("v").agg(F.approx_count_distinct("filling", 0.02).alias("n")).where(F.col("n") > FILLINGS).select("v")
        reasons.append(sides.join(induced, "v", "left_semi").select("key", F.lit("context").alias("reason")))
    repeated = texts.where(F.col("page").isNotNull()).groupBy("page").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATS).select("page")
    by_page = texts.join(repeated, "page", "left_semi").select("key", F.lit("page").alias("reason"))

    slots_of = reduce(DataFrame.unionByName, [*reasons, by_page]).distinct()
    ids = judged.select("doc_id", "key").distinct()
    notices = judged.where("certain").select("doc_id", F.lit("notice").alias("reason"))
    return ids.join(slots_of, "key").select("doc_id", "reason").unionByName(notices).distinct()


def residue_documents(documents: DataFrame) -> DataFrame:
    """doc_id of every document with residue, for any of the reasons of ``residue_reasons``."""
    return residue_reasons(documents, all_contexts=False).select("doc_id").distinct()
