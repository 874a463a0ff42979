"""Problem 1: generated, minified or vendored source files and data stored as source.

A character trigram model of the parts of identifiers is trained for each language over all rows, strings and comments aside. Every chunk then gives counts that
add up per file: bits of its name parts under the model, distinct lines and distinct line shapes, bytes in literals,
naming styles, and provenance notes in header comments. A file is

* minified when its names are mangled: more bits a character than the language's model needs on the average, and mostly
  one or two letters long;
* generated (or a table) when its lines are fillings of few templates: low diversity of shapes against lines, or when a
  header comment says so;
* vendored when it stands in a folder for foreign code, when a comment of its own says it is a copy, or when its naming
  style is foreign: many bits a word boundary under the habits of its repository's other files in that language, while its
  words are those of the language;
* data when literals make up most of it and hardly any statement is left.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.tokens import strings
from quernel.session import spread, stage

#: Extensions of each language that has a model of its own. Fixed values.
FAMILIES = [
    ["py", "pyw"], ["js", "mjs", "cjs", "jsx"], ["ts", "tsx", "mts"], ["rs"], ["go"], ["java"], ["c", "h"], ["cc", "cpp", "cxx", "hpp", "hh"], ["cs"], ["rb"], ["php"], ["kt", "kts"],
    ["swift"], ["scala"], ["dart"], ["lua"], ["pl", "pm"], ["r"], ["sh", "bash"], ["sql"],
]
LANGUAGES = {e: k for k, family in enumerate(FAMILIES) for e in family}
SOURCE = list(LANGUAGES)
MANGLED_BITS = 1.05  # bits a symbol of name parts, as a multiple of the median file's in the language
SHORT_NAMES = 0.35
LOW_DIVERSITY = 0.95  # distinct line shapes as a multiple of the root of the number of distinct lines; imports and comments aside
MIN_LINES = 6
DATA_SHARE = 0.5
FEW_SHAPES = 6
FOREIGN = 2.5  # bits a word boundary of a file's names under its repository's own habits in the language
MIN_BOUNDARIES = 20
FAMILIAR = 1.02  # bits a symbol, as a multiple of the language's mean, up to which a file is written in the language of its name
FOLDERS = r"(^|/)(vendor|vendors|vendored|third[-_]?party|thirdparty|extern|external|externals|godeps|node_modules|bower_components|site-packages|dist-packages|jspm_packages)/"

_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STRING = re.compile(r'"(?:[^"\n\\]|\\.)*"|\'(?:[^\'\n\\]|\\.)*\'|`[^`]*`')
_NAME = re.compile(r"[a9]+(?:\.[a9]+)*")
_LETTERS = str.maketrans({**{chr(c): "a" for c in range(128) if chr(c).isalpha() or chr(c) in "_$"}, **{str(d): "9" for d in range(10)}})
_DIGITS = re.compile(r"\d")
_SNAKE, _CAMEL = re.compile(r"[a-z0-9]_[a-z]"), re.compile(r"[a-z0-9][A-Z]")
_NOTE = re.compile(r"^[ \t]*(?://+!?|#+!?|/\*+!?|\*+|--+|;+|<!--)[ \t]*(.+?)[ \t]*(?:\*/|-->)?[ \t]*$", re.M)
#: Strings and comments, which hold no identifiers.
_NO_NAME = re.compile(r'"(?:[^"\n\\]|\\.)*"|\'(?:[^\'\n\\]|\\.)*\'|`[^`]*`|//[^\n]*|/\*[\s\S]*?\*/|(?:^|(?<=\s))(?:#(?![!\[])|--)[^\n]*', re.M)
_PLAIN = re.compile(r"^(?:import|from|use|package|require|#|//|/?\*|export \*|\W*$)")
#: How header comments of generators and of copies begin or end. Fixed wordings of common tools, in several languages.
_GENERATED = re.compile(
    r"^(?:this (?:file|code|module|class) (?:was|is|has been) (?:\w+ly )?(?:auto-?)?(?:generated|created)\b"
    r"|(?:\w+ )?code generated (?:by|from)\b|generated (?:by|from|with|using) (?:the )?\S+|@?(?:auto-?)?generated (?:by|from)\b|@generated\b"
    r"|<auto-?generated|auto-?generated (?:file|code|by|from)\b|autogenerated\b|(?:machine|automatically|auto)[ -]generated\b(?! (?:method|function|stub))"
    r"|built from \S+ .*(?:never|not) edit|.*\bdo not (?:edit|modify)\b(?: this file| by hand|[.!]*$)"
    r"|fichier (?:produit|généré|genere)\b|.*\bne pas modifier\b|diese datei wurde .*(?:erzeugt|generiert)|automatisch (?:erzeugt|generiert)"
    r"|(?:este )?archivo generado\b|.*no (?:editar|modificar)\b|.*自動生成され|.*自动生成|.*由 ?\S+ ?生成)",
    re.I,
)
_COPY = re.compile(
    r"^(?:vendored (?:copy|from|snapshot)|this (?:file )?is an? (?:third[- ]party|vendored|unmodified|verbatim) copy|third[- ]party (?:copy|code|source)\b"
    r"|bundled (?:copy|snapshot|version)\b|(?:verbatim |unmodified )?copy of upstream|copied (?:verbatim )?from\b|imported (?:unchanged |verbatim |unmodified |as is )?from\b|upstream copy"
    r"|kopie (?:der|des|einer|von)\b|copie (?:de|du|tierce)\b|copia (?:de|del)\b|.*第三方.*(?:副本|拷贝|复制)|.*(?:外部|サードパーティ).*(?:コピー|複製))",
    re.I,
)


def language_of(file: str) -> int:
    return LANGUAGES[file.rpartition(".")[2].lower()]


def name_parts(code: str) -> list[str]:
    """Parts of the identifiers and keywords of a text."""
    return _PART.findall(_NO_NAME.sub(" ", code))


def _symbols(part: str) -> list[int]:
    """0 begins a part, 1..26 letters, 27 ends it."""
    return [0, 0, *(ord(c) - 96 for c in part.lower()), 27]


def trigram_rows(languages: list[int], texts: list[str]) -> Counter:
    """Counts of (language, trigram code) over the name parts of the texts, each part once a text: a few minified files
    would else teach the model their own names."""
    parts: dict[int, Counter] = {}
    for k, t in zip(languages, texts):
        parts.setdefault(k, Counter()).update(set(name_parts(t)))
    out: Counter = Counter()
    for k, counts in parts.items():
        for part, n in counts.items():
            s = _symbols(part)
            for a, b, c in zip(s, s[1:], s[2:]):
                out[k, (a * 28 + b) * 28 + c] += n
    return out


def train(chunks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each trigram's last symbol, [language, first, second, last], and each language's mean over what it was
    trained on; the counts are those of all rows."""

    def run(batches):
        for batch in batches:
            files, texts = strings(batch.column(0)), strings(batch.column(1))
            rows = trigram_rows([language_of(f) for f in files], texts)
            keys = list(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keys], pa.int32()), pa.array([g for _, g in keys], pa.int32()), pa.array(list(rows.values()), pa.int64())],
                ["language", "gram", "n"],
            )

    counted = chunks.select("file", "code").mapInArrow(run, "language int, gram int, n bigint")
    counts = np.zeros((len(FAMILIES), 28**3))
    got = counted.groupBy("language", "gram").agg(F.sum("n").alias("n")).toArrow()  # at most 20 * 28^3 rows
    counts[got["language"].to_numpy(), got["gram"].to_numpy()] = got["n"].to_numpy()
    counts = counts.reshape(-1, 28, 28, 28)
    bits = -np.log2((counts + 0.05) / (counts + 0.05).sum(axis=3, keepdims=True))
    mean = (counts * bits).sum(axis=(1, 2, 3)) / np.maximum(counts.sum(axis=(1, 2, 3)), 1)
    return bits.astype(np.float32), mean


def part_bits(model: np.ndarray, part: str) -> tuple[float, int]:
    s = _symbols(part)
    return float(sum(model[a, b, c] for a, b, c in zip(s, s[1:], s[2:]))), len(s) - 2


def line_shapes(code: str) -> tuple[list[int], list[int], int, int]:
    """Hashes of distinct lines and of distinct shapes, bytes in long literals and digits, distinct shapes of statements."""
    bare = _STRING.sub(lambda m: '"' if len(m.group()) < 120 else "\x01" * len(m.group()), code)
    literal = bare.count("\x01")
    shapes = _NAME.sub("a", bare.replace("\x01", "").translate(_LETTERS)).split("\n")
    lines = bare.split("\n")
    seen, kinds, statements = {}, {}, set()
    for line, shape in zip(lines, shapes):
        s = shape.strip(" \t\r")
        if s and s not in ("}", "{", ")", "};", "});") and not _PLAIN.match(line.lstrip()):
            seen[line] = None
            kinds[s] = None
            if "\x01" not in line:
                statements.add(s)
    crc = lambda d: [zlib.crc32(x.encode("utf-8", "replace")) & 0x7FFFFFFF for x in d]
    return crc(seen), crc(kinds), literal + len(_DIGITS.findall(bare)), crc(statements)


def _features(chunks: DataFrame, model: np.ndarray) -> DataFrame:
    names = ["repo", "file", "bits", "symbols", "parts", "short", "size", "literal", "snake", "camel", "made", "copied", "line", "shape", "statement"]

    def run(batches):
        cache: list[dict] = [{} for _ in FAMILIES]
        for batch in batches:
            repos, files, kinds = batch.column(0), strings(batch.column(1)), strings(batch.column(2))
            out: list[list] = [[] for _ in names[2:]]
            for file, kind, code in zip(files, kinds, strings(batch.column(3))):
                k = language_of(file)
                known, bits, symbols, short = cache[k], 0.0, 0, 0
                parts = name_parts(code)
                for p in parts:
                    got = known.get(p)
                    if got is None:
                        if len(known) > 200_000:
                            known.clear()
                        got = known[p] = part_bits(model[k], p)
                    bits += got[0]
                    symbols += got[1]
                    short += got[1] <= 3
                made = copied = False
                for m in _NOTE.finditer(code):
                    made = made or bool(_GENERATED.match(m.group(1)))
                    copied = copied or bool(_COPY.match(m.group(1)))
                lines, shapes, literal, statements = line_shapes(code)
                row = (bits, symbols, len(parts), short, len(code), literal, len(_SNAKE.findall(code)), len(_CAMEL.findall(code)), made, copied, lines, shapes, statements)
                for column, value in zip(out, row):
                    column.append(value)
            ints = pa.list_(pa.int32())
            kinds_ = [pa.float64()] + [pa.int64()] * 7 + [pa.bool_(), pa.bool_(), ints, ints, ints]
            yield pa.RecordBatch.from_arrays([repos, batch.column(1), *(pa.array(x, t) for x, t in zip(out, kinds_))], names)

    schema = (
        "repo string, file string, bits double, symbols bigint, parts bigint, short bigint, size bigint, literal bigint, snake bigint, camel bigint, "
        "made boolean, copied boolean, line array<int>, shape array<int>, statement array<int>"
    )
    return chunks.select("repo", "file", "kind", "code").mapInArrow(run, schema)


def file_scores(chunks: DataFrame) -> DataFrame:
    """One row for each source file (repo, file) with its sums and the four marks minified, generated, vendored, data.

    All rows of a file count, whatever their kind, but for documents and documentation rows; copies of a row do not
    change a mark, as marks rest on shares and distinct lines. Null code counts as empty, rows without repo or file are
    left out, and an empty table gives no rows.
    """
    ext = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1))
    kind = F.coalesce("kind", F.lit(""))
    rows = chunks.where(ext.isin(SOURCE) & (kind != "document") & ~kind.endswith("_doc") & F.col("repo").isNotNull())
    rows = spread(rows.select("repo", "file", "kind", "code"), "repo", "file")
    model, mean = train(rows)
    made = _features(rows, model)
    # Partial sums before the shuffle; distinct lines and shapes as sketches of fixed size, so no file is one task's rows.
    marks = [F.max("made").alias("made"), F.max("copied").alias("copied")]
    first = F.posexplode_outer(F.arrays_zip("line", "shape", "statement")).alias("pos", "z")
    wide = made.select(*[c for c in made.columns if c not in ("line", "shape", "statement")], first)
    head = lambda c: F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, F.col(c))).alias(c)
    sums = [head(c) for c in ("bits", "symbols", "parts", "short", "size", "literal", "snake", "camel")]
    count = [F.approx_count_distinct(f"z.{c}", 0.04).alias(f"{c}s") for c in ("line", "shape", "statement")]
    files = wide.groupBy("repo", "file").agg(*sums, *marks, *count)

    bits = F.col("bits") / F.greatest("symbols", F.lit(1))
    short = F.col("short") / F.greatest("parts", F.lit(1))
    diversity = F.col("shapes") / F.sqrt(F.greatest("lines", F.lit(1)))
    literal = F.col("literal") / F.greatest("size", F.lit(1))
    camel = F.col("camel") / F.greatest(F.col("camel") + F.col("snake"), F.lit(1))
    files = files.withColumns({"bits": bits, "short": short, "diversity": diversity, "literal": literal, "camel_share": camel, "ext": F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1))})
    files = stage(files, "origin-files")  # read three times below
    files = files.withColumn("family", F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.col("ext")])
    own = files.groupBy("repo", "family").agg(F.sum("camel").alias("all_camel"), F.sum("snake").alias("all_snake"))
    files = files.join(own, ["repo", "family"])
    folder = F.lower("file").rlike(FOLDERS)
    # how foreign a file's word boundaries are to the other files of its repository in its language, as cross-entropy
    camel, snake = F.col("all_camel") - F.col("camel") + 1, F.col("all_snake") - F.col("snake") + 1
    bits_of = lambda n: F.log2((camel + snake) / n)
    boundaries = F.col("camel") + F.col("snake")
    foreign = (F.col("camel") * bits_of(camel) + F.col("snake") * bits_of(snake)) / F.greatest(boundaries, F.lit(1))
    means = F.array(*[F.lit(float(x)) for x in mean])
    files = files.withColumns({"usual_bits": F.get(means, F.col("family")), "foreign": foreign})
    theirs = (F.col("foreign") > FOREIGN) & (boundaries >= MIN_BOUNDARIES) & (F.col("bits") <= FAMILIAR * F.col("usual_bits"))
    return files.withColumns(
        {
            "minified": (F.col("bits") > MANGLED_BITS * F.col("usual_bits")) & (F.col("short") > SHORT_NAMES),
            "generated": F.col("made") | ((F.col("diversity") < LOW_DIVERSITY) & (F.col("lines") >= MIN_LINES)),
            "vendored": F.col("copied") | folder | theirs,
            "data": (F.col("literal") > DATA_SHARE) & (F.col("statements") < FEW_SHAPES),
        }
    )


def unwritten_files(chunks: DataFrame) -> DataFrame:
    """repo and file of every source file with one of the four marks."""
    f = file_scores(chunks)
    return f.where(F.col("minified") | F.col("generated") | F.col("vendored") | F.col("data")).select("repo", "file")
