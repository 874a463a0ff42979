import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from quernel.llm import mixing, splitting, tokens

TEXTS = ["", "plain words", "naïve café 日本語 \U0001f600\U0001f469\u200d\U0001f4bb", "<|endoftext|> is text", "a\x00b\x1f\u202e\u0301", "tab\tline\r\nend ", "x" * 50_000]


def test_ids_and_way_back():
    ids = tokens.encode_texts(TEXTS)
    assert ids[0] == [] and 50256 not in ids[3]
    assert [tokens.decode_ids(i) for i in ids] == TEXTS


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_offsets(text):
    ids = tokens.encode_texts([text])[0]
    starts, ends = tokens.char_spans(text, ids)
    assert len(starts) == len(ids)
    assert tokens.decode_ids(ids) == text
    at = 0
    for a, b in zip(starts, ends):
        assert a <= at and b > a and b >= at  # no gap; parts of one character share its span
        at = max(at, b)
    assert at == len(text)


def test_encode_table(spark):
    rows = [(1, "a b", "x"), (1, "a b", "y"), (2, None, "x"), (3, "", "x"), (None, "q", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in tokens.encode(df, "doc_id", "text").collect()}
    assert got[2] == got[3] == [] and len(got) == 4 and got[1] == tokens.encode_texts(["a b"])[0]
    assert tokens.encode(df, "doc_id", "text").count() == 4
    assert tokens.encode(df.limit(0), "doc_id", "text", offsets=True).count() == 0
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df, "doc_id", "text"), "doc_id").collect()}
    assert back == {1: "a b", 2: "", 3: "", None: "q"}


def spans_are_right(data: bytes, limit: int, overlap: int):
    spans = splitting.cut_spans(data, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(data)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert 0 < b - a <= limit and b > a and d > b
        assert b - overlap <= c <= b
        if c > b - overlap:  # fewer shared only where a character would be cut
            assert all(data[k] & 0xC0 == 0x80 for k in range(b - overlap, c))
    for a, b in spans:
        data[a:b].decode()
    return spans


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é日\U0001f600\n\t", max_size=400), st.integers(30, 90), st.integers(0, 20))
def test_pieces(text, limit, overlap):
    data = text.encode()
    if len(data) > limit:
        spans_are_right(data, limit, overlap)


def test_cuts_are_natural():
    topic = lambda w: "".join(f"{w}_one = {w}_two + {w}_three\n" for _ in range(12))
    data = (topic("alpha") + topic("beta") + topic("gamma")).encode()
    spans = splitting.cut_spans(data, len(topic("alpha")) + 60, 0)
    assert spans[0][1] == len(topic("alpha"))
    assert all(data[b - 1 : b] == b"\n" for _, b in spans)
    words = ("word " * 100).encode()
    assert all(words[b - 1 : b] == b" " for _, b in splitting.cut_spans(words, 52, 5)[:-1])
    spans_are_right(b"x" * 5000, 900, 90)
    spans_are_right("日".encode() * 2000, 901, 91)
    assert all(b - a <= 60 for a, b in splitting.cut_spans(b"\r\n".join([b"ab cd"] * 60), 60, 6))
    with pytest.raises(ValueError):
        splitting.cut_spans(b"abcdef", 3, 0)


def test_split_table(spark):
    chunks = spark.createDataFrame([("a", "x = 1\n" * 400, 1), ("a", "x = 1\n" * 400, 2), ("b", None, 3), ("c", "short", 4), (None, "y" * 3000, 5)], "id string, code string, config_id int")
    config = spark.createDataFrame([(1, 2000, 200, "n"), (2, 900, None, "n"), (3, None, 1, "n"), (None, 10, 1, "n"), (1, 2000, 200, "n")], "config_id bigint, max_chunk_size bigint, overlap bigint, name string")
    got = splitting.split_oversized(chunks, config, with_text=True).distinct().collect()
    assert {(r.config_id, r.chunk_id) for r in got} == {(1, "a"), (2, "a"), (1, None), (2, None)}
    for r in got:
        if r.chunk_id == "a":
            assert r.piece == ("x = 1\n" * 400)[r.start_byte : r.end_byte]
    assert splitting.split_oversized(chunks.limit(0), config).count() == 0 and splitting.split_oversized(chunks, config.limit(0)).count() == 0


def test_mix(spark):
    docs = [(i, f"word{i} " * (5 + i % 7), [" Docs ", "QA", "other", None, "log"][i % 5]) for i in range(200)]
    docs += [docs[0], (900, None, "docs"), (901, "", "docs"), (None, "text of none", "qa")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("docs", 0.5, 1), ("qa", 0.3, 3), ("log", 0.1, 2), ("gone", 0.1, 5)], "source string, target_share double, max_repeats int")
    rows = mixing.mix(df, targets).collect()
    assert rows and {r.source for r in rows} == {"docs", "qa", "log"}
    uses: dict = {}
    for r in rows:
        uses.setdefault((r.source, r.doc_id), []).append(r.repeat)
    limit = {"docs": 1, "qa": 3, "log": 2}
    assert all(len(v) == len(set(v)) <= limit[s] for (s, _), v in uses.items())
    assert [r.position for r in rows] == sorted(r.position for r in rows) and 0 <= rows[0].position and rows[-1].position <= 1
    report = {r.source: r for r in mixing.report(df, targets).collect()}
    assert report["gone"].actual_share == 0 and report["gone"].available_tokens == 0
    for s, share in (("docs", 0.5), ("qa", 0.3), ("log", 0.1)):
        assert report[s].actual_share == pytest.approx(share / 0.9, abs=0.02)
        assert report[s].used_tokens == sum(r.n_tokens for r in rows if r.source == s)
    assert mixing.mix(df.limit(0), targets).count() == 0
    empty = mixing.report(df.limit(0), targets).collect()
    assert len(empty) == 4 and all(r.used_tokens == 0 and r.actual_share == 0 for r in empty)


def test_curriculum_moves_weights(spark):
    df = spark.createDataFrame([(i, "one two three four", "ab"[i % 2]) for i in range(2000)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    rows = mixing.mix(df, targets, slope=0.8).collect()
    early = [r for r in rows if r.position < 0.2]
    late = [r for r in rows if r.position > 0.8]
    share = lambda x: np.mean([r.source == "a" for r in x])
    assert share(early) > 0.6 and share(late) < 0.4 and len(rows) == 2000


def test_valleys_in_other_scripts():
    """Texts without spaces have valleys, too, and the deepest of the whole window is taken."""
    a, b = "猫が庭で魚を食べる。猫は庭が好き。\n" * 6, "船が海で風を受ける。船は海を渡る。\n" * 10
    data = (a + b).encode()
    spans = splitting.cut_spans(data, len(a.encode()) * 2, 0)
    assert spans[0] == (0, len(a.encode()))


def test_schedules_of_sources(spark):
    """A source's own slope moves it; the shares stay."""
    docs = spark.createDataFrame([(i, f"word{i} and more of it here", ("a", "b", "c")[i % 3]) for i in range(300)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 1), ("c", 0.3, 1)], "source string, target_share double, max_repeats int")
    mean = lambda **kw: {r.source: r.m for r in mixing.mix(docs, targets, **kw).groupBy("source").agg(F.avg("position").alias("m")).collect()}
    late, early = mean(schedules={"a": 0.6, "b": -0.8}), mean(schedules={"a": -0.6, "b": 0.8})
    assert late["a"] > late["c"] > late["b"] and early["a"] < early["c"] < early["b"]
    shares = {r.source: r.actual_share for r in mixing.report(docs, targets, schedules={"a": 0.6}).collect()}
    assert all(abs(shares[s] - t) < 0.02 for s, t in (("a", 0.4), ("b", 0.3), ("c", 0.3)))


def test_short_first_lines_are_shared_in_full():
    data = b"# a\n\n# b\n\n" + b"".join(b"row %d of it has some words here\n" % i for i in range(60))
    for limit, overlap in ((200, 80), (512, 64), (90, 80)):
        spans = splitting.cut_spans(data, limit, overlap)
        assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(0 < b - a <= limit for a, b in spans)
        assert all(z - b == overlap and b > a for (a, z), (b, _) in zip(spans, spans[1:]))
