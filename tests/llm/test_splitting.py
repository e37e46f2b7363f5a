import re

from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.llm import splitting as s
from fathomline.llm.tokens import VOCABULARY, Encoder

ALPHABET = "ab.。 \n\r\té,;!?汉́‍\U0001f469"


def check(text, limit, overlap):
    pieces = s.cut_points(text, limit, overlap)
    if not text:
        assert pieces == []
        return
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and pieces[-1][2] == "end"
    for i, (a, b, _) in enumerate(pieces):
        assert 0 < b - a <= limit
        if i:
            before = pieces[i - 1]
            assert before[1] - overlap <= a < before[1] < b


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=600), st.integers(20, 60), st.integers(0, 15))
def test_pieces_cover_the_text(text, limit, overlap):
    check(text, limit, max(1, overlap))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abcdefgh. \n,", max_size=400), st.integers(3, 40))
def test_a_hard_cut_is_a_run_over_the_limit(text, limit):
    hard = any(how == "hard" for *_, how in s.cut_points(text, limit, 0))
    assert hard == bool(re.search(rf"[^\s{re.escape(s.MARKS)}]{{{limit + 1}}}", text) and len(text) > limit)


def test_hard_cuts_of_the_given_chunks(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/kb_chunks.parquet").where("length(content) > 1200").select("id", "content").collect()
    df = spark.createDataFrame(rows)
    got = {r["id"]: r["kind"] for r in s.kinds(df, "content").collect()}
    assert got == {r["id"]: "hard" if re.search(rf"[^\s{re.escape(s.MARKS)}]{{1201}}", r["content"]) else "soft" for r in rows}
    assert set(got.values()) == {"hard", "soft"}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=ALPHABET + "xyz汉字", max_size=400), st.integers(5, 40), st.integers(0, 4))
def test_pieces_by_tokens(text, limit, overlap):
    encoder = Encoder(VOCABULARY)
    measure = s.Tokens(text, encoder)
    pieces = s.cut_points(text, limit, overlap, measure)
    assert measure.size(0, len(text)) == len(encoder.encode([text])[0])
    at = 0
    for i, (a, b, _) in enumerate(pieces):
        assert a <= at < b or not text
        # a character may be more tokens than the limit is, but no piece of more characters is
        assert measure.size(a, b) <= limit or b - a == 1
        if i:
            assert measure.size(a, at) <= overlap + 4 and a > pieces[i - 1][0]
        at = b
    assert at == len(text)


def test_prefix_sums_of_tokens():
    text = "one two 汉字\U0001f469 three"
    measure = s.Tokens(text, Encoder(VOCABULARY))
    ids = len(Encoder(VOCABULARY).encode([text])[0])
    assert measure.size(0, len(text)) == ids and measure.reach(0, ids) == len(text)
    assert [measure.reach(0, k) for k in (1, 2)] == [3, 7] and measure.back(7, 1) == 3
    assert s.Tokens("", Encoder(VOCABULARY)).reach(0, 5) == 0


def test_boundaries_are_preferred():
    text = "First part. " * 60 + "\n\n" + "Second part. " * 80
    pieces = s.cut_points(text)
    assert pieces[0][2] == "paragraph" and text[: pieces[0][1]].endswith("\n\n")
    assert {p[2] for p in pieces[1:-1]} <= {"sentence", "paragraph"}
    assert s.cut_points("word " * 1000)[0][2] == "weak"
    assert s.cut_points("x" * 3000)[0] == (0, 1200, "hard")
    assert s.cut_points("x" * 3000)[1][0] == 1080


def test_pairs_stay_together():
    text = "x" * 1199 + "\r\n" + "y" * 1500
    assert all(text[b - 1 : b + 1] != "\r\n" for _, b, _ in s.cut_points(text))
    marks = "e" + "́" * 3000
    check(marks, 1200, 120)


def test_frames(spark):
    rows = [(1, "d", "a" * 1201, 1), (2, None, None, None), (3, "d", "", 3), (4, "d", "short", 4), (5, "d", "b c " * 400, 5), (5, "d", "b c " * 400, 5)]
    df = spark.createDataFrame(rows, "id long, doc_id string, content string, piece int")
    assert sorted((r["id"], r["kind"]) for r in s.kinds(df, "content").collect()) == [(1, "hard"), (5, "soft"), (5, "soft")]
    got = s.split(df, "content", ["id", "doc_id"]).collect()
    assert {r["id"] for r in got} == {1, 4, 5}
    first = [r for r in got if r["id"] == 1]
    assert [(r["piece"], r["start_pos"], r["n_chars"]) for r in first] == [(1, 1, 1200), (2, 1081, 121)]
    assert {r["id"] for r in s.split(df, "content", ["id"], longer_only=True).collect()} == {1, 5}
    none = df.limit(0)
    assert s.kinds(none, "content").count() == s.split(none, "content", ["id"]).count() == 0


def test_texts_are_rebuilt_from_their_pieces(spark):
    texts = ["Wort und Satz. " * 300, "汉字。" * 900, "x" * 5000, "a", "e" + "\u0301" * 3000, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    for tokens in (False, True):
        pieces = s.split(df, "content", ["id"], *((50, 5) if tokens else (1200, 120)), in_tokens=tokens)
        assert {r["id"]: r["text"] for r in s.rebuilt(pieces, "id").collect()} == {i: t for i, t in enumerate(texts) if t}
        assert pieces.agg({"n_tokens" if tokens else "n_chars": "max"}).first()[0] <= (50 if tokens else 1200)


def test_a_very_long_text():
    text = "Wort und Satz. " * 200_000
    pieces = s.cut_points(text)
    assert pieces[-1][1] == len(text) and len(pieces) > 2500
