import random

import pytest

from quern.llm import split, tokens

DOCS, LIMITS = "doc_id bigint, text string, piece int, limit_name string, cut string", "limit_name string, max_tokens int, overlap_tokens int, doc_id int"


def texts(seed):
    r = random.Random(seed)
    words = ["alpha", "naïveté", "of", "2,345", "Wörter", "東京"]
    out = [None, "", "short", "x" * 3000, "ß" * 500, "😀" * 300, " " * 400, "\n" * 300, "日本。" * 200]
    for _ in range(40):
        sentences = [" ".join(r.choices(words, k=r.randint(1, 25))) + r.choice([".", "!", ""]) for _ in range(r.randint(1, 30))]
        out.append("".join(s + r.choice([" ", " ", "\n", "\n\n"]) for s in sentences))
    return out


@pytest.mark.parametrize("limits", [[("a", 128, 16, 1), ("b", 30, 0, 1), ("c", 10, 7, 1)], [("d", 5, 4, 1), ("e", 1, 0, 1), ("f", 3, 9, 1), ("g", 40, None, 1)]])
def test_pieces(spark, limits):
    own = texts(1)
    docs = [(k, t, 1, "x", "y") for k, t in enumerate(own)]
    got = split.pieces(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(limits, LIMITS)).collect()
    e = tokens.encoder()
    for name, limit, overlap, _ in limits:
        overlap = min(overlap or 0, limit - 1)
        for k, t in enumerate(own):
            ids = e.encode(t or "")
            pieces = sorted((x for x in got if x.limit_name == name and x.doc_id == k), key=lambda x: x.piece)
            if len(ids) <= limit:
                assert not pieces
                continue
            assert [x.piece for x in pieces] == list(range(len(pieces))) and pieces[0].start_token == 0 and pieces[-1].end_token == len(ids) and pieces[-1].end_char == len(t)
            for x in pieces:  # the tokens are those of the text between the offsets
                assert e._bpe.decode_bytes(ids[x.start_token : x.end_token]) == t[x.start_char : x.end_char].encode()
                assert x.end_token - x.start_token <= limit or x.cut == "char"
            for x, y in zip(pieces, pieces[1:]):
                assert overlap <= x.end_token - y.start_token <= overlap + 3 and y.end_token > x.end_token


def test_cuts_are_natural_where_they_can_be(spark):
    t = "One two three four. " * 40 + "\n" + "word " * 300 + "y" * 2000
    rows = split.pieces(spark.createDataFrame([(1, t, 1, "x", "y")], DOCS), spark.createDataFrame([("a", 64, 8, 1)], LIMITS)).orderBy("piece").collect()
    kinds = [x.cut for x in rows]
    assert {"sentence", "word", "hard", "end"} <= set(kinds) and kinds == sorted(kinds, key=["sentence", "line", "word", "hard", "end"].index)
    for x in rows:
        if x.cut == "sentence":
            assert t[: x.end_char].endswith(".")
        if x.cut == "word":
            assert t[x.end_char - 1].isalnum() != t[x.end_char].isalnum() or t[x.end_char].isspace()


def cuts(text, limit, overlap=0):
    s = split.Splitter()
    s.load(text)
    return [(text[a:b], kind) for _, _, a, b, kind in s.cut(limit, overlap)]


def test_the_last_strong_boundary_counts_wherever_it_lies():
    assert cuts("Title\n" + "word " * 100, 64)[0] == ("Title\n", "line")
    assert cuts("Short one. " + "word " * 100, 64, 2)[0] == ("Short one.", "sentence")
    assert cuts("One. " + "word " * 100, 64, 3)[0][1] == "word"  # not beyond where the next piece begins


@pytest.mark.parametrize("end", ['."', ".)", "?”", "!’", "。”", "…»", '.")', ".]"])
def test_sentences_end_behind_closing_quotes_and_brackets(end):
    assert cuts("He said so" + end + " " + "word " * 100, 64)[0] == ("He said so" + end, "sentence")


def test_text_of_pieces_and_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c. " * 30, 1, "x", "y")], DOCS)
    limits = spark.createDataFrame([("a", 20, 3, 1), ("bad", None, 1, 1), ("zero", 0, 1, 1)], LIMITS)
    for x in split.with_text(docs, split.pieces(docs, limits)).collect():
        assert x.piece_text == ("a b c. " * 30)[x.start_char : x.end_char]
    assert split.pieces(docs, spark.createDataFrame([], LIMITS)).collect() == split.pieces(spark.createDataFrame([], DOCS), limits).collect() == []


def test_a_long_run_is_cut_in_linear_time():
    s = split.Splitter()
    n = s.load("ab1-" * 100_000)
    assert len(s.cut(128, 16)) >= n // 128
    s.load("z" * 400_000)
    assert s.cut(128, 16)[-1][3] == 400_000
