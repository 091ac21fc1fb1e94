import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import encode, tokens

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id bigint, text string, ids string, n int, word string"
TEXTS = [None, "", " ", "\n\n\nx", "<|endoftext|> is text", "don't  stop", "x" * 300, "日本語と1,234.5 ", "é é", "​﻿", "🇺🇳👩‍🔬", "a\r\nb\tc", "�", "…" * 70]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(f"{tokens.TOKENIZERS}/{tokens.NAME}.json")
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "i", 1, "w") for k, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("table_words", [0, 3, 100_000])
def test_ids_are_the_library_s(spark, library, table_words):
    r = random.Random(1)
    texts = TEXTS + [" ".join(r.choices(["the", "naïve", "Straße", "x1", "東京", "--", "\n"], k=r.randint(1, 60))) for _ in range(60)] * 2
    got = {x.doc_id: x.ids for x in encode.encode(frame(spark, texts).repartition(3), table_words=table_words).collect()}
    assert [got[k] for k in range(len(texts))] == library([t or "" for t in texts])


def test_round_trip(spark):
    assert all(x.same for x in encode.round_trip(frame(spark, TEXTS)).collect())
    back = encode.decode(spark.createDataFrame([(1, [50_255]), (2, [60_000]), (3, None), (4, [])], "doc_id int, ids array<int>"))
    got = {x.doc_id: x.bytes for x in back.collect()}
    assert got[1] and got[2] is None and bytes(got[3]) == bytes(got[4]) == b""


def test_nothing(spark):
    assert encode.encode(frame(spark, [])).collect() == []
    rows = encode.encode(spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "doc_id bigint, text string")).collect()
    assert sorted((x.doc_id or 0, x.ids) for x in rows) == [(0, [64]), (0, [64]), (1, [])]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_words_encode_alone_as_they_do_together(library, text):
    e = tokens.encoder()
    words = e.split(text)
    assert "".join(words) == text
    assert [i for w in words for i in e.encode(w)] == library([text])[0]


def test_every_character(library):
    e = tokens.encoder()
    texts = [f"a{c}1{c} {c}!{c}\n" for k in range(0, 0x110000, 7) if not 0xD800 <= k < 0xE000 for c in (chr(k),)]
    assert [[i for w in e.split(t) for i in e.encode(w)] for t in texts] == library(texts)
