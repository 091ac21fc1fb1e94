import hashlib
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from quern.operators import tokenize as K

FILE = Path("/opt/tokenizers/byte_bpe_50k.json")
TEXTS = ["It's  10 o'clock,\n\n  don't!", "naïve Straße ½ x_y", "", None, "a\tb 　c", "<|endoftext|> x", "x" * 5000, "日本 語'll"]


def test_pretokens(spark):
    regex = pytest.importorskip("regex")
    own = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string").select("text", K.pretokens(F.col("text")).alias("p")).collect()
    for r in rows:
        assert r.p is None if r.text is None else r.p == own.findall(r.text)


def test_encoder_can_be_any_function(spark):
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "k int, text string, ids_of string")
    got = {r.k: r.ids for r in K.encode(rows, lambda ts: [[len(w) for w in t.split(" ")] for t in ts]).collect()}
    assert got == {k: t if t is None else [len(w) for w in t.split(" ")] for k, t in enumerate(TEXTS)}
    assert K.encode(rows.limit(0), lambda ts: []).columns == ["k", "ids_of", "ids"]


@pytest.mark.skipif(not FILE.exists(), reason="no vocabulary file")
def test_file(spark):
    pytest.importorskip("tokenizers")
    digest = hashlib.sha256(FILE.read_bytes()).hexdigest()
    end = K.end_id(str(FILE), "<|endoftext|>")
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, text string")
    inline = {r.k: r.ids for r in K.encode(rows, K.from_file(str(FILE), digest)).collect()}
    assert inline[3] is None and inline[2] == [] and inline[5][0] == end and K.vocabulary_size(str(FILE)) == 50_257
    plain = {r.k: r.ids for r in K.encode(rows, K.from_file(str(FILE), specials_are_text=True)).collect()}
    assert end not in plain[5] and plain[0] == inline[0]
    for bad in ({"sha256": "0" * 64}, {"end": "<none>"}):
        with pytest.raises(RuntimeError):
            K.load(str(FILE), **bad)
