import re
import unicodedata
from hashlib import sha256

from pyspark.sql import functions as F

from quern.functions import text as T

ODD = ["one\r\n\r\ntwo", "one\r\rtwo", "one\n\ntwo", "é é Å", "ß İ ς Σ ﬁ", "각 한", "x", "\x1c\x85　 y", "ä́b क़", "<|endoftext|>", "日本語 ２０２４ ½", "z" * 70_000]
BLANK = ["", " ", "\x1c\x1f", "\x85 　\xa0", None]


def frame(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")


def test_blank_is_what_python_strips(spark):
    rows = frame(spark, ODD + BLANK).select("id", T.is_text(F.col("text")).alias("ok")).collect()
    assert {r.id: r.ok for r in rows} == {k: bool(t and t.strip()) for k, t in enumerate(ODD + BLANK)}


def test_identity_and_split_are_hashlib_s(spark):
    rows = frame(spark, ODD).select("text", T.document_id(F.col("text")).alias("d")).select("*", T.split_bucket(F.col("d")).alias("b"), T.hash_split(F.col("d")).alias("s")).collect()
    for r in rows:
        canonical = unicodedata.normalize("NFC", r.text).replace("\r\n", "\n").replace("\r", "\n")
        assert r.d == sha256(canonical.encode()).hexdigest()
        assert r.b == int(sha256(f"42:{r.d}".encode()).hexdigest(), 16) % 10_000
        assert r.s == ("validation" if r.b < 200 else "train")
    assert len({r.d for r in rows[:3]}) == 1


def test_composition_is_needed_only_from_u0300():
    """The text classes for which the Python step is left out are left alone by NFC."""
    assert all(unicodedata.normalize("NFC", chr(c)) == chr(c) and unicodedata.combining(chr(c)) == 0 for c in range(0x300))


def test_other_moduli(spark):
    d = sha256(b"x").hexdigest()
    for m in (1, 2, 97, 10_007, (1 << 31) - 1):
        got = spark.range(1).select(T.split_bucket(F.lit(d), 7, m).alias("b")).first().b
        assert got == int(sha256(f"7:{d}".encode()).hexdigest(), 16) % m


def test_ngrams():
    assert T.normalize_for_ngrams("CAFÉ\t\n—  TWO") == T.normalize_for_ngrams("café — two") == ["café", "—", "two"]
    assert T.normalize_for_ngrams("a_b ß!ﬁ") == ["a_b", "ss", "!", "fi"]
    words = [f"w{k}" for k in range(14)]
    assert T.ngram_digests(" ".join(words[:12])) == set()
    assert T.ngram_digests(" ".join(words)) == {sha256("␟".join(words[k : k + 13]).encode()).digest() for k in (0, 1)}


def test_metrics(spark):
    m = T.size_metrics(F.col("text"))
    for r in frame(spark, [t for t in ODD if t]).select("text", *[c.alias(n) for n, c in m.items()]).collect():
        words = re.findall(r"\S+", r.text)
        assert (r.n_bytes, r.n_chars, r.n_words) == (len(r.text.encode()), len(r.text), len(words))
    row = spark.range(1).select(T.timestamp_filename(F.lit("2026-01-02T03:04:05+00:00")).alias("t"), T.is_commit(F.lit("a" * 40)).alias("y"), T.is_commit(F.lit("a" * 40 + "\n")).alias("n"), T.is_commit(F.lit("A" * 40)).alias("u")).first()
    assert (row.t, row.y, row.n, row.u) == ("2026-01-02T03-04-05_00-00", True, False, False)


def test_source_digest(spark):
    rows = T.source_text_digest(frame(spark, ["A  b!", None])).collect()
    assert {r.id: r.digest for r in rows} == {0: sha256(b"a b !").hexdigest(), 1: None}
