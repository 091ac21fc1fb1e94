import random
import unicodedata

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from quern.llm.words import WORD, WordHasher, fold, shingle_sets, word_spans, words


def test_word_class_is_letters_and_numbers():
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            assert bool(WORD.fullmatch(chr(c))) == (unicodedata.category(chr(c))[0] in "LN")


def test_folding():
    assert words("Straße—ﬁne ３4_x") == ["strasse", "fine", "34", "x"]
    assert words("") == words("  \n…") == []


@given(st.lists(st.one_of(st.none(), st.text("ab _", max_size=30)), max_size=6))
def test_sets_are_those_of_word_triples(texts):
    """Null, empty and short texts included; equal triples have equal hashes and others don't."""
    seen = {}
    for text, got in zip(texts, shingle_sets(WordHasher(), texts, 3, 4)):
        w = words(text or "")
        if len(w) < 4:
            assert got is None
            continue
        triples = set(zip(w, w[1:], w[2:]))
        assert len(got) == len(triples) and (np.diff(got.astype(object)) > 0).all()
        seen.setdefault(frozenset(triples), got.tobytes())
        assert seen[frozenset(triples)] == got.tobytes()
    assert len(set(seen.values())) == len(seen)


def test_word_spans_name_the_words_in_the_text():
    """Each span, folded, holds its word; over random text with marks, ligatures, wide forms and scripts without blanks."""
    r = random.Random(8)
    alphabet = "ab Z.\n9é\u0301\u0338ßﬁ½㎧Ⅷ＝Ａ，漢字ｶﾞ각ㄱㅏ😀ǅ\u200dñİ"
    whole = 0
    for _ in range(3000):
        text = "".join(r.choices(alphabet, k=r.randint(0, 25)))
        starts, ends = word_spans(text)
        own = words(text)
        assert len(starts) == len(ends) == len(own) and starts == sorted(starts) and ends == sorted(ends)
        assert all(a < b for a, b in zip(starts, ends))
        whole += all(w in fold(text[a:b]) for w, a, b in zip(own, starts, ends))
    assert whole > 2900  # the rest has parts that fold otherwise alone
    assert word_spans("Ein, Straße½") == ([0, 5, 11], [3, 12, 12])
    assert word_spans("x ＡＢ，漢字 y") == ([0, 2, 5, 8], [1, 4, 7, 9])
    assert word_spans("") == ([], [])
