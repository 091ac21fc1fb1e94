import json
import random
import re
import unicodedata
from collections import defaultdict

import pytest

from quern.llm import copies

SCHEMA = "doc_id bigint, text string, digest string, keep_id bigint, copies int"


def letters(text):
    folded = unicodedata.normalize("NFKC", text).casefold()
    return "".join(c for c in folded if unicodedata.category(c)[0] in "LN")


def key(text):
    """The statement of the problem, written anew: character by character, each notation by its own pattern."""
    if text is None:
        return None
    s, pairs = text.strip(), None
    name = r"\s*([^:=|;{}\n]{1,40}?)\s*"
    if s.startswith("{"):
        try:
            x = json.loads(s, object_pairs_hook=lambda p: p)
            if isinstance(x, list) and len(x) > 1 and all(isinstance(v, str) and v.strip() and 1 <= len(k.strip()) <= 30 and not set(k) & set(":=|;{}") for k, v in x):
                pairs = x
        except ValueError:
            pass
    else:
        lines = [x for x in s.split("\n") if x.strip()]
        if len(lines) > 1:
            m = [re.fullmatch(name + r":\s*(\S.*)", x) for x in lines]
        else:
            parts = re.split("[;|]", s)
            m = [re.fullmatch(name + r"=\s*(\S.*)", x, re.S) for x in parts] if len(parts) > 1 else [None]
        if all(m) and all(1 <= len(x[1].strip()) <= 30 for x in m):
            pairs = [(x[1], x[2]) for x in m]
    if pairs:
        leaves = tuple(sorted(letters(k + " " + v) for k, v in pairs))
        return ("record", leaves) if any(leaves) else None
    return ("text", letters(text)) if letters(text) else None


def brute(rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        if (k := key(t)) is not None:
            groups[k].append(d)
    return {(min(g), d) for g in groups.values() for d in g if d != min(g)}


def notations(r, pairs):
    pairs = r.sample(pairs, len(pairs))
    up = r.choice([str, str.upper, str.title])
    form = r.randrange(4)
    if form == 0:
        return json.dumps({up(k): up(v) for k, v in pairs}, indent=r.choice([None, 2]), ensure_ascii=r.random() < 0.5)
    if form == 1:
        return r.choice(["\n", "\n\n", "\r\n"]).join(f"{up(k)}{r.choice([':', ' :  '])} {up(v)}" for k, v in pairs)
    return r.choice(["; ", "|", " | "]).join(f"{up(k)}{r.choice(['=', ' = '])}{up(v)}" for k, v in pairs)


def rows_of(seed, n=160):
    r = random.Random(seed)
    bases = [" ".join(r.choices(["Straße", "ab", "c", "déjà", "x9", "№"], k=r.randint(1, 5))) for _ in range(12)]
    records = [[(f"name {k}", r.choice(["one", "two words", "ﬁne", "é"])) for k in range(r.randint(2, 4))] for _ in range(8)]
    odd = [None, "", " \n", "...", "{}", '{"a": "b"}', '{"a": "b", "c": 1}', '{"a": "b", "c": {"d": "e"}}', "a: b", "a: b\nc", "a=b", "a=b;", "a=b;c=", f"{'n' * 31}: v\nb: c", f"{'n' * 30}: v\nb: c", "{broken", '["x", "y"]', "a: b: c\nd: e", "a b\nc d", "-: -\n+: +"]
    out = []
    for k in range(n):
        x = r.random()
        if x < 0.4:
            t = r.choice(bases)
            t = r.choice([str.upper, str.lower, lambda s: s.replace(" ", r.choice(["", ", ", "\n", "_"])), str])(t)
        elif x < 0.75:
            t = notations(r, r.choice(records))
        else:
            t = r.choice(odd)
        out.append((k + 5, t, "d", 1, 2))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_are_brute_force(spark, seed):
    rows = rows_of(seed)
    groups, members = copies.form_copies(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = [tuple(x) for x in members.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    counts = {k: n for k, n in map(tuple, groups.collect())}
    assert counts == {k: sum(1 for x, _ in got if x == k) + 1 for k, _ in got}


def test_digest_collisions_are_told_apart(spark):
    """With digests of one byte many structures collide; comparing them whole keeps the groups right."""
    rows = rows_of(7, 400)
    _, members = copies.form_copies(spark.createDataFrame(rows, SCHEMA), digest_bytes=1)
    got = [tuple(x) for x in members.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_hot_group_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(copies, "HEAVY_SHARE", 10)
    rows = [(k, "The same. TEXT" if k % 3 else "the same text", None, None, None) for k in range(100)] + rows_of(8)[100:]
    rows = [(k, r[1], *r[2:]) for k, r in enumerate(rows)]
    _, members = copies.form_copies(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(x) for x in members.collect()} == brute(rows)
    groups, members = copies.form_copies(spark.createDataFrame([], SCHEMA))
    assert groups.collect() == members.collect() == []


def test_one_record_in_every_notation():
    a = copies.structure('{"b c": "1", "a": "x; y"}')
    assert a == copies.structure("A : X Y\n\nB C: 1") != copies.structure("B C A: X Y\n1: 1")
    assert copies.structure("a = x y | b c = 1") == copies.structure("b-c=1;a=XY") == a
    assert copies.structure("a: 1\na: 1") != copies.structure("a: 1\nb: 2\na: 1")
    assert copies.root_digest(("r", "x", "y")) == copies.root_digest(("r", "y", "x")) != copies.root_digest(("t", "xy"))
