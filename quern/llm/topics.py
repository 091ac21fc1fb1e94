"""Topics learned from the texts themselves, for problem 8: clusters of word frequencies, within each language.

The centres are fitted on all documents: each is a vector of ``DIMENSIONS`` levels, written once; weights, first centres and every
round of the fit are a pass over these vectors, from which only sums by language and topic leave the tasks. Every document is then given the
nearest centre of its language. All sums and products are of whole numbers that a float holds exactly, so the same documents give
the same centres on any layout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from quern.llm import tokens

#: A language with fewer than ``LEAST`` documents that have words has one topic.
LEAST = 100
TOPICS, DIMENSIONS, ROUNDS = 4, 512, 25
#: Steps of a place's level for one of log(1 + count), of its weight, and of a unit vector; documents that are worked on at once.
_LEVELS, _WEIGHTS, _ONE, _ROWS = 16, 256, 1 << 20, 1024
#: Most tasks whose sums the driver adds up itself.
_PARTS = 64


class WordCells(dict):
    """word -> its number of tokens, and in the low 16 bits its place in the vector."""

    def __init__(self, encoder: tokens.Encoder) -> None:
        super().__init__()
        self._encoder = encoder

    def __missing__(self, word: str) -> int:
        cell = len(self._encoder.encode(word)) << 16 | xxhash.xxh3_64_intdigest(word.strip().lower().encode("utf-8", "surrogatepass")) % DIMENSIONS
        if len(word) <= tokens.WORD_CHARS:
            if len(self) >= tokens.MEMO_ENTRIES:
                self.clear()
            self[word] = cell
        return cell


class Reader:
    """Tokens and levels of one text after another."""

    def __init__(self, folder: str) -> None:
        encoder = tokens.encoder(folder)
        self._split, self._get = encoder.split, WordCells(encoder).__getitem__

    def read(self, text: str | None) -> tuple[int, bytes]:
        words = self._split(text) if text else []
        cells = np.fromiter(map(self._get, words), np.int64, len(words))
        # 255 is the level of eight million words of one place
        levels = np.minimum(np.rint(np.log1p(np.bincount(cells & 0xFFFF, minlength=DIMENSIONS)) * _LEVELS), 255)
        return int((cells >> 16).sum()), levels.astype(np.uint8).tobytes()


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, DIMENSIONS)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of whole numbers -> the same of length ``_ONE``, in whole numbers."""
    return np.rint(x * (_ONE / np.maximum(np.sqrt((x * x).sum(axis=-1, keepdims=True)), 1)))


class Model:
    """Weights of the places, and the centres of each language."""

    def __init__(self, weights: np.ndarray, centres: dict[str, np.ndarray]) -> None:
        self.weights, self.centres = weights, centres

    def likeness(self, lang: str, levels: np.ndarray) -> np.ndarray:
        return _unit(levels * self.weights) @ self.centres[lang].T

    def topics(self, langs: np.ndarray, levels: np.ndarray) -> np.ndarray:
        out = np.zeros(len(langs), np.int64)
        for k in range(0, len(langs), _ROWS):
            own = langs[k : k + _ROWS]
            for lang in set(own.tolist()) & self.centres.keys():
                at = k + np.flatnonzero(own == lang)
                out[at] = np.argmax(self.likeness(lang, levels[at]), axis=1)
        return out


_Part = tuple[int, np.ndarray]


def _folded(vectors: DataFrame, fold: Callable[[str, np.ndarray], Iterable[tuple[int, _Part]]], merge: Callable[[_Part, _Part], _Part], kind: type) -> dict[str, dict[int, _Part]]:
    """Parts of every language's documents that have words, merged: language -> number of the part -> (whole number, array of ``kind``)."""
    schema = "lang string, part int, n bigint, data binary"

    def add(held: dict, key: tuple[str, int], x: _Part) -> None:
        held[key] = merge(held[key], x) if key in held else x

    def sent(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int32()), pa.array([int(n) for n, _ in held.values()], pa.int64()), pa.array([x.tobytes() for _, x in held.values()], pa.binary())], names=["lang", "part", "n", "data"])

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            langs, levels = b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1))
            there = np.flatnonzero(levels.any(axis=1))
            for k in range(0, len(there), _ROWS):
                at = there[k : k + _ROWS]
                for lang in sorted(set(langs[at].tolist())):
                    for part, x in fold(lang, levels[at[langs[at] == lang]]):
                        add(held, (lang, part), x)
        if held:
            yield sent(held)

    def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for lang, part, n, data in zip(*(c.to_pylist() for c in b.columns)):
                add(held, (lang, part), (n, np.frombuffer(data, kind)))
        if held:
            yield sent(held)

    parts = vectors.select("lang", "vector").mapInArrow(partial, schema)
    if vectors.rdd.getNumPartitions() > _PARTS:
        parts = parts.repartition(8, "lang", "part").mapInArrow(again, schema)
    held: dict = {}
    for r in parts.collect():  # one row a language and topic, of few tasks
        add(held, (r.lang, r.part), (r.n, np.frombuffer(bytes(r.data), kind)))
    out: dict[str, dict[int, _Part]] = {}
    for (lang, part), x in held.items():
        out.setdefault(lang, {})[part] = x
    return out


def _plus(a: _Part, b: _Part) -> _Part:
    return a[0] + b[0], a[1] + b[1]


def _least(a: _Part, b: _Part) -> _Part:
    return min(a, b, key=lambda x: (x[0], x[1].tobytes()))


def _cluster(vectors: DataFrame, model: Model, langs: list[str], k: int, rounds: int) -> dict[str, np.ndarray]:
    """Centres by cosine: the first is the vector most like the mean, each further first one that least like those before."""

    def own(centres: dict[str, np.ndarray]) -> Callable:
        now = Model(model.weights, centres)

        def fold(lang: str, levels: np.ndarray) -> Iterator[tuple[int, _Part]]:
            if lang in langs:
                x = _unit(levels * now.weights)
                at = np.argmax(x @ centres[lang].T, axis=1) if centres else np.zeros(len(x), np.int64)
                for j in np.unique(at).tolist():
                    yield j, (int((at == j).sum()), x[at == j].sum(axis=0).astype(np.int64))

        return fold

    def first(centres: dict[str, np.ndarray], sign: int) -> Callable:
        now = Model(model.weights, centres)

        def fold(lang: str, levels: np.ndarray) -> Iterator[tuple[int, _Part]]:
            if lang in langs:
                score = sign * now.likeness(lang, levels).max(axis=1)
                least = levels[score == score.min()]
                yield 0, (int(score.min()), least[np.lexsort(least.T[::-1])[0]])

        return fold

    if not langs:
        return {}
    means = {lang: _unit(x[0][1].astype(np.float64)[None]) for lang, x in _folded(vectors, own({}), _plus, np.int64).items()}
    vector = lambda levels: _unit(levels[None] * model.weights)
    centres = {lang: vector(x[0][1]) for lang, x in _folded(vectors, first(means, -1), _least, np.uint8).items()}
    while len(centres[langs[0]]) < k:
        centres = {lang: np.concatenate([centres[lang], vector(x[0][1])]) for lang, x in _folded(vectors, first(centres, 1), _least, np.uint8).items()}
    for _ in range(rounds):
        sums = _folded(vectors, own(centres), _plus, np.int64)
        before, centres = centres, {lang: np.concatenate([_unit(sums[lang][j][1].astype(np.float64)[None]) if j in sums[lang] else c[j : j + 1] for j in range(k)]) for lang, c in centres.items()}
        if all((before[lang] == centres[lang]).all() for lang in langs):
            break
    return centres


def fit(vectors: DataFrame, topics: int = TOPICS, rounds: int = ROUNDS) -> Model:
    """(lang, vector) of all documents, which is read again for every pass -> the model."""
    counts = _folded(vectors, lambda lang, levels: [(0, (len(levels), (levels > 0).sum(axis=0, dtype=np.int64)))], _plus, np.int64)
    there, having = sum(x[0][0] for x in counts.values()), sum((x[0][1] for x in counts.values()), np.zeros(DIMENSIONS, np.int64))
    model = Model(np.rint(np.log((1 + there) / (1 + having)) * _WEIGHTS), {})
    langs = sorted(lang for lang, x in counts.items() if x[0][0] >= LEAST)
    return Model(model.weights, _cluster(vectors, model, langs, topics, rounds))
