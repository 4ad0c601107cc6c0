"""Toxicity by compression distance.

1. Two zstandard dictionaries are trained on whole labelled texts. The ordinary
   one is the library's own training on ordinary texts. The toxic one is trained
   likewise, by covering, but with the ordinary texts as background: a run of
   ``GRAM`` bytes weighs the toxic texts that have it, less ``BACKGROUND`` times
   those that its share in ordinary texts would give, less ``LEAST``; segments of
   ``SEGMENT`` bytes that cover most weight are taken, each run counting once.
2. A window is ``words`` words of a text, followed by a fixed carrier that both
   dictionaries hold (the compressor looks for no matches in its last bytes).
   Its length is compressed with the ordinary dictionary, and with the ordinary
   followed by the toxic one; the distance is the first less the second, each
   less that of an empty window.
3. A text's score is a logistic calibration of how many of its windows, and what
   share, reach each of ``DISTANCES``. It is fitted on distances from
   dictionaries that were trained without the text, in ``FOLDS`` parts.

Fitting takes a bounded sample of labelled rows (``FITTED_ROWS``) to the driver;
scoring is a map over whole texts without a shuffle, in pieces of a long text.
Distances of windows are kept per task, for ``KEPT`` windows at most.

Null and empty texts have no windows and get the calibrated score of none. With
no labels, or one class only, every score is that class's share; with too few
texts to train on, the texts are the dictionary. An id that is labelled more
than once takes its greatest label. Repeated rows and ties score alike; an empty
table gives an empty result. Only the text is an input of the score; a column
named like an added one is replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstrata.llm import hashing
from logstrata.llm.arrow import with_columns
from logstrata.llm.logistic import Logistic
from logstrata.llm.sampling import labelled, trimmed

THRESHOLD = 0.3
CARRIER = bytes(range(128, 192))
EDGES = bytes(c for c in range(33, 127) if not chr(c).isalnum())
DISTANCES = (2, 3, 4)
FITTED_ROWS = 8_000
FOLDS = 4
KEPT = 150_000
DICTIONARY = 8192
GRAM, SEGMENT = 6, 16
BACKGROUND, LEAST = 3, 4


def words(text: bytes):
    """Lower-cased words without signs at their edges."""
    for piece in hashing._pieces(text):
        for word in piece.lower().split():
            if word := word.strip(EDGES):
                yield word


def plain(text: bytes) -> bytes:
    return b" " + b" ".join(words(text)) + b" "


def _grams(text: bytes):
    """The runs of GRAM bytes of a text as numbers."""
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(raw) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        out = (out << np.uint64(8)) | raw[i : i + len(out)]
    return out


def _counted(texts: list[bytes]):
    """(runs, in how many texts each is), merged by some texts at a time."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for i in range(0, len(texts), 256):
        found, times = np.unique(np.concatenate([hashing.distinct(_grams(x)) for x in texts[i : i + 256]]), return_counts=True)
        keys, places = np.unique(np.concatenate((keys, found)), return_inverse=True)
        counts = np.bincount(places, weights=np.concatenate((counts, times)), minlength=len(keys)).astype(np.int64)
    return keys, counts


def covering(texts: list[bytes], background: list[bytes], size: int = DICTIONARY) -> bytes:
    """Segments of ``texts`` that cover what is more frequent there than in ``background``; the heaviest of each text in turn, ``size`` bytes at most."""
    keys, counts = _counted(texts)
    keys, counts = keys[counts > LEAST], counts[counts > LEAST]
    if not len(keys):
        return b""
    behind = np.zeros(len(keys), np.int64)
    for text in background:
        found = hashing.distinct(_grams(text))
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        behind[at[keys[at] == found]] += 1
    weights = np.append(np.maximum(0.0, counts - BACKGROUND * (behind + 1) * len(texts) / max(1, len(background)) - LEAST), 0.0)
    places = []
    for text in texts:
        found = _grams(text)
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        places.append(np.where(keys[at] == found, at, len(keys)).astype(np.int32))
    taken, held, open_, span = [], 0, range(len(texts)), SEGMENT - GRAM + 1
    while open_ and held < size:
        left = []
        for i in open_:
            mine = weights[places[i]]
            if held >= size or not mine.any():
                continue
            sums = np.concatenate(([0.0], np.cumsum(mine)))
            starts = np.arange(max(1, len(mine) - span + 1))
            begin = int((sums[np.minimum(starts + span, len(mine))] - sums[starts]).argmax())
            covers = begin + np.flatnonzero(mine[begin : begin + span])
            weights[places[i][covers[0] : covers[-1] + 1]] = 0
            taken.append(texts[i][covers[0] : covers[-1] + GRAM])
            held += len(taken[-1])
            left.append(i)
        open_ = left
    return b"".join(reversed(taken))  # the heaviest last, where a match is cheapest


def trained(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary's bytes; samples that are too few to train on are the dictionary themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)


class Distance:
    """The distance of a window by one pair of dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard

        size = len(ordinary) + len(toxic) + len(CARRIER)
        params = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_LAZY2, min_match=5, hash_log=16, chain_log=16, search_log=6, window_log=max(18, size.bit_length() + 1), write_content_size=0, write_checksum=0, write_dict_id=0)
        made = []
        for content in (ordinary, ordinary + toxic):
            held = zstandard.ZstdCompressionDict(content + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            made.append(zstandard.ZstdCompressor(dict_data=held, compression_params=params))
        self._made, self._kept = made, {}
        self._empty = self._raw(b"")

    def _raw(self, window: bytes) -> int:
        window = b" " + window + b" " + CARRIER
        return len(self._made[0].compress(window)) - len(self._made[1].compress(window))

    def __call__(self, window: bytes) -> int:
        found = self._kept.get(window)
        if found is None:
            if len(self._kept) >= KEPT:
                self._kept.clear()
            found = self._kept[window] = self._raw(window) - self._empty
        return found


def windows(text: bytes, size: int):
    """Windows of ``size`` words, one behind the other; the last may have fewer."""
    if size == 1:
        yield from words(text)
        return
    held = []
    for word in words(text):
        held.append(word)
        if len(held) == size:
            yield b" ".join(held)
            held = []
    if held:
        yield b" ".join(held)


class Model:
    def __init__(self, texts: list[bytes], marks: list[int], size: int = 1):
        self.share = sum(marks) / len(marks) if marks else 0.0
        self.size, self.calibrated = size, None
        if not 0 < self.share < 1:
            return
        plains = [plain(t) for t in texts]
        part = [zlib.crc32(t) % FOLDS for t in plains]  # copies share a part
        features = [None] * len(texts)
        for fold in range(FOLDS):
            rest = [i for i, p in enumerate(part) if p != fold]
            if len({marks[i] for i in rest}) < 2:
                rest = range(len(texts))
            distance = Distance(*self._dictionaries([plains[i] for i in rest], [marks[i] for i in rest]))
            for i, p in enumerate(part):
                if p == fold:
                    features[i] = self.features(texts[i], distance)
        self.calibrated = Logistic(features, marks)
        self.ordinary, self.toxic = self._dictionaries(plains, marks)

    @staticmethod
    def _dictionaries(plains: list[bytes], marks: list[int]) -> tuple[bytes, bytes]:
        sides = [[t for t, m in zip(plains, marks) if m == side] for side in (0, 1)]
        return trained(sides[0]), covering(sides[1], sides[0])

    def distances(self) -> Distance:
        return Distance(self.ordinary, self.toxic)

    def features(self, text: bytes, distance: Distance) -> list[float]:
        seen = Counter(map(distance, windows(text, self.size)))
        n = sum(seen.values())
        reach = [sum(c for d, c in seen.items() if d >= k) for k in DISTANCES]
        return [*np.log1p(reach), *[(100 * r / max(n, 1)) ** 0.5 for r in reach]]

    def score(self, texts: list[bytes], distance: Distance | None = None):
        if self.calibrated is None:
            return [self.share] * len(texts)
        if not texts:
            return []
        distance = distance or self.distances()
        return self.calibrated(np.array([self.features(t, distance) for t in texts])).tolist()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = FITTED_ROWS, size: int = 1) -> Model:
    model = Model(*labelled(docs, labels, label, most), size)
    trimmed()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1)."""
    made = []

    def make(batch):
        if not made:
            made.append(model.distances() if model.calibrated else None)
        return [model.score(hashing.texts_of(batch.column(text_col)), made[0])]

    return with_columns(docs, "score double", make)


def held_out(id_col: str = "doc_id"):
    """Rows kept from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
