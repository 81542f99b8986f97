"""Token counts of a unigram vocabulary, without the tokens.

An Aho-Corasick automaton over the bytes of all pieces enumerates, at every place of
a text, the pieces that end there, longest first; dynamic programming carries the
best score up to the place and the number of pieces behind it. Ties follow the
tokenizer: a later candidate must score strictly more, candidates come by ascending
start, and a character without a piece of its own may be unknown, at the least score
of the vocabulary less 10, tried last. An unknown character counts as its bytes.

A text is read as the vocabulary's library does: a space becomes the sign U+2581, and
one more is put in front of a text that is not empty. Where no piece holds that sign
behind another character, nor a line end, texts fall apart at those places: equal parts
of a slice of documents are counted once, many parts at a time. That takes scores that
are whole numbers, whose sums are exact, so that the parts' ties are those of the text.
With any other vocabulary, as of log probabilities, every text is one part.

Documents are not shuffled, and every task builds the automaton from the vocabulary
file; its size follows the vocabulary only.

Defined results: a NULL or empty text has no tokens and score 0. Result columns
replace columns of the same name; other columns, and repeated rows, are kept.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timelens.llm.words import hash_ranges, text_slices

SPACE = "▁"
_SPACE = np.frombuffer(SPACE.encode(), np.uint8)
UNKNOWN_PENALTY = 10.0
CELLS = 1 << 21
"""Places of parts that are worked on at once."""
LONG_PART = 512
LONG_TEXT = 1 << 15
"""Bytes from which on a text that does not fall apart is worked on alone."""


def read_vocabulary(path: str) -> dict[str, float]:
    """Pieces and scores of a model file, without its control and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i): float(model.get_score(i)) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


def falls_apart(vocabulary: dict[str, float]) -> bool:
    """Whether counting part by part gives what the whole text does."""
    return (not any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in vocabulary)
            and all(float(s).is_integer() for s in vocabulary.values()))


class Automaton:
    """Aho-Corasick over bytes; state 0 is the root. `whole` is for vocabularies whose texts do not fall apart."""

    def __init__(self, vocabulary: dict[str, float], whole: bool = False):
        if not whole and not falls_apart(vocabulary):
            raise ValueError("pieces must not go on behind a space or over a line end, and scores must be whole numbers")
        self.whole = whole
        children: list[dict[int, int]] = [{}]
        piece_at: list[tuple[int, float]] = [(0, 0.0)]
        for piece, score in vocabulary.items():
            state = 0
            data = piece.encode()
            for byte in data:
                at = children[state].get(byte)
                if at is None:
                    at = children[state][byte] = len(children)
                    children.append({})
                    piece_at.append((0, 0.0))
                state = at
            piece_at[state] = (len(data), score)
        n = len(children)
        self.go = np.zeros((n, 256), np.int32)
        self.length = np.array([p[0] for p in piece_at], np.int32)
        self.score = np.array([p[1] for p in piece_at])
        # the state of the longest piece that ends here, and of the next shorter one; 0 for none
        self.first, self.shorter = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.unknown = min(vocabulary.values(), default=0.0) - UNKNOWN_PENALTY
        fail = [0] * n
        waiting = deque()
        for byte, child in children[0].items():
            self.go[0, byte] = child
            waiting.append(child)
        while waiting:
            state = waiting.popleft()
            back = fail[state]
            self.shorter[state] = self.first[back]
            self.first[state] = state if self.length[state] else self.first[back]
            self.go[state] = self.go[back]
            for byte, child in children[state].items():
                fail[child] = self.go[back, byte]
                self.go[state, byte] = child
                waiting.append(child)


@lru_cache(1)
def automaton(path: str) -> Automaton:
    vocabulary = read_vocabulary(path)
    return Automaton(vocabulary, whole=not falls_apart(vocabulary))


def _count_long(auto: Automaton, part: np.ndarray) -> tuple[float, int]:
    best, counts = [0.0] + [-np.inf] * len(part), [0] * (len(part) + 1)
    state = begin = 0
    data = part.tolist()
    for t, byte in enumerate(data):
        if byte & 0xC0 != 0x80:
            begin = t
        state = int(auto.go[state, byte])
        at, top, pieces, own = int(auto.first[state]), -np.inf, 0, False
        while at:
            size = int(auto.length[at])
            here = best[t + 1 - size] + auto.score[at]
            own |= size == t + 1 - begin
            if here > top:
                top, pieces = here, counts[t + 1 - size] + 1
            at = int(auto.shorter[at])
        if not own and (t + 1 == len(data) or data[t + 1] & 0xC0 != 0x80):
            here = best[begin] + auto.unknown
            if here > top:
                top, pieces = here, counts[begin] + t + 1 - begin
        best[t + 1], counts[t + 1] = top, pieces
    return best[-1], counts[-1]


def count_parts(auto: Automaton, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best score and number of pieces of each part of `data`."""
    scores, counts = np.zeros(len(starts)), np.zeros(len(starts), np.int64)
    order = np.argsort(-sizes, kind="stable")
    n_long = int((sizes > (LONG_TEXT if auto.whole else LONG_PART)).sum())
    for i in order[:n_long].tolist():
        scores[i], counts[i] = _count_long(auto, data[starts[i]:starts[i] + sizes[i]])
    low = n_long
    while low < len(order):
        high = min(len(order), low + max(1, CELLS // max(1, int(sizes[order[low]]))))
        some = order[low:high]
        scores[some], counts[some] = _count_some(auto, data, starts[some], sizes[some])
        low = high
    return scores, counts


def _count_some(auto: Automaton, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for parts in the order of descending size."""
    n, longest = len(starts), int(sizes[0]) if len(sizes) else 0
    best, counts = np.full((longest + 1, n), -np.inf), np.zeros((longest + 1, n), np.int32)
    best[0] = 0
    state, begin = np.zeros(n, np.int32), np.zeros(n, np.int64)
    ends_at = n - np.searchsorted(sizes[::-1], np.arange(longest + 1), "right")  # parts longer than t
    flat_best, flat_counts = best.ravel(), counts.ravel()
    for t in range(longest):
        a = int(ends_at[t])
        byte = data[starts[:a] + t]
        begin[:a][byte & 0xC0 != 0x80] = t
        state = auto.go[state[:a], byte]
        top, pieces = np.full(a, -np.inf), np.zeros(a, np.int32)
        own = np.zeros(a, bool)
        at = auto.first[state]
        going = np.flatnonzero(at)
        at = at[going]
        while len(going):
            size = auto.length[at]
            places = (t + 1 - size) * n + going
            here = flat_best[places] + auto.score[at]
            own[going[size == t + 1 - begin[going]]] = True
            better = here > top[going]
            won = going[better]
            top[won], pieces[won] = here[better], flat_counts[places[better]] + 1
            at = auto.shorter[at]
            kept = at > 0
            going, at = going[kept], at[kept]
        maybe = np.flatnonzero(~own)
        if len(maybe):
            last = sizes[maybe] == t + 1
            behind = data[np.minimum(starts[maybe] + t + 1, len(data) - 1)]
            maybe = maybe[last | (behind & 0xC0 != 0x80)]
            places = begin[maybe] * n + maybe
            here = flat_best[places] + auto.unknown
            better = here > top[maybe]
            won = maybe[better]
            top[won], pieces[won] = here[better], flat_counts[places[better]] + (t + 1 - begin[won])
        best[t + 1, :a], counts[t + 1, :a] = top, pieces
    index = np.arange(n)
    return best[sizes, index], counts[sizes, index].astype(np.int64)


def parts_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with spaces written as the sign, and starts of all parts and of all rows in them."""
    n_rows = len(offsets) - 1
    filled = np.diff(offsets) > 0
    firsts = offsets[:-1][filled]
    spaced = np.insert(data, firsts, 32)
    is_space = spaced == 32
    width = np.where(is_space, 3, 1)
    at = np.concatenate([[0], np.cumsum(width)])
    out = np.empty(int(at[-1]), np.uint8)
    out[at[:-1][~is_space]] = spaced[~is_space]
    for k in range(3):
        out[at[:-1][is_space] + k] = _SPACE[k]
    rows = np.zeros(n_rows + 1, np.int64)
    rows[1:] = np.cumsum(np.where(filled, np.diff(offsets) + 1, 0))
    rows = at[rows]
    # a part begins with a run of signs, written or from spaces, with a line end, or behind one
    sign = np.zeros(len(out) + 3, bool)
    sign[3:-2] = (out[:-2] == _SPACE[0]) & (out[1:-1] == _SPACE[1]) & (out[2:] == _SPACE[2])
    starts = sign[3:] & ~sign[:-3]
    line = out == 10
    starts |= line
    starts[1:] |= line[:-1]
    starts[rows[:-1][filled]] = True
    return out, np.flatnonzero(starts), rows


def count_texts(auto: Automaton, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of tokens and score of each text."""
    counts, scores = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for low, high, data, offsets in text_slices(texts):
        out, starts, rows = parts_of(data, offsets)
        if auto.whole:
            starts = rows[:-1][np.diff(rows) > 0]
        if not len(starts):
            continue
        ends = np.append(starts[1:], len(out))
        _, first, which = np.unique(hash_ranges(out, starts, ends), return_index=True, return_inverse=True)
        part_scores, part_counts = count_parts(auto, out, starts[first], (ends - starts)[first])
        of = np.searchsorted(rows, starts, "right") - 1
        counts[low:high] = np.bincount(of, part_counts[which.ravel()], high - low).astype(np.int64)
        scores[low:high] = np.bincount(of, part_scores[which.ravel()], high - low)
    return counts, scores


RESULT = {"n_tokens": T.LongType(), "token_score": T.DoubleType()}


def count_tokens(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    """The documents with n_tokens and token_score, the score of their best segmentation."""
    kept = documents.select(*[c for c in documents.columns if c not in RESULT]).withColumn("text", F.col("text").cast("string"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(vocabulary_path)
        for batch in batches:
            found = count_texts(auto, batch.column(batch.schema.names.index("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in found)], [*batch.schema.names, *RESULT])

    return kept.mapInArrow(count, T.StructType([*kept.schema.fields, *(T.StructField(k, v) for k, v in RESULT.items())]))
