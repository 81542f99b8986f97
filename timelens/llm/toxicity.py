"""Toxicity of whole texts by a small bidirectional gated recurrent network.

A text's words (digits, letters and non-ASCII characters, A-Z lowered) are read in
overlapping windows. A word enters as a learned vector of its own and the mean of
learned vectors of its character 5-grams (bytes, with a mark for the word's begin),
each with a prior: the shrunken log odds of label 1 among training documents that
hold it. A gated recurrent unit runs over the window in both directions, attention
pools its states, and a logistic unit scores the pool. A text's score is that of its
highest window. The network is trained here, in numpy, on the window of each
training document that scores highest so far.

Training reads a bounded sample: `sample_rows` labelled documents at most, half of
each label, those with the smallest hash of their id. Priors of one half of the
sample are used to train on the other half, so that the network learns how far to
trust them. Scoring sends the trained arrays to the tasks; their size follows the
sample, not the corpus. Nothing else is gathered or shuffled.

Defined results: without words, the score is the share of label 1 in the sample. So
it is for all texts if the sample lacks one of the labels (0 without labels). A
document with several labels counts as 1 if one of them is; NULL labels and labels
without document are left out. Result columns replace columns of the same name;
other columns, and repeated rows, are kept.
"""

from __future__ import annotations

import os
import traceback
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timelens.llm.words import ALPHANUMERIC, LOWER, find_words, text_slices

WINDOW, STRIDE = 48, 32
HIDDEN, VECTOR = 8, 8
SAMPLE_ROWS = 3000
EPOCHS, LEAST_STEPS, BATCH, RATE = 6, 400, 64, 0.02
LEAST_ROWS = 3
"""Documents of the sample a word or gram must be in to get a vector."""


class Vocabulary(NamedTuple):
    keys: np.ndarray     # sorted
    priors: np.ndarray   # entry 0 is for unknown terms, entry k+1 for keys[k]

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, place + 1, 0)


class Model(NamedTuple):
    words: Vocabulary
    grams: Vocabulary
    weights: dict[str, np.ndarray]
    base_rate: float


class Terms(NamedTuple):
    """The words of a slice: for each its row and distinct word; the grams of the distinct words."""
    rows: np.ndarray
    which: np.ndarray
    hashes: np.ndarray
    gram_words: np.ndarray
    grams: np.ndarray


def _codes(low: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """`n` bytes from each place as one number."""
    code = np.zeros(len(at), np.int64)
    for k in range(n):
        code = code << 8 | low[at + k]
    return code


def read_terms(data: np.ndarray, offsets: np.ndarray) -> Terms:
    found = find_words(data, offsets, ALPHANUMERIC)
    hashes, first, which = np.unique(found.hashes, return_index=True, return_inverse=True)
    low, starts = LOWER[data], found.starts[first]
    sizes = found.ends[first] - starts
    words, grams = [], []
    begun = np.flatnonzero(sizes >= 4)
    words.append(begun)
    grams.append(_codes(low, starts[begun], 4) | 1 << 32)
    for n in (1, 2, 3):
        short = np.flatnonzero(sizes == n)
        words.append(short)
        grams.append(_codes(low, starts[short], n) | 1 << 33 | n << 34)
    inner = np.maximum(sizes - 4, 0)
    of = np.repeat(np.arange(len(sizes)), inner)
    step = np.arange(len(of)) - np.repeat(np.cumsum(inner) - inner, inner)
    words.append(of)
    grams.append(_codes(low, starts[of] + step, 5) | 1 << 40)
    gram_words = np.concatenate(words)
    order = np.argsort(gram_words, kind="stable")
    return Terms(found.rows, which.ravel(), hashes, gram_words[order], np.concatenate(grams)[order])


def _windows(rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, first word) of all windows; the last one of a row ends with its last word."""
    firsts = np.searchsorted(rows, np.arange(n_rows + 1))
    sizes = np.diff(firsts)
    counts = np.where(sizes > 0, 1 + -(-np.maximum(sizes - WINDOW, 0) // STRIDE), 0)
    of = np.repeat(np.arange(n_rows), counts)
    step = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    latest = np.maximum(sizes[of] - WINDOW, 0)
    return of, firsts[of] + np.minimum(step * STRIDE, latest)


def _inputs(terms: Terms, words: Vocabulary, grams: Vocabulary, weights: dict[str, np.ndarray]) -> np.ndarray:
    """The input of every distinct word; the row behind the last is the padding."""
    n = len(terms.hashes)
    ids, gram_ids = words.find(terms.hashes), grams.find(terms.grams)
    out = np.zeros((n + 1, 2 * VECTOR + 3), np.float32)
    out[:n, :VECTOR] = weights["words"][ids]
    out[:n, -3], out[:n, -1] = words.priors[ids], 1
    if n:
        starts = np.searchsorted(terms.gram_words, np.arange(n))
        counts = np.diff(np.append(starts, len(gram_ids)))[:, None]
        out[:n, VECTOR:2 * VECTOR] = np.add.reduceat(weights["grams"][gram_ids], starts) / counts
        out[:n, -2] = np.maximum.reduceat(grams.priors[gram_ids], starts)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(projected: np.ndarray, ids: np.ndarray, mask: np.ndarray, recur: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States [time, window, hidden] of one direction; `projected` holds W x of every distinct word."""
    h = np.zeros((ids.shape[1], HIDDEN), np.float32)
    out = np.empty((*ids.shape, HIDDEN), np.float32)
    for t in range(len(ids)):
        x = projected[ids[t]]
        gates = _sigmoid(x[:, :2 * HIDDEN] + h @ recur[:, :2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(x[:, 2 * HIDDEN:] + (r * h) @ recur[:, 2 * HIDDEN:])
        z = z * mask[t][:, None]
        if keep is not None:
            keep.append((h, z, r, new))
        h = h + z * (new - h)
        out[t] = h
    return out


def _forward(inputs: np.ndarray, ids: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], keep: dict | None = None) -> np.ndarray:
    """The logit of every window; ids [time, window] into the distinct words."""
    k = keep if keep is not None else {}
    k["ahead"], k["back"] = ([], []) if keep is not None else (None, None)
    states = np.concatenate([
        _run(inputs @ w["ahead_in"], ids, mask, w["ahead"], k["ahead"]),
        _run(inputs @ w["back_in"], ids[::-1], mask[::-1], w["back"], k["back"])[::-1]], 2)
    drawn = np.tanh(states @ w["attend"] + w["attend_at"])
    weight = np.where(mask > 0, drawn @ w["attend_to"], np.float32(-1e9))
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    pooled = np.einsum("tb,tbh->bh", weight, states)
    if keep is not None:
        keep |= {"states": states, "drawn": drawn, "weight": weight, "pooled": pooled}
    return pooled @ w["out"] + w["bias"]


def _back_run(d_out: np.ndarray, kept: list, recur: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs [time, window, 3 hidden] and of `recur`."""
    d_x = np.empty((*d_out.shape[:2], 3 * HIDDEN), np.float32)
    d_recur = np.zeros_like(recur)
    d_h = np.zeros(d_out.shape[1:], np.float32)
    for t in range(len(d_out) - 1, -1, -1):
        h, z, r, new = kept[t]
        d_h = d_h + d_out[t]
        d_new = d_h * z * (1 - new * new)
        d_z = d_h * (new - h) * z * (1 - z)
        d_rh = d_new @ recur[:, 2 * HIDDEN:].T
        d_r = d_rh * h * r * (1 - r)
        gates = np.concatenate([d_z, d_r], 1)
        d_x[t, :, :2 * HIDDEN], d_x[t, :, 2 * HIDDEN:] = gates, d_new
        d_recur[:, :2 * HIDDEN] += h.T @ gates
        d_recur[:, 2 * HIDDEN:] += (r * h).T @ d_new
        d_h = d_h * (1 - z) + d_rh * r + gates @ recur[:, :2 * HIDDEN].T
    return d_x, d_recur


def _gradients(inputs: np.ndarray, ids: np.ndarray, mask: np.ndarray, labels: np.ndarray, w: dict[str, np.ndarray]):
    """Of the mean log loss: by weight, and of the inputs of the distinct words."""
    keep: dict = {}
    logits = _forward(inputs, ids, mask, w, keep)
    d_logit = ((_sigmoid(logits) - labels) / len(labels)).astype(np.float32)
    g = {"out": keep["pooled"].T @ d_logit, "bias": d_logit.sum()}
    d_pooled = d_logit[:, None] * w["out"]
    d_weight = np.einsum("bh,tbh->tb", d_pooled, keep["states"])
    weight = keep["weight"]
    d_drawn_to = weight * (d_weight - (weight * d_weight).sum(0))
    g["attend_to"] = np.einsum("tb,tba->a", d_drawn_to, keep["drawn"])
    d_drawn = d_drawn_to[:, :, None] * w["attend_to"] * (1 - keep["drawn"] ** 2)
    g["attend"] = np.einsum("tbh,tba->ha", keep["states"], d_drawn)
    g["attend_at"] = d_drawn.sum((0, 1))
    d_states = weight[:, :, None] * d_pooled + d_drawn @ w["attend"].T
    d_inputs = np.zeros_like(inputs)
    for name, part, turn in (("ahead", d_states[:, :, :HIDDEN], 1), ("back", d_states[:, :, HIDDEN:], -1)):
        d_x, g[name] = _back_run(part[::turn], keep[name], w[name])
        flat = np.zeros((len(inputs), 3 * HIDDEN), np.float32)
        np.add.at(flat, ids[::turn].ravel(), d_x.reshape(-1, 3 * HIDDEN))
        g[f"{name}_in"] = inputs.T @ flat
        d_inputs += flat @ w[f"{name}_in"].T
    return g, d_inputs


def _start_weights(n_words: int, n_grams: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    inputs = 2 * VECTOR + 3
    shapes = {
        "words": (n_words, VECTOR), "grams": (n_grams, VECTOR),
        "ahead_in": (inputs, 3 * HIDDEN), "back_in": (inputs, 3 * HIDDEN),
        "ahead": (HIDDEN, 3 * HIDDEN), "back": (HIDDEN, 3 * HIDDEN),
        "attend": (2 * HIDDEN, HIDDEN), "attend_at": (HIDDEN,), "attend_to": (HIDDEN,),
        "out": (2 * HIDDEN,), "bias": (),
    }
    out = {k: np.asarray(rng.normal(0, 0.3 / np.sqrt(max(1, s[0] if len(s) == 2 and k not in ("words", "grams") else 1)),
                                    s), np.float32) for k, s in shapes.items()}
    out["words"] *= 0.1
    out["grams"] *= 0.1
    out["words"][0] = out["grams"][0] = 0
    return out


def _vocabulary(rows: np.ndarray, keys: np.ndarray, labels: np.ndarray, of: np.ndarray) -> Vocabulary:
    """Terms of at least LEAST_ROWS rows; priors by the rows marked in `of`."""
    pairs = np.unique(np.stack([keys.view(np.int64), rows], 1), axis=0)
    terms, which, counts = np.unique(pairs[:, 0], return_inverse=True, return_counts=True)
    which = which.ravel()
    kept = counts >= LEAST_ROWS
    used = of[pairs[:, 1]]
    is_one = labels[pairs[:, 1]] > 0
    ones = np.bincount(which[used & is_one], minlength=len(terms))
    all_ = np.bincount(which[used], minlength=len(terms))
    n_one = max(1, int((labels[of] > 0).sum()))
    n_zero = max(1, int((labels[of] == 0).sum()))
    odds = np.log((ones + 0.5) / (n_one + 1)) - np.log((all_ - ones + 0.5) / (n_zero + 1))
    priors = np.clip(odds * all_ / (all_ + 2), -4, 4) / 2
    order = np.argsort(terms[kept].view(keys.dtype))
    return Vocabulary(terms[kept].view(keys.dtype)[order],
                      np.concatenate([[0], priors[kept][order]]).astype(np.float32))


def train(texts: list[str], labels: np.ndarray, seed: int = 8) -> Model:
    """The network trained on whole texts and their 0/1 labels."""
    labels = np.asarray(labels, np.float32)
    rate = float(labels.mean()) if len(labels) else 0.0
    nothing = Vocabulary(np.zeros(0, np.uint64), np.zeros(1, np.float32))
    if not 0 < rate < 1:
        return Model(nothing, Vocabulary(np.zeros(0, np.int64), np.zeros(1, np.float32)), {}, rate)
    slices = [(low, read_terms(data, offsets), high - low)
              for low, high, data, offsets in text_slices(pa.array(texts, pa.large_string()))]
    word_rows = np.concatenate([t.rows + low for low, t, _ in slices])
    word_keys = np.concatenate([t.hashes[t.which] for _, t, _ in slices])
    gram_rows, gram_keys = [], []
    for low, t, _ in slices:
        # the grams of every word in every row that holds it
        pairs = np.unique(np.stack([t.rows, t.which], 1), axis=0)
        starts = np.searchsorted(t.gram_words, pairs[:, 1])
        counts = np.searchsorted(t.gram_words, pairs[:, 1], "right") - starts
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        gram_rows.append(np.repeat(pairs[:, 0] + low, counts))
        gram_keys.append(t.grams[np.repeat(starts, counts) + step])
    gram_rows, gram_keys = np.concatenate(gram_rows), np.concatenate(gram_keys)
    half = np.zeros(len(labels), bool)
    for label in (0, 1):
        half[np.flatnonzero(labels == label)[::2]] = True
    both = [[_vocabulary(r, k, labels, of) for r, k in ((word_rows, word_keys), (gram_rows, gram_keys))]
            for of in (~half, half, np.ones(len(labels), bool))]
    weights = _start_weights(len(both[2][0].priors), len(both[2][1].priors), seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    rng, step = np.random.default_rng(seed), 0
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(labels)))
    for epoch in range(epochs):
        early = epoch < epochs // 3
        chosen = []  # the highest window of every row: slice, first word, row
        for s, (low, t, n) in enumerate(slices):
            of, first = _windows(t.rows, n)
            scores = np.empty(len(of), np.float32)
            for fold in (True, False):
                mine = half[of + low] == fold
                vocabularies = both[0] if fold else both[1]
                scores[mine] = _score(t, first[mine], vocabularies[0], vocabularies[1], weights)
            order = np.lexsort((-scores, of))
            top = order[np.searchsorted(of[order], np.unique(of))]
            chosen += [(s, int(first[i]), int(of[i]) + low) for i in top]
        rng.shuffle(chosen)
        # a batch is of one slice and fold, so that it shares its inputs
        by: dict[tuple, list] = {}
        for s, first, row in chosen:
            by.setdefault((s, bool(half[row])), []).append((first, row))
        batches = [(k, v[i:i + BATCH]) for k, v in by.items() for i in range(0, len(v), BATCH)]
        rng.shuffle(batches)
        for (s, fold), rows in batches:
            t, (words, grams) = slices[s][1], both[0] if fold else both[1]
            ids, mask = _window_ids(t, np.array([r[0] for r in rows]))
            used, local = np.unique(ids, return_inverse=True)
            used = used[used < len(t.hashes)]
            part, ids = _some(t, used), np.where(ids < len(t.hashes), np.searchsorted(used, ids), len(used))
            inputs = _inputs(part, words, grams, weights)
            if early:  # by the priors alone, which new documents share
                inputs[:, :2 * VECTOR] = 0
            g, d_inputs = _gradients(inputs, ids, mask, labels[[r[1] for r in rows]], weights)
            word_ids, gram_ids = words.find(part.hashes), grams.find(part.grams)
            if not early:
                g["words"], g["grams"] = np.zeros_like(weights["words"]), np.zeros_like(weights["grams"])
                np.add.at(g["words"], word_ids, d_inputs[:-1, :VECTOR])
                counts = np.bincount(part.gram_words, minlength=len(used))
                np.add.at(g["grams"], gram_ids, d_inputs[part.gram_words, VECTOR:2 * VECTOR] / counts[part.gram_words, None])
                g["words"][0] = g["grams"][0] = 0
            step += 1
            for k, grad in g.items():
                grad = np.clip(grad, -1, 1)
                m, v = moments[k]
                m = 0.9 * m + 0.1 * grad
                v = 0.99 * v + 0.01 * grad * grad
                moments[k] = (m, v)
                weights[k] = (weights[k] - RATE * (1 - epoch / epochs) * (m / (1 - 0.9 ** step)) /
                              (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return Model(both[2][0], both[2][1], weights, rate)


def _some(t: Terms, used: np.ndarray) -> Terms:
    """Only the distinct words `used` (sorted), numbered anew."""
    kept = np.isin(t.gram_words, used)
    none = np.zeros(0, np.int64)
    return Terms(none, none, t.hashes[used], np.searchsorted(used, t.gram_words[kept]), t.grams[kept])


def _window_ids(t: Terms, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words [time, window] and the mask of places inside the window's row."""
    at = first[None, :] + np.arange(WINDOW)[:, None]
    inside = at < len(t.rows)
    at = np.minimum(at, len(t.rows) - 1)
    inside &= t.rows[at] == t.rows[first][None, :]
    return np.where(inside, t.which[at], len(t.hashes)), inside.astype(np.float32)


def _score(t: Terms, first: np.ndarray, words: Vocabulary, grams: Vocabulary, weights: dict[str, np.ndarray]) -> np.ndarray:
    inputs = _inputs(t, words, grams, weights)
    out = np.empty(len(first), np.float32)
    for k in range(0, len(first), 2048):
        ids, mask = _window_ids(t, first[k:k + 2048])
        out[k:k + 2048] = _forward(inputs, ids, mask, weights)
    return out


def score_texts(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, number of windows, first word of the highest window) of every text."""
    n = len(texts)
    scores, counts, tops = np.full(n, model.base_rate), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for low, high, data, offsets in text_slices(texts):
        t = read_terms(data, offsets)
        of, first = _windows(t.rows, high - low)
        counts[low:high] = np.bincount(of, minlength=high - low)
        if not len(of) or not model.weights:
            continue
        logits = _score(t, first, model.words, model.grams, model.weights)
        order = np.lexsort((first, -logits, of))
        rows, at = np.unique(of[order], return_index=True)
        best = order[at]
        scores[rows + low] = _sigmoid(logits[best].astype(np.float64))
        tops[rows + low] = first[best] - np.searchsorted(t.rows, rows)
    return scores, counts, tops


def in_fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n, is 0."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % n == 0, F.lit(False))


def train_on(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Trained on the labelled documents that are not held out, at most `sample_rows` of them."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~in_fold("doc_id", 5))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    key = F.xxhash64("doc_id")
    sample = known.where("toxic = 1").orderBy(key, "doc_id").limit(sample_rows // 2).unionAll(
        known.where("toxic = 0").orderBy(key, "doc_id").limit(sample_rows // 2))
    # `sample_rows` rows of two numbers
    rows = (documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            .join(F.broadcast(sample), "doc_id").repartition(1))
    found = rows.mapInArrow(_train_rows, "name string, kind string, shape array<long>, held binary").toArrow().to_pylist()
    return _unpack_model(found) if found else train([], np.zeros(0, np.float32))


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The arrays of the model trained on all rows, in a task so that the driver needs no memory for it.

    It trains in a process of its own: a Python worker goes on to other tasks and would keep the memory.
    """
    rows = [r for batch in batches for r in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True)]
    rows.sort()
    end, begin = os.pipe()
    child = os.fork()
    if not child:
        failed = True
        try:
            batch = _pack_model(train([text for _, text, _ in rows], np.array([toxic for *_, toxic in rows], np.float32)))
            with os.fdopen(begin, "wb") as sink, pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            failed = False
        except BaseException:
            traceback.print_exc()
        finally:
            os._exit(failed)
    os.close(begin)
    with os.fdopen(end, "rb") as source:
        held = source.read()
    if os.waitpid(child, 0)[1]:
        raise RuntimeError("training failed, see the executor's log")
    yield from pa.ipc.open_stream(held)


def _pack_model(model: Model) -> pa.RecordBatch:
    arrays = {f"{which}.{k}": v for which in ("words", "grams") for k, v in getattr(model, which)._asdict().items()}
    arrays |= {f"weights.{k}": v for k, v in model.weights.items()} | {"base_rate": np.array(model.base_rate)}
    return pa.RecordBatch.from_pydict({
        "name": pa.array(list(arrays), pa.string()), "kind": pa.array([v.dtype.str for v in arrays.values()], pa.string()),
        "shape": pa.array([list(v.shape) for v in arrays.values()], pa.list_(pa.int64())),
        "held": pa.array([v.tobytes() for v in arrays.values()], pa.binary())})


def _unpack_model(rows: list[dict]) -> Model:
    arrays = {r["name"]: np.frombuffer(r["held"], r["kind"]).reshape(r["shape"]) for r in rows}
    words, grams = (Vocabulary(*(arrays[f"{which}.{k}"] for k in Vocabulary._fields)) for which in ("words", "grams"))
    weights = {k.removeprefix("weights."): v for k, v in arrays.items() if k.startswith("weights.")}
    return Model(words, grams, weights, float(arrays["base_rate"]))


RESULT = {"toxicity": T.DoubleType(), "n_windows": T.LongType(), "top_word": T.LongType()}


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """The documents with toxicity (0 to 1), n_windows, and the first word of the highest window."""
    kept = documents.select(*[c for c in documents.columns if c not in RESULT]).withColumn("text", F.col("text").cast("string"))
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score_texts(sent.value, batch.column("text"))
            columns = [*batch.columns, *(pa.array(x) for x in found)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *RESULT])

    return kept.mapInArrow(score, T.StructType([*kept.schema.fields, *(T.StructField(k, v) for k, v in RESULT.items())]))
