"""Operator 3: toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

Inputs for each word are learnt: an embedding of the word, and the maxima and means of the embeddings of its character
n-grams (anchored at its ends), so inflected and unseen forms of a stem count too. A run of letters, digits and
underscores longer than ``RUN`` characters is cut at underscores, and what is longer still into overlapping parts, each a
word of its own. A GRU reads every window of words forwards and another backwards, attention pools their states, and a
logistic unit scores the window. Windows overlap by half and cover the whole text; a text's score is that of its worst
window.

Learning: words and n-grams get an embedding if they tell the labels apart by their log odds, which is also where the
first dimension starts. The network is trained first, on windows whose embeddings come from other texts, then embeddings
and network together by back-propagation. Texts carry labels, windows don't: of a text labelled 1 the window with the
strongest evidence is a positive, unless that is none; of a text labelled 0 the ``CLEAN_WINDOWS`` strongest are negatives.
At most ``TRAIN_ROWS`` labelled texts of each label and of any length, first in hash order, are learnt from, on the
driver; of texts with one label that share their ``COPY_HASHES`` smallest hashes of three words only one is.

Defined results: null and empty texts hold no window and score 0.0; texts of any length are scored whole; equal texts
score alike (to five digits), so ties and repeated rows are harmless; an empty table gives an empty table; without a row of each label
every text scores 0.0; labels on rows that repeat an id count by their largest value. Columns other than the text are
never inputs of a score, and their names don't clash.
"""

from __future__ import annotations

import re
import zlib
from array import array
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, quoted, read_table, slices, text_or_empty, unused

#: Bound of the labelled sample: rows of each label.
TRAIN_ROWS = 2500
#: Labelled ids drawn for each row wanted, as some have no text.
DRAWN = 2
#: Windows of a text labelled 0 that are learnt from, and smallest hashes by which copies among the sample are known.
CLEAN_WINDOWS, COPY_HASHES = 8, 4
WINDOW, STRIDE = 32, 16
HIDDEN, ATTENTION = 6, 4
GRAMS = (4, 5, 6)
#: Dimensions of an embedding; a word's own, the maxima and the means of its n-grams', its length and a constant.
EMBEDDED = 4
INPUTS = 3 * EMBEDDED + 2
THRESHOLD = 0.7
#: Share of places at which a word's own embedding, or its n-grams' mean, is left out in training: each must tell alone.
LEFT_OUT = 0.4
#: Parts for cross-fitting, and the evidence below which the strongest window of a text labelled 1 isn't taken for toxic.
PARTS, LEAST_EVIDENCE = 4, 2.0
_RUNS = re.compile(r"\w+").findall
#: Characters of a word, and how many of them two parts of a longer run share: no n-gram is longer.
RUN, SHARED = 40, max(GRAMS)
#: Distinct words a worker keeps features of.
KEPT_WORDS = 200_000
#: What the CRC of zlib does with a byte: eight steps of its polynomial.
_CRC = np.arange(256, dtype="u4")
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))


def words_of(text: str) -> list[str]:
    """A text's words in lower case. Longer runs are cut at underscores, and pieces that are still longer into parts."""
    runs = _RUNS(text.lower())
    if max(map(len, runs), default=0) <= RUN:
        return runs
    out = []
    for run in runs:
        for piece in [run] if len(run) <= RUN else filter(None, run.split("_")):
            out.extend([piece] if len(piece) <= RUN else parts_of(piece))
    return out


def parts_of(run: str) -> list[str]:
    """Parts of a run, each sharing ``SHARED`` characters with the next; a zero character stands at a cut."""
    return [("\0" if at else "") + run[at : at + RUN] + ("\0" if at + RUN < len(run) else "") for at in range(0, len(run) - SHARED, RUN - SHARED)]


def grams(word: str) -> list[str]:
    marked = f"^{word}$".replace("^\0", "").replace("\0$", "")  # cuts are no ends of a word
    return [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]


def slots_of(word: str) -> list[int]:
    """A word's n-grams by their 32-bit hashes: smaller than texts, and hardly two of a sample's share one."""
    return [zlib.crc32(g.encode()) for g in grams(word)]


def slots_at_once(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The slots of many words one after another, each word's as ``slots_of`` gives them but for their order, and how many."""
    marked = [f"^{w}$".replace("^\0", "").replace("\0$", "") for w in words]
    data = np.frombuffer("".join(marked).encode() + bytes(4), "u1")
    starts = np.flatnonzero((data[:-4] & 0xC0) != 0x80)  # first bytes of characters
    sizes = np.diff(starts, append=len(data) - 4)
    n = np.fromiter(map(len, marked), "i8", len(marked))
    first = np.cumsum(n) - n
    left = np.repeat(first + n, n) - np.arange(len(starts))  # characters of the word from each one on
    state, found = np.full(len(starts), 0xFFFFFFFF, "u4"), []
    for k in range(max(GRAMS)):  # all n-grams take in their next character
        at = np.minimum(np.arange(k, len(starts) + k), len(starts) - 1)
        for b in range(int(sizes.max(initial=0))):
            new = _CRC[(state ^ data[starts[at] + b]) & 0xFF] ^ (state >> np.uint32(8))
            state = new if not b else np.where(b < sizes[at], new, state)
        if k + 1 in GRAMS:
            found.append(state ^ np.uint32(0xFFFFFFFF))
    whole = left[:, None] >= np.array(GRAMS)
    counts = np.add.reduceat(whole.sum(1), first) if len(words) else np.zeros(0, "i8")
    return np.stack(found, 1)[whole], counts


def evidence(clean: np.ndarray, toxic: np.ndarray, rows: np.ndarray, weakest: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Features that tell, and their smoothed log odds of label 1, from the numbers of texts that hold each feature.

    Smoothing grows with the texts labelled 1 up to 1000 of them: in a small sample few rows must tell.
    """
    strength = min(5.0, max(1.0, rows[1] / 200))
    least = min(5, max(2, rows[1] // 200))
    met = np.flatnonzero(np.maximum(clean, toxic) >= least)
    odds = np.log((toxic[met] + strength) / (rows[1] + 2 * strength)) - np.log((clean[met] + strength) / (rows[0] + 2 * strength))
    tells = np.abs(odds) >= weakest
    return met[tells], odds[tells]


class Embeddings:
    """Rows of numbers for words and n-grams that have one; row 0 stands for all others and stays zero."""

    def __init__(self, evidence: dict, seed: int = 5):
        known = sorted(evidence)
        self.row = dict(zip(known, range(1, len(known) + 1)))
        self.known = np.array(known, "u4") if known and isinstance(known[0], int) else np.zeros(0, "u4")
        self.table = (0.1 * np.random.default_rng(seed).normal(size=(len(known) + 1, EMBEDDED))).astype("f4")
        self.table[1:, 0] = [evidence[k] for k in known] if known else []
        self.table[0] = 0

    def rows_of(self, slots: np.ndarray) -> np.ndarray:
        """Rows of n-grams by their slots."""
        if not len(self.known):
            return np.zeros(len(slots), "i8")
        at = np.minimum(np.searchsorted(self.known, slots), len(self.known) - 1)
        return np.where(self.known[at] == slots, at + 1, 0)

    def step(self, rows: np.ndarray, gradient: np.ndarray, seen: np.ndarray, rate: float) -> None:
        """Adaptive step on the rows; ``gradient`` holds a line for each of them, and rows may repeat."""
        used, at = np.unique(rows, return_inverse=True)
        total = np.zeros((len(used), EMBEDDED), "f4")
        np.add.at(total, at, gradient)
        total[used == 0] = 0
        seen[used] += total**2
        self.table[used] -= rate * total / (np.sqrt(seen[used]) + 1e-6)


class Features:
    """Inputs of words from their embeddings."""

    #: New words whose inputs are made together.
    AT_ONCE = 8192

    def __init__(self, words: Embeddings, chars: Embeddings, projects: tuple[np.ndarray, ...] = ()):
        """``projects``: matrices that inputs are multiplied by as they are made, once for each distinct word; a table each."""
        self.words, self.chars, self.projects = words, chars, projects
        self.index: dict[str, int] = {}
        self.tables = [np.zeros((1024, w), "f4") for w in ([p.shape[1] for p in projects] or [INPUTS])]

    def parts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Embedding rows of words, of all their n-grams one after another, where each word's n-grams start, lengths."""
        slots, counts = slots_at_once(words)
        # A word without n-grams has row 0 for one.
        chars = np.insert(self.chars.rows_of(slots), (np.cumsum(counts) - counts)[counts == 0], 0) if len(words) else np.zeros(0, "i8")
        starts = np.cumsum(np.maximum(counts, 1)) - np.maximum(counts, 1)
        get = self.words.row.get
        return np.array([get(w, 0) for w in words], "i8"), chars, starts, np.array([min(len(w), 20) / 10 for w in words], "f4")

    def made(self, own: np.ndarray, chars: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(words, INPUTS) from ``parts``."""
        if not len(own):
            return np.zeros((0, INPUTS), "f4")
        table, n = self.chars.table[chars], np.diff([*starts, len(chars)])[:, None]
        return np.concatenate([self.words.table[own], np.maximum.reduceat(table, starts), np.add.reduceat(table, starts) / n, length[:, None], np.ones((len(own), 1), "f4")], 1).astype("f4")

    def numbers(self, words: list[str]) -> np.ndarray:
        """Where words stand in the tables, from 1 on; row 0 is zero. They hold until the next call."""
        index = self.index
        if len(index) > KEPT_WORDS:
            index.clear()
        new = [w for w in dict.fromkeys(words) if w not in index]
        while len(index) + len(new) >= len(self.tables[0]):
            self.tables = [np.concatenate([t, np.zeros_like(t)]) for t in self.tables]
        for at in range(0, len(new), self.AT_ONCE):
            some, start = new[at : at + self.AT_ONCE], len(index) + 1
            made = self.made(*self.parts(some))
            for table, part in zip(self.tables, [made @ p for p in self.projects] or [made], strict=True):
                table[start : start + len(some)] = part
            index.update(zip(some, range(start, start + len(some)), strict=True))
        return np.fromiter(map(index.__getitem__, words), "i4", len(words))

    def rows(self, words: list[str]) -> np.ndarray:
        numbers = self.numbers(words)  # may put larger tables in place
        return self.tables[0][numbers]


def starts_of(n: int) -> range:
    """First words of the windows over a text of ``n`` words: every STRIDE words until one reaches the end."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else range(0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiGRU:
    """Weights and both passes. Inputs are (time, window, INPUTS) with a mask (time, window)."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.w = {f"{d}{n}": (r.normal(size=s) / np.sqrt(s[0])).astype("f4") for d in "fb" for n, s in (("W", (INPUTS, 3 * h)), ("U", (h, 3 * h)))}
        self.w |= {"A": (r.normal(size=(2 * h, ATTENTION)) / np.sqrt(2 * h)).astype("f4"), "v": r.normal(size=ATTENTION).astype("f4"), "o": (r.normal(size=2 * h) / np.sqrt(2 * h)).astype("f4"), "c": np.zeros(1, "f4")}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        h, u = HIDDEN, self.w[d + "U"]
        u_gates, u_new = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
        state = np.zeros((x.shape[1], h), "f4")
        out = np.empty((x.shape[0], x.shape[1], h), "f4")
        for t in range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1):
            gates = 1 / (1 + np.exp(-(x[t, :, : 2 * h] + state @ u_gates)))
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[t, :, 2 * h :] + (r * state) @ u_new)
            after = state + mask[t][:, None] * z * (new - state)
            if keep is not None:
                keep.append((t, state, z, r, new))
            state = out[t] = after
        return out

    def projections(self) -> tuple[np.ndarray, np.ndarray]:
        """What inputs are multiplied by for each direction."""
        return self.w["fW"], self.w["bW"]

    def _states(self, d: str, x: np.ndarray, place: np.ndarray, mask: np.ndarray, out: np.ndarray) -> None:
        """As ``_run``, from words' projected inputs and each window's places among them, without anything kept."""
        h, u = HIDDEN, self.w[d + "U"]
        u_gates, u_new = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
        state, full = np.zeros((place.shape[1], h), "f4"), mask.all(1)
        for t in range(len(place)) if d == "f" else range(len(place) - 1, -1, -1):
            own = x.take(place[t], axis=0)
            gates = state @ u_gates
            gates += own[:, : 2 * h]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            new = (gates[:, h:] * state) @ u_new
            new += own[:, 2 * h :]
            np.tanh(new, out=new)
            new -= state
            new *= gates[:, :h]
            if not full[t]:
                new *= mask[t][:, None]
            state = state + new
            out[t] = state

    def score(self, x: list[np.ndarray], place: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Scores by window: ``x`` holds words' projected inputs for each direction, ``place`` (time, window) where its are."""
        w, h = self.w, HIDDEN
        states = np.empty((*place.shape, 2 * h), "f4")
        for i, d in enumerate("fb"):
            self._states(d, x[i], place, mask, states[:, :, i * h : (i + 1) * h])
        e = np.where(mask > 0, np.tanh(states @ w["A"]) @ w["v"], -1e9)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        return sigmoid(np.einsum("tb,tbh->bh", a, states) @ w["o"] + w["c"])

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """x: (time, window, INPUTS). Scores by window."""
        w, logs = self.w, {"f": [], "b": []}
        states = np.concatenate([self._run(d, x @ w[d + "W"], mask, logs[d] if keep is not None else None) for d in "fb"], 2)
        hidden = np.tanh(states @ w["A"])
        e = np.where(mask > 0, hidden @ w["v"], -1e9)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * states).sum(0)
        score = sigmoid(pooled @ w["o"] + w["c"])
        if keep is not None:
            keep.update(states=states, hidden=hidden, a=a, pooled=pooled, score=score, logs=logs)
        return score

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Mean gradients of the cross-entropy for each weight, and for the inputs as ``x``."""
        k: dict = {}
        self.forward(x, mask, k)
        w, h, g = self.w, HIDDEN, {"x": np.zeros_like(x)}
        d_out = (k["score"] - y) * weight / weight.sum()
        g["o"], g["c"] = k["pooled"].T @ d_out, np.array([d_out.sum()])
        d_pooled = d_out[:, None] * w["o"]
        d_states = k["a"][:, :, None] * d_pooled
        d_a = (k["states"] * d_pooled).sum(2)
        d_e = k["a"] * (d_a - (k["a"] * d_a).sum(0)) * (mask > 0)
        g["v"] = np.einsum("tba,tb->a", k["hidden"], d_e)
        d_hid = d_e[:, :, None] * w["v"] * (1 - k["hidden"] ** 2)
        g["A"] = np.einsum("tbh,tba->ha", k["states"], d_hid)
        d_states = d_states + d_hid @ w["A"].T
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u = w[d + "U"]
            g[d + "W"], g[d + "U"] = np.zeros_like(w[d + "W"]), np.zeros_like(u)
            carried = np.zeros((x.shape[1], h), "f4")
            for t, before, z, r, new in reversed(k["logs"][d]):
                total = carried + d_states[t, :, part]
                m = mask[t][:, None]
                d_new = total * m * z * (1 - new**2)
                d_z = total * m * (new - before) * z * (1 - z)
                back = d_new @ u[:, 2 * h :].T
                d_r = back * before * r * (1 - r)
                d_gates = np.concatenate([d_z, d_r], 1)
                g[d + "U"][:, : 2 * h] += before.T @ d_gates
                g[d + "U"][:, 2 * h :] += (r * before).T @ d_new
                d_in = np.concatenate([d_gates, d_new], 1)
                g[d + "W"] += x[t].T @ d_in
                g["x"][t] += d_in @ w[d + "W"].T
                carried = total * (1 - m * z) + back * r + d_gates @ u[:, : 2 * h].T
        return g

    def fit(self, inputs, mask: np.ndarray, y: np.ndarray, steps: int = 200, batch: int = 256, rate: float = 0.02, seed: int = 11, inputs_step=None) -> None:
        """Adam over random batches. ``inputs(at)`` gives the inputs of windows; ``inputs_step(at, gradient)`` learns them."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(p) for k, p in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            at = r.integers(0, mask.shape[1], batch)
            kept = np.ones((mask.shape[0], batch, INPUTS), "f4")
            for part in (0, 2):
                kept[:, :, part * EMBEDDED : (part + 1) * EMBEDDED] = r.random((mask.shape[0], batch, 1)) >= LEFT_OUT
            found = self.gradients(inputs(at) * kept, mask[:, at], y[at], np.ones(batch, "f4"))
            if inputs_step is not None:
                inputs_step(at, found["x"] * kept)
            for k in self.w:
                g = found[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype("f4")


class Scorer:
    """Features and network together; scores texts, many windows at once."""

    #: Windows that go through the network together.
    TOGETHER = 4096

    def __init__(self, words: Embeddings, chars: Embeddings, weights: dict[str, np.ndarray]):
        self.features = Features(words, chars)
        self.net = BiGRU()
        self.net.w = weights
        self.ready: Features | None = None

    def state(self) -> tuple[Embeddings, Embeddings, dict[str, np.ndarray]]:
        """All that a worker needs to score."""
        return self.features.words, self.features.chars, self.net.w

    def windows(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts as words: inputs of all words with padding behind, first words of all windows and their ends, each window's text."""
        x = self.features.rows([w for ws in split for w in ws])
        return np.concatenate([x, np.zeros((1, INPUTS), "f4")]), *self.places(split)

    @staticmethod
    def places(split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows and the ends of their texts, as two rows, and each window's text."""
        first, owner, ends, at = [], [], [], 0
        for i, ws in enumerate(split):
            s = starts_of(len(ws))
            first.extend(range(at, at + s.stop, STRIDE) if ws else ())
            owner.extend([i] * len(s))
            at += len(ws)
            ends.extend([at] * len(s))
        return np.array([first, ends], "i8").reshape(2, -1), np.array(owner, "i8")

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.ready is None:  # learnt by now: words' inputs are projected once
            self.ready = Features(self.features.words, self.features.chars, self.net.projections())
        split = [words_of(t) for t in texts]
        (first, ends), owner = self.places(split)
        number = np.append(self.ready.numbers([w for ws in split for w in ws]), 0)
        out = np.zeros(len(texts))
        for at in range(0, len(first), self.TOGETHER):
            place = first[at : at + self.TOGETHER] + np.arange(WINDOW)[:, None]
            score = self.net.score(self.ready.tables, number[np.minimum(place, len(number) - 1)], (place < ends[at : at + self.TOGETHER]).astype("f4"))
            np.maximum.at(out, owner[at : at + self.TOGETHER], score)
        return np.round(out, 5)  # what windows stand beside one another moves the eighth digit


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """The bounded sample: (texts, labels), rows not held out, first in hash order for each label.

    Ids are drawn from the labels alone, ``DRAWN`` for each row wanted, so only drawn rows' texts move.
    """
    named = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("__toxic")).withColumn("__order", F.xxhash64("doc_id"))
    drawn = [named.filter(F.col("__toxic") == label).orderBy("__order", "doc_id").limit(DRAWN * TRAIN_ROWS) for label in (0, 1)]
    rows = docs.select("doc_id", text_or_empty().alias("text")).filter(F.length("text") > 0)
    rows = rows.join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")  # at most 2 * DRAWN * TRAIN_ROWS ids
    found = sorted(rows.select("__toxic", "__order", "doc_id", "text").collect())
    found = [r for label in (0, 1) for r in [x for x in found if x["__toxic"] == label][:TRAIN_ROWS]]
    return [r["text"] for r in found], np.array([r["__toxic"] for r in found], "f4")


def _distinct(texts: list[str], y: np.ndarray) -> tuple[list[str], np.ndarray]:
    """One text of those with one label that share their smallest hashes of three words: copies aren't more evidence."""
    seen: dict[tuple, int] = {}
    for i, t in enumerate(texts):
        words = words_of(t)
        hashes = {zlib.crc32(" ".join(words[k : k + 3]).encode()) for k in range(max(1, len(words) - 2))}
        seen.setdefault((*nsmallest(COPY_HASHES, hashes), float(y[i])), i)
    return [texts[i] for i in seen.values()], y[list(seen.values())]


def train(texts: list[str], y: np.ndarray) -> Scorer | None:
    """Where embeddings start, then the network on windows, then both together; None without a text of each label."""
    if not (len(texts) and y.min() == 0 and y.max() == 1):
        return None
    texts, y = _distinct(texts, y)
    number: dict[str, int] = {}
    split = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], "i4") for t in texts]
    names = list(number)
    cut, stops = array("I"), []
    for w in names:
        cut.extend(slots_of(w))
        stops.append(len(cut))
    stops = np.array(stops, "i8")
    hashes, slots = np.unique(np.frombuffer(cut, "u4") if cut else np.zeros(0, "u4"), return_inverse=True)
    slots = slots.astype("i4")
    sizes = np.diff(stops, prepend=0)
    # Each part of the rows takes its evidence from the others while the network learns, so that it meets unseen words too.
    part = np.array([zlib.crc32(t.encode()) % PARTS for t in texts])
    met = [np.zeros((PARTS, 2, n), "u2") for n in (len(names), len(hashes))]  # texts by part and label that hold a word, an n-gram
    rows = np.zeros((PARTS, 2), "i8")
    for i, words in enumerate(split):
        at = part[i], int(y[i])
        rows[at] += 1
        used = np.unique(words)
        met[0][at][used] += 1
        n = sizes[used]
        met[1][at][np.unique(slots[np.repeat(stops[used] - np.cumsum(n), n) + np.arange(n.sum())])] += 1
    tables = []
    for k in range(PARTS + 1):  # without part k; at last from all
        keep = [j for j in range(PARTS) if j != k]
        found = [evidence(*m[keep].sum(0, dtype="i4"), rows[keep].sum(0)) for m in met]
        tables.append((Embeddings({names[i]: o for i, o in zip(*(x.tolist() for x in found[0]), strict=True)}), Embeddings(dict(zip(hashes[found[1][0]].tolist(), found[1][1].tolist(), strict=True)))))
    del met, slots, hashes, cut
    xs, masks, ys, read = [], [], [], []
    for k in range(PARTS):
        mine = np.flatnonzero(part == k)
        if not len(mine):
            continue
        mine_split = [[names[j] for j in split[i]] for i in mine]
        x, (first, ends), owner = Scorer(*tables[k], {}).windows(mine_split)
        if not len(first):
            continue
        place = first + np.arange(WINDOW)[:, None]
        mask = (place < ends).astype("f4")
        telling = np.concatenate([x[:, [0]], x[:, [EMBEDDED]], x[:, [2 * EMBEDDED]]], 1)[np.minimum(place, len(x) - 1)] * mask[:, :, None]
        strength = telling.sum(2).max(0)
        order = np.lexsort((-strength, owner))
        nth = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        toxic = y[mine][owner] == 1
        keep = order[(nth < np.where(toxic[order], 1, CLEAN_WINDOWS)) & ~(toxic & (telling[:, :, :2].max((0, 2)) < LEAST_EVIDENCE))[order]]
        xs.append(x[np.minimum(place[:, keep], len(x) - 1)])
        masks.append(mask[:, keep])
        ys.append(y[mine][owner[keep]])
        flat = [w for words in mine_split for w in words]
        read.extend([flat[a : min(a + WINDOW, b)] for a, b in zip(first[keep].tolist(), ends[keep].tolist())])
    if not xs or np.concatenate(ys).min() == np.concatenate(ys).max():
        return None
    x, mask, label = np.concatenate(xs, 1), np.concatenate(masks, 1), np.concatenate(ys)
    net = BiGRU()
    net.fit(lambda at: x[:, at], mask, label)
    scorer = Scorer(*tables[PARTS], net.w)
    _together(scorer, read, mask, label)
    return scorer


def _together(scorer: Scorer, windows: list[list[str]], mask: np.ndarray, label: np.ndarray, steps: int = 120, rate: float = 0.02) -> None:
    """Embeddings and network learn on from the same windows, as lists of words."""
    made = scorer.features
    names = list(dict.fromkeys(w for ws in windows for w in ws))
    number = dict(zip(names, range(len(names))))
    own, chars, starts, length = made.parts(names)
    stops = np.array([*starts[1:], len(chars)])
    place = np.zeros((WINDOW, len(windows)), "i8")
    for i, ws in enumerate(windows):
        place[: len(ws), i] = [number[w] for w in ws]
    seen = [np.full_like(e.table, 1e-4) for e in (made.words, made.chars)]

    def of(at: np.ndarray) -> tuple:
        """Of the words of these windows: their numbers, where they stand, their parts."""
        used, where = np.unique(place[:, at], return_inverse=True)
        n = stops[used] - starts[used]
        first = np.cumsum(n) - n
        return used, where.reshape(WINDOW, -1), n, first, chars[np.repeat(starts[used] - first, n) + np.arange(n.sum())]

    def inputs(at: np.ndarray) -> np.ndarray:
        used, where, _, first, theirs = of(at)
        return made.made(own[used], theirs, first, length[used])[where]

    def learn(at: np.ndarray, gradient: np.ndarray) -> None:
        used, where, n, first, theirs = of(at)
        total = np.zeros((len(used), INPUTS), "f4")
        np.add.at(total, where.ravel(), (gradient * mask[:, at, None]).reshape(-1, INPUTS))
        of_word, of_max, of_mean = (total[:, k * EMBEDDED : (k + 1) * EMBEDDED] for k in range(3))
        table = made.chars.table[theirs]
        is_max = table == np.repeat(np.maximum.reduceat(table, first), n, 0)
        made.chars.step(theirs, np.repeat(of_max, n, 0) * is_max + np.repeat(of_mean / n[:, None], n, 0), seen[1], rate)
        made.words.step(own[used], of_word, seen[0], rate)

    scorer.net.fit(inputs, mask, label, steps, rate=0.005, seed=12, inputs_step=learn)


def score(docs: DataFrame, scorer: Scorer | None, keep: list[str], text: str = "text", into: str = "score") -> DataFrame:
    """Columns ``keep`` and ``into`` (none of them), the score, without a shuffle. The model is bounded by the training sample."""
    fields = [docs.schema[k] for k in keep]
    if scorer is None:
        return docs.select(*map(quoted, keep), F.lit(0.0).alias(into))
    shared = docs.sparkSession.sparkContext.broadcast(scorer.state())
    n = len(keep)

    def run(batches):
        worker = Scorer(*shared.value)
        for whole in batches:
            for batch in slices(whole, n):
                got = worker.scores(batch.column(n).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(got, pa.float64())], names=[*keep, into])

    schema = T.StructType([*fields, T.StructField(into, T.DoubleType())])
    return docs.select(*map(quoted, keep), text_or_empty(text).alias(unused("__text", docs))).mapInArrow(frugal(run), schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scorer = train(*training_rows(docs, read_table(spark, sf_dir, "labels")))
    scored = score(docs, scorer, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
