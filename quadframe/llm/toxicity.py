"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its hashed embedding, the mean embedding of its character 3- to 5-grams, and how much
more often the word and its most telling character gram occur in toxic training documents. The network
reads windows of WINDOW words, STRIDE apart, over the whole text; a document scores by its most toxic
window, through a logistic curve fitted on training documents that the network did not see. As a
document's label does not say which window is toxic, the network learns from a toxic document's TELLING most
telling windows, and from as many and RANDOM random ones of each other document of the sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled documents of each class that the model is fitted on, in order of their id's hash.
SAMPLE = 2000
WINDOW, STRIDE = 32, 24
#: Windows of a document that training draws on. Scores read all windows of every document.
TELLING, RANDOM = 2, 2
_HIDDEN, _ATTEND, _WORD_DIM, _GRAM_DIM = 8, 8, 4, 4
_WORDS, _GRAMS, _LETTERS = 1 << 18, 1 << 18, 24
#: Letters of a word, or of a piece of it, that are hashed as one; two cells mark the ends.
_PIECE = _LETTERS - 2
_WORD = re.compile(r"\w+")
#: Characters of text that a task turns into windows at once.
_PORTION = 2_000_000


def words_of(text: str) -> list[str]:
    """Runs of word characters. Runs too long for one row of hashes() come in pieces that overlap by 4
    letters, so that some piece holds every gram; ~ marks the ends of pieces that are not ends of a run."""
    words = _WORD.findall(text.lower())
    if max(map(len, words), default=0) <= _PIECE:
        return words
    out = []
    for w in words:
        cuts = range(0, max(1, len(w) - 4), _PIECE - 4)
        out += ["~" * (i > 0) + w[i : i + _PIECE] + "~" * (i + _PIECE < len(w)) for i in cuts]
    return out


def hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket, gram buckets (n, m) and which of them are there; grams see the word's two ends.
    words: as words_of() gives them."""
    ends = [("" if w[0] == "~" else "<") + w + ("" if w[-1] == "~" else ">") for w in words]
    cells = np.array(ends, f"U{_LETTERS}").view(np.uint32).reshape(len(words), _LETTERS)
    size = (cells > 0).sum(1)
    code, word = cells.astype(np.uint32), np.zeros(len(words), np.uint32)
    for k in range(_LETTERS):
        word = word * np.uint32(0x01000193) + cells[:, k]
    grams, there = [], []
    for n in range(2, 6):
        code = code[:, :-1] * np.uint32(0x01000193) + cells[:, n - 1 :] + np.uint32(n)
        if n > 2:
            grams.append((code * np.uint32(2654435761)) >> np.uint32(14))
            there.append(np.arange(code.shape[1]) + n <= size[:, None])
    return ((word * np.uint32(2654435761)) >> np.uint32(14)).astype(np.int64), np.concatenate(grams, 1).astype(np.int64), np.concatenate(there, 1)


def windows(ids: np.ndarray) -> np.ndarray:
    """Overlapping windows of word numbers; 0 fills the last."""
    n = max(1, -(-max(0, len(ids) - WINDOW) // STRIDE) + 1)
    padded = np.zeros((n - 1) * STRIDE + WINDOW, np.int64)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


class Network:
    """Parameters in self.p; hidden states run both ways over (windows, WINDOW) word numbers."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        d, h, a = _WORD_DIM + _GRAM_DIM + 3, _HIDDEN, _ATTEND

        def draw(*shape: int) -> np.ndarray:
            return (r.standard_normal(shape) / np.sqrt(shape[0] if len(shape) > 1 else 4)).astype(np.float32)

        self.p = {"words": 0.1 * r.standard_normal((_WORDS, _WORD_DIM)).astype(np.float32), "grams": 0.1 * r.standard_normal((_GRAMS, _GRAM_DIM)).astype(np.float32)}
        for way in "fb":
            self.p |= {"W" + way: draw(d, 3 * h), "U" + way: draw(h, 3 * h), "c" + way: np.zeros(3 * h, np.float32)}
        self.p |= {"A": draw(2 * h, a), "a": np.zeros(a, np.float32), "v": draw(a), "o": draw(2 * h), "q": np.zeros(1, np.float32)}
        self.word_odds, self.gram_odds = np.zeros(_WORDS, np.float32), np.zeros(_GRAMS, np.float32)
        self.curve = (1.0, 0.0)

    def inputs(self, word: np.ndarray, grams: np.ndarray, there: np.ndarray) -> np.ndarray:
        n = np.maximum(there.sum(1), 1)[:, None].astype(np.float32)
        mean = (self.p["grams"][grams] * there[:, :, None]).sum(1) / n
        odds = np.where(there, self.gram_odds[grams], 0)
        return np.concatenate([self.p["words"][word], mean, self.word_odds[word][:, None], odds.max(1)[:, None], odds.sum(1)[:, None] / n], 1).astype(np.float32)

    def run(self, x: np.ndarray, ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows; x: inputs by word number, number 0 being the filling."""
        h, n, steps = _HIDDEN, len(ids), ids.shape[1]
        mask = (ids > 0).astype(np.float32)
        out, kept = np.zeros((n, steps, 2 * h), np.float32), {}
        for way, order, cut in (("f", range(steps), slice(0, h)), ("b", range(steps - 1, -1, -1), slice(h, 2 * h))):
            given, u = x @ self.p["W" + way] + self.p["c" + way], self.p["U" + way]
            state = np.zeros((n, h), np.float32)
            for t in order:
                g, s = given[ids[:, t]], state @ u
                zr = _sigmoid(g[:, : 2 * h] + s[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(g[:, 2 * h :] + r * s[:, 2 * h :])
                m = mask[:, t, None]
                new = state + m * (1 - z) * (c - state)
                if keep:
                    kept[way, t] = (state, s, z, r, c)
                state = new
                out[:, t, cut] = state
        e = np.tanh(out @ self.p["A"] + self.p["a"])
        weight = e @ self.p["v"] + (mask - 1) * np.float32(1e9)
        weight = np.exp(weight - weight.max(1, keepdims=True)) * mask
        weight /= np.maximum(weight.sum(1, keepdims=True), 1e-9)
        pooled = (out * weight[:, :, None]).sum(1)
        return pooled @ self.p["o"] + self.p["q"][0], {"mask": mask, "out": out, "e": e, "weight": weight, "pooled": pooled, "kept": kept}

    def gradients(self, parts: tuple, x: np.ndarray, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Cross-entropy and its gradients; parts: the hashes behind x[1:]."""
        logit, k = self.run(x, ids, keep=True)
        h, d = _HIDDEN, {name: np.zeros_like(v) for name, v in self.p.items() if name not in ("words", "grams")}
        p = _sigmoid(logit)
        loss = float(-np.mean(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)))
        dl = ((p - y) / len(y)).astype(np.float32)
        d["q"][0], d["o"] = dl.sum(), k["pooled"].T @ dl
        dpool = dl[:, None] * self.p["o"]
        dweight = (k["out"] * dpool[:, None, :]).sum(2)
        dout = k["weight"][:, :, None] * dpool[:, None, :]
        dscore = k["weight"] * (dweight - (k["weight"] * dweight).sum(1, keepdims=True))
        d["v"] = np.einsum("nt,nta->a", dscore, k["e"])
        de = dscore[:, :, None] * self.p["v"] * (1 - k["e"] ** 2)
        d["A"], d["a"] = np.einsum("nth,nta->ha", k["out"], de), de.sum((0, 1))
        dout = dout + de @ self.p["A"].T
        dx = np.zeros_like(x)
        for way, order, cut in (("f", range(ids.shape[1] - 1, -1, -1), slice(0, h)), ("b", range(ids.shape[1]), slice(h, 2 * h))):
            u, w = self.p["U" + way], self.p["W" + way]
            dgiven = np.zeros((len(x), 3 * h), np.float32)
            dstate = np.zeros((len(ids), h), np.float32)
            for t in order:
                state, s, z, r, c = k["kept"][way, t]
                m = k["mask"][:, t, None]
                dnew = dstate + dout[:, t, cut]
                dc = dnew * m * (1 - z) * (1 - c**2)
                dz = dnew * m * (state - c) * z * (1 - z)
                dr = dc * s[:, 2 * h :] * r * (1 - r)
                dg = np.concatenate([dz, dr, dc], 1)
                ds = np.concatenate([dz, dr, dc * r], 1)
                d["U" + way] += state.T @ ds
                dstate = dnew * (1 - m * (1 - z)) + ds @ u.T
                np.add.at(dgiven, ids[:, t], dg)
            d["c" + way] = dgiven[1:].sum(0)
            d["W" + way] = x[1:].T @ dgiven[1:]
            dx += dgiven @ w.T
        word, grams, there = parts
        d["words"] = (word, dx[1:, :_WORD_DIM])
        share = there / np.maximum(there.sum(1), 1)[:, None]
        row, col = np.nonzero(there)
        d["grams"] = (grams[row, col], dx[1:][row, _WORD_DIM : _WORD_DIM + _GRAM_DIM] * share[row, col][:, None].astype(np.float32))
        return loss, d

    def scores(self, texts: list[str]) -> np.ndarray:
        """Logit of each text's most toxic window; minus infinity where there are no words."""
        best = np.full(len(texts), -np.inf)
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= _PORTION):
                size += len(texts[end])
                end += 1
            best[at:end] = self._portion(texts[at:end])
            at = end
        return best

    def _portion(self, texts: list[str]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        best = np.full(len(texts), -np.inf)
        flat = pa.array([w for s in split for w in s], pa.string()).dictionary_encode()
        if not len(flat):
            return best
        x = np.concatenate([np.zeros((1, _WORD_DIM + _GRAM_DIM + 3), np.float32), *(self.inputs(*hashes(flat.dictionary[i : i + 20_000].to_pylist())) for i in range(0, len(flat.dictionary), 20_000))])
        ids, ends = flat.indices.to_numpy().astype(np.int64) + 1, np.cumsum([len(s) for s in split])
        groups = [windows(ids[e - len(s) : e]) for s, e in zip(split, ends) if s]
        owner = np.repeat([i for i, s in enumerate(split) if s], [len(g) for g in groups])
        every = np.concatenate(groups)
        for i in range(0, len(every), 8192):
            np.maximum.at(best, owner[i : i + 8192], self.run(x, every[i : i + 8192])[0].astype(np.float64))
        return best

    def probability(self, best: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return np.where(np.isneginf(best), 0.0, 1 / (1 + np.exp(-np.clip(a * np.where(np.isneginf(best), 0, best) + b, -30, 30))))


def _odds(network: Network, split: list[list[str]], y: np.ndarray) -> None:
    """Log ratio of the shares of toxic and other documents that hold each word or gram."""
    for name, size, k in (("word_odds", _WORDS, 0), ("gram_odds", _GRAMS, 1)):
        seen = np.zeros((2, size))
        for words, label in zip(split, y):
            if words:
                parts = hashes(sorted(set(words)))
                seen[int(label), np.unique(parts[0] if k == 0 else parts[1][parts[2]])] += 1
        n = np.array([(y == 0).sum(), (y == 1).sum()])[:, None]
        share = (seen + 1) / (n + 2)
        setattr(network, name, np.log(share[1] / share[0]).astype(np.float32))


def train(texts: list[str], labels: np.ndarray, steps: int = 700, batch: int = 128, seed: int = 0) -> Network:
    network, r = Network(seed), np.random.default_rng(seed)
    y = np.asarray(labels)
    if len(set(y.tolist())) < 2:
        network.curve = (0.0, -30.0 if not y.any() else 30.0)
        return network
    once: dict[str, str] = {}
    split = [[once.setdefault(w, w) for w in words_of(t)] for t in texts]
    # what each part teaches is judged on documents that earlier parts did not see, as in use
    turn = np.arange(len(y)) % 5
    unseen, fitting = turn == 4, np.flatnonzero(turn < 2)
    if len(set(y[fitting].tolist())) < 2 or len(set(y[(turn > 1) & ~unseen].tolist())) < 2:
        fitting = np.flatnonzero(~unseen)
    _odds(network, [split[i] for i in fitting], y[fitting])
    fitting = np.flatnonzero((turn > 1) & ~unseen) if len(fitting) < (~unseen).sum() else fitting
    vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for i in fitting for w in split[i]}))}
    parts = hashes(list(vocabulary))
    telling = np.concatenate([[0], np.maximum(network.word_odds[parts[0]], np.where(parts[2], network.gram_odds[parts[1]], 0).max(1))])
    toxic, other, every = [], [], []
    for i in fitting:
        if split[i]:
            w = windows(np.array([vocabulary[x] for x in split[i]]))
            rank = np.argsort(-np.sort(telling[w], 1)[:, -3:].sum(1))
            if y[i]:
                toxic += [w[k] for k in rank[:TELLING]]
            else:
                other += [w[k] for k in rank[:TELLING]] + [w[k] for k in r.integers(0, len(w), RANDOM)]
                every.append(w)
    pools = [np.array(other).reshape(-1, WINDOW), np.array(toxic).reshape(-1, WINDOW)]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    for step in range(1, steps + 1):
        if not all(map(len, pools)):
            break
        if step in (steps // 3, 2 * steps // 3) and every:  # more of what the network takes for toxic by mistake
            x = np.concatenate([np.zeros((1, _WORD_DIM + _GRAM_DIM + 3), np.float32), *(network.inputs(*(p[i : i + 20_000] for p in parts)) for i in range(0, len(vocabulary), 20_000))])
            worst = np.array([w[np.argmax(network.run(x, w)[0])] for w in every])
            pools[0] = np.concatenate([pools[0], worst, worst])
        own = np.concatenate([p[r.integers(0, len(p), batch // 2)] for p in pools])
        used, ids = np.unique(own, return_inverse=True)
        ids = ids.reshape(own.shape)
        if used[0] != 0:
            used, ids = np.concatenate([[0], used]), ids + 1
        here = tuple(p[used[1:] - 1] for p in parts)
        x = np.concatenate([np.zeros((1, _WORD_DIM + _GRAM_DIM + 3), np.float32), network.inputs(*here)])
        _, grad = network.gradients(here, x, ids, np.repeat([0, 1], batch // 2).astype(np.float32))
        for name, g in grad.items():
            m, v = moment[name]
            if isinstance(g, tuple):  # embeddings: only the rows that were used move
                rows, inverse = np.unique(g[0], return_inverse=True)
                total = np.zeros((len(rows), g[1].shape[1]), np.float32)
                np.add.at(total, inverse, g[1])
                v[rows] += total**2
                network.p[name][rows] -= 0.05 * total / (np.sqrt(v[rows]) + 1e-6)
            else:
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                network.p[name] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    judged = np.flatnonzero(unseen) if len(set(y[unseen].tolist())) == 2 else np.arange(len(y))
    best = network.scores([texts[i] for i in judged])
    network.curve = _curve(best[np.isfinite(best)], y[judged][np.isfinite(best)])
    return network


def _curve(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve with both classes at the same weight, gently regularised; damped Newton steps."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    x, w = np.stack([s, np.ones_like(s)], 1), np.array([0.5, 0.0])

    def loss(w: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w))).sum() + 1e-3 * (w[0] ** 2 + 0.01 * w[1] ** 2))

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + 2e-3 * w * [1, 0.01]
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([2e-3, 2e-5]), g)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return (float(max(w[0], 1e-3)), float(w[1]))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Learns from labelled rows that are not held out, at most SAMPLE of each class."""
    truth = labels.filter(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    truth = truth.filter(~held_out("_id"))
    drawn = truth.filter("toxic = 1").orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).union(truth.filter("toxic = 0").orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE))
    # at most 2 * SAMPLE ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), F.col("id") == F.col("_id")).select("id", "toxic", "text")
    rows = rows.groupBy("id").agg(F.min(F.struct("text", "toxic")).alias("x")).select("id", "x.toxic", "x.text").orderBy(F.xxhash64("id"), "id").collect()
    return train([r["text"] or "" for r in rows], np.array([r["toxic"] for r in rows], np.int64))


def score(docs: DataFrame, labels: DataFrame | None = None, network: Network | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted per row.

    A text without words (null, empty, white space) scores 0; repeated rows score alike; a null id
    hashes as the empty string; an empty table gives no rows; with labels of one class or none, every
    text scores as that class. Only text enters a score.
    """
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network or fit(docs, labels, id_col, text_col))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                p = shared.value.probability(shared.value.scores([t or "" for t in part.column(2).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
