"""Secret scans: base patterns, and a character convolutional network over every candidate.

A candidate is a run of 16 or more characters of ``[A-Za-z0-9+/_=-]`` with a letter and a digit, or what a base pattern
matched. The network, in numpy, sees WIDTH characters at a time: the candidate and what surrounds it. A candidate that
doesn't fit is shown in windows over all of it and both sides, and the highest score counts. The network is trained on
labelled findings (text, start, end, label). Its scores are calibrated by Platt scaling on held-out findings, and the
threshold is the highest that keeps the recall there at RECALL or above.

Base findings are always kept; the network adds candidates that it accepts and no one base finding covers whole, as kind ``cnn``.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.llm.common import steps, tidy

BASE = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate((*BASE, "cnn"))}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of the class are maximal, so asking for 16 at once finds the same runs as filtering them.
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")

BEFORE, WIDTH = 24, 96
#: Characters from one window of a long candidate to the next.
STRIDE = 48
RECALL = 0.98
#: Character classes that the network tells apart: single ones for marks, groups for letters and digits.
_GROUPS = ["aeiou", "bcdf", "ghjklmn", "pqrstvwxyz", "AEIOU", "BCDF", "GHJKLMN", "PQRSTVWXYZ", "01234", "56789", *"+/_=-.:'\"@ \n,()[]{}<>"]
_CLASS = {c: k + 2 for k, g in enumerate(_GROUPS) for c in g}
CLASSES = len(_GROUPS) + 3  # 0 pads, 1 is any other character, the last marks the candidate itself


def window(text: str, start: int, end: int, shift: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Class numbers of WIDTH characters from BEFORE before the candidate, or ``shift`` later, and which of them are the
    candidate."""
    first = start - BEFORE + shift
    shown = text[max(0, first) : first + WIDTH]
    codes = np.zeros(WIDTH, dtype=np.int64)
    lead = max(0, -first)
    codes[lead : lead + len(shown)] = [_CLASS.get(c, 1) for c in shown]
    own = np.zeros(WIDTH, dtype=bool)
    own[max(0, start - first) : max(0, end - first)] = True
    return codes, own


def windows(text: str, start: int, end: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """One window where the candidate fits into it; else as many as show all of it and BEFORE characters on both sides."""
    if end - start <= WIDTH - BEFORE:
        return [window(text, start, end)]
    last = end - start + 2 * BEFORE - WIDTH
    return [window(text, start, end, shift) for shift in [*range(0, last, STRIDE), last]]


class Finding(NamedTuple):
    text: str
    start: int
    end: int
    label: int


class CharCNN:
    """One-hot characters, one convolution, ReLU, maximum over positions, one logistic unit. Plain numpy, seeded."""

    KERNEL, FILTERS = 5, 32

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.conv = rng.normal(0, 0.2, (self.KERNEL, CLASSES, self.FILTERS))
        self.bias = np.zeros(self.FILTERS)
        self.out = rng.normal(0, 0.2, 2 * self.FILTERS)
        self.shift = 0.0
        self.scale, self.offset, self.threshold = 1.0, 0.0, 0.5

    def _hidden(self, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """(rows, positions, filters) before ReLU. A one-hot input makes the convolution a sum of table rows."""
        n = WIDTH - self.KERNEL + 1
        h = np.broadcast_to(self.bias, (len(codes), n, self.FILTERS)).copy()
        for k in range(self.KERNEL):
            h += self.conv[k][codes[:, k : k + n]]
            h += own[:, k : k + n, None] * self.conv[k][CLASSES - 1]
        return h

    def _pool(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maximum over positions and the mean, and where the maximum is."""
        r = np.maximum(h, 0)
        at = r.argmax(1)
        return np.concatenate((np.take_along_axis(r, at[:, None], 1)[:, 0], r.mean(1)), 1), at

    def logits(self, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(0)
        return np.concatenate([self._pool(self._hidden(codes[i : i + 256], own[i : i + 256]))[0] @ self.out + self.shift for i in range(0, len(codes), 256)])

    def probability(self, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(codes, own) + self.offset, -50, 50)))

    def fit(self, codes: np.ndarray, own: np.ndarray, labels: np.ndarray, epochs: int = 4, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on the logistic loss."""
        rng = np.random.default_rng(seed)
        weights = [self.conv, self.bias, self.out]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        shift_m = shift_v = 0.0
        step, n = 0, WIDTH - self.KERNEL + 1
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for i in range(0, len(order), 64):
                rows = order[i : i + 64]
                c, o, y = codes[rows], own[rows], labels[rows]
                h = self._hidden(c, o)
                pooled, at = self._pool(h)
                p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.shift, -50, 50)))
                d = (p - y) / len(rows)
                g_pool = d[:, None] * self.out
                g_h = np.broadcast_to(g_pool[:, None, self.FILTERS :] / n, h.shape).copy()
                top = np.take_along_axis(g_h, at[:, None], 1) + g_pool[:, None, : self.FILTERS]
                np.put_along_axis(g_h, at[:, None], top, 1)
                g_h *= h > 0
                g_conv = np.zeros_like(self.conv)
                flat = g_h.reshape(-1, self.FILTERS)
                for k in range(self.KERNEL):
                    hot = np.zeros((CLASSES, flat.shape[0]))
                    hot[c[:, k : k + n].ravel(), np.arange(flat.shape[0])] = 1
                    hot[CLASSES - 1] = o[:, k : k + n].ravel()
                    g_conv[k] = hot @ flat
                step += 1
                grads = [g_conv, flat.sum(0), d @ pooled]
                for w, g, m, v in zip(weights, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                shift_m += 0.1 * (d.sum() - shift_m)
                shift_v += 0.001 * (d.sum() ** 2 - shift_v)
                self.shift -= rate * (shift_m / (1 - 0.9**step)) / ((shift_v / (1 - 0.999**step)) ** 0.5 + 1e-8)

    def calibrate(self, codes: np.ndarray, own: np.ndarray, labels: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling by Newton steps, then the highest threshold with at least ``recall`` among these findings."""
        z, y = self.logits(codes, own), labels.astype(float)
        a, b = 1.0, 0.0
        target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
            r, w = p - target, p * (1 - p) + 1e-9
            grad = np.array([r @ z, r.sum()])
            hess = np.array([[w @ (z * z) + 1e-6, w @ z], [w @ z, w.sum() + 1e-6]])
            move = np.linalg.solve(hess, grad)
            a, b = a - move[0], b - move[1]
            if np.abs(move).max() < 1e-9:
                break
        self.scale, self.offset = float(a), float(b)
        positive = np.sort(self.probability(codes, own)[labels == 1])[::-1]
        self.threshold = float(positive[int(np.ceil(recall * len(positive))) - 1]) if len(positive) else 1.0


def labelled_findings(n: int = 3000, seed: int = 11) -> list[Finding]:
    """Labelled findings from a seeded generator: random keys in code and prose, against identifiers, versions, paths,
    dates, slugs and numbered words in the same surroundings. Real labelled findings may be given in their place."""
    rng = np.random.default_rng(seed)
    pick = lambda pool, k: "".join(rng.choice(list(pool), k))
    syllables = ["an", "be", "co", "de", "er", "fi", "go", "ha", "in", "la", "men", "no", "or", "pre", "ra", "st", "ti", "un", "ver"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    out = []
    while len(out) < n:
        label = len(out) % 2
        if label:
            token = [
                lambda: pick(alnum, rng.integers(18, 60)),
                lambda: pick(b64, 4 * rng.integers(5, 16)) + pick("=", rng.integers(0, 3)),
                lambda: pick("0123456789abcdef", rng.integers(24, 65)),
                lambda: pick(string.ascii_uppercase + string.digits, rng.integers(18, 40)),
                lambda: f"{word()}_{pick(alnum, rng.integers(20, 40))}",
                lambda: f"{pick(string.ascii_lowercase, 2)}-{pick(alnum, rng.integers(24, 48))}",
            ][rng.integers(6)]()
        else:
            token = [
                lambda: f"{word()}-{word()}-{word()}-{rng.integers(1, 3000)}",
                lambda: f"{word()}_{word()}_{word()}{rng.integers(1, 99)}",
                lambda: f"{word()}{word()}{word()}{word()}{rng.integers(1, 9)}",
                lambda: f"/{word()}/{word()}/{word()}{rng.integers(1, 99)}",
                lambda: f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}T{rng.integers(0, 24):02d}-{word()}",
                lambda: f"{word().capitalize()}{word().capitalize()}{word().capitalize()}V{rng.integers(1, 20)}",
                lambda: f"{word()}={rng.integers(1, 99)}/{word()}={rng.integers(1, 99)}-{word()}",
                lambda: pick("-=_", 3) * 6 + str(rng.integers(1, 9)) + word(),
            ][rng.integers(8)]()
        if not CANDIDATE.fullmatch(token):
            continue
        prose = [" ".join(word() for _ in range(rng.integers(2, 7))) for _ in range(2)]
        lead = ["", "key: ", "auth=", '"', "Bearer ", "value = '", "id ", "(", "see "][rng.integers(9)]
        text = f"{prose[0]} {lead}{token} {prose[1]}."
        at = len(prose[0]) + 1 + len(lead)
        out.append(Finding(text, at, at + len(token), label))
    return out


def train(findings: Sequence[Finding], held: float = 0.25) -> CharCNN:
    """Trains on the first part and calibrates on the rest, which is held out."""
    shown = [window(f.text, f.start, f.end) for f in findings]
    codes, own = np.array([c for c, _ in shown]), np.array([o for _, o in shown])
    labels = np.array([f.label for f in findings])
    cutoff = int(len(findings) * (1 - held))
    net = CharCNN()
    net.fit(codes[:cutoff], own[:cutoff], labels[:cutoff])
    net.calibrate(codes[cutoff:], own[cutoff:], labels[cutoff:])
    return net


@lru_cache(maxsize=1)
def default_network() -> CharCNN:
    return train(labelled_findings())


def base_spans(text: str) -> list[tuple[int, str, int]]:
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    out.sort(key=lambda s: (s[0], ORDER[s[1]], s[2]))
    return out


def batch_spans(texts: Sequence[str], net: CharCNN) -> list[tuple[list[tuple[int, str, int]], list[tuple[int, str, int]], list[float]]]:
    """For each text its base findings, all findings in order, and the network's score of each of these."""
    base = [base_spans(t) if t else [] for t in texts]
    every, shown, firsts = [], [], []
    for i, (text, own) in enumerate(zip(texts, base)):
        extra = [(m.start(), "cnn", m.end()) for m in CANDIDATE.finditer(text or "")]
        extra = [s for s in extra if not any(b[0] <= s[0] and s[2] <= b[2] for b in own)]
        every.append(sorted(own + extra, key=lambda s: (s[0], ORDER[s[1]], s[2])))
        for s in every[-1]:
            firsts.append(len(shown))
            shown += windows(text, s[0], s[2])
    scores = np.maximum.reduceat(net.probability(np.array([c for c, _ in shown]), np.array([o for _, o in shown])), firsts).tolist() if shown else []
    out, k = [], 0
    for own, found in zip(base, every):
        rated = [(s, scores[k + j]) for j, s in enumerate(found)]
        k += len(found)
        rated = [(s, p) for s, p in rated if s[1] != "cnn" or p >= net.threshold]
        out.append((own, [s for s, _ in rated], [p for _, p in rated]))
    return out


def joined(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in found)


def find_secrets(docs: DataFrame, net: CharCNN | None = None) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added and scores (the network's, of
    each span). No shuffle; the network, some 50 KB whatever the corpus, goes along with the function.

    A null or empty text has no findings and the hash of an empty string. A very long text is read whole, as a step of its
    own, and a very long candidate is shown to the network in windows. Findings that begin at one place are in the order of
    kinds; the network's need its threshold at least. Repeated rows have a row each; an empty table has none. Other columns
    are not read, so clashing names do no harm.
    """
    net = net or default_network()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                found = batch_spans(part.column("text").to_pylist(), net)
                longs = [pa.array([sum(s[1] == k for s in base) for base, _, _ in found], pa.int64()) for k in BASE]
                columns = [
                    part.column("doc_id"),
                    *longs,
                    pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _, _ in found], pa.string()),
                    pa.array([joined(every) for _, every, _ in found], pa.string()),
                    pa.array([sum(s[1] == "cnn" for s in every) for _, every, _ in found], pa.int64()),
                    pa.array([[round(p, 6) for p in scores] for _, _, scores in found], pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added", "scores"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long, scores array<double>")
