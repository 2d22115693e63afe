"""Secret scans: fixed patterns, and a character convolutional network over all other candidates.

The patterns (BASE) give labelled findings. A candidate is any other run of 8 or more characters of
ALPHABET, with or without a digit; the finding is the whole run. The network reads windows of a run:
BEFORE characters before a place in it and AFTER from there on. Windows start every STEP characters until
one holds all up to TAIL characters behind the run's end, and the run's score is the highest of them. The
network is trained on the driver on a bounded sample: at most max_sample labelled windows of the corpus
(those that read a pattern finding are positive, the rest negative) and as many generated findings and
look-alikes. A held-back part calibrates its probabilities (Platt scaling) and sets the threshold: the
highest one that keeps min_recall of the held-back positives, of the corpus and generated each. Corpus negatives that a first network,
trained without their half of the sample, takes for findings are left out of the training part only.

Null text: no findings. Empty table: no rows. Repeated rows are scanned alike. Very long texts are read
whole, in time that grows with their length. Extra columns are ignored. Findings of one document are ordered by start, then by kind as in KINDS.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns, record_batch, slices, stored, texts_of

KINDS = ("assign", "access", "hex", "cnn")
#: The patterns, the group that is measured, and its least length.
BASE = (
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
#: The same matches as the last of BASE; the engine skips short runs faster.
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
ALPHABET = r"A-Za-z0-9+/_.=!@$%^&*#~?-"
CANDIDATE = re.compile(f"[{ALPHABET}]{{8,}}")
BEFORE, AFTER, STEP, TAIL = 32, 48, 24, 16
SAMPLE = "h long, context string, length int, label int"
RESULT = "doc_id long, kinds array<string>, starts array<int>, ends array<int>, scores array<float>"


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of each pattern finding, in order."""
    out = []
    for k, (_, pattern, group, least) in enumerate(BASE):
        out += [(m.start(), k, m.end()) for m in (pattern if k < 2 else _LONG_HEX).finditer(text) if len(m[group]) >= least]
    return sorted(out)


class Spans:
    """Spans ordered by start, asked whether one of them meets another span."""

    def __init__(self, found: list[tuple[int, int, int]]) -> None:
        self.starts = [a for a, _, _ in found]
        self.upto = list(accumulate((b for _, _, b in found), max))

    def meet(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.upto[k - 1] > start


def candidates(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, 1 if it overlaps a pattern finding) of each candidate."""
    spans = Spans(found)
    return [(m.start(), m.end(), int(spans.meet(*m.span()))) for m in CANDIDATE.finditer(text)]


def windows(start: int, end: int) -> range:
    """Where the windows of a run start."""
    return range(start, max(start + 1, end + TAIL - AFTER + STEP), STEP)


def context(text: str, start: int) -> str:
    """What a window at start reads, padded to one length."""
    return text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + text[start : start + AFTER].ljust(AFTER, "\0")


class Network:
    """Embedding, one convolution, ReLU, pooling by maximum, one dense layer; all in numpy."""

    SYMBOLS, WIDE = 98, 5

    def __init__(self, filters: int = 24, size: int = 8, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "emb": rng.normal(0, 0.3, (self.SYMBOLS, size)).astype(np.float32),
            "conv": rng.normal(0, (2 / (self.WIDE * (size + 1))) ** 0.5, (self.WIDE * (size + 1), filters)).astype(np.float32),
            "cb": np.zeros(filters, np.float32),
            "out": rng.normal(0, 0.3, filters).astype(np.float32),
            "ob": np.zeros(1, np.float32),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        self.recall: dict[int, tuple[int, float]] = {}  # by kind, 0 generated and 1 of the corpus: held-back positives, and their share that is found

    @classmethod
    def encode(cls, contexts: list[str]) -> np.ndarray:
        return cls.symbols("".join(contexts)).reshape(len(contexts), BEFORE + AFTER)

    @staticmethod
    def symbols(text: str) -> np.ndarray:
        """Numbers of the characters: 0 for padding, 96 for other white space, 97 beyond ASCII."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = np.where((codes >= 32) & (codes < 127), codes - 31, np.where(codes >= 127, 97, 96))
        return np.where(codes == 0, 0, out).astype(np.int64)

    def _forward(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, tuple]:
        inside = np.arange(BEFORE + AFTER)
        mark = ((inside >= BEFORE) & (inside < BEFORE + lengths[:, None])).astype(np.float32)
        e = np.concatenate([self.p["emb"][x], mark[:, :, None]], axis=2)
        view = np.lib.stride_tricks.sliding_window_view(e, self.WIDE, axis=1).transpose(0, 1, 3, 2)
        flat = np.ascontiguousarray(view).reshape(len(x), view.shape[1], -1)
        act = flat @ self.p["conv"] + self.p["cb"]
        top = act.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(act, top[:, None, :], axis=1)[:, 0], 0)
        return pooled @ self.p["out"] + self.p["ob"], (flat, top, pooled)

    def logits(self, contexts: list[str], lengths: np.ndarray, part: int = 512) -> np.ndarray:
        x = self.encode(contexts) if contexts else np.zeros((0, BEFORE + AFTER), np.int64)
        return np.concatenate([np.zeros(0, np.float32), *(self._forward(x[a : a + part], lengths[a : a + part])[0] for a in range(0, len(x), part))])

    def run_logits(self, texts: list[str], at: np.ndarray, starts: np.ndarray, lengths: np.ndarray, block: int = 1 << 16, part: int = 512) -> np.ndarray:
        """logits() of the windows at starts of the texts at (ascending), each text's convolution done once for all its windows.

        The mark's share of a convolution depends on the window's place and length alone and is added from a table.
        """
        codes = [np.concatenate([self.symbols(t), np.zeros(AFTER, np.int64)]) for t in texts]
        x = np.concatenate([np.zeros(BEFORE, np.int64), *codes, np.zeros(BEFORE + AFTER, np.int64)])
        where = starts + np.concatenate([[0], np.cumsum([len(c) for c in codes])])[at]
        size = self.p["emb"].shape[1]
        taps = self.p["conv"].reshape(self.WIDE, size + 1, -1)
        one = [self.p["emb"] @ taps[k, :size] for k in range(self.WIDE)]
        pair = [(one[k][:, None] + one[k + 1][None, :]).reshape(self.SYMBOLS**2, -1) for k in (0, 2)]
        wide = BEFORE + AFTER - self.WIDE + 1
        mark = ((np.arange(BEFORE + AFTER) >= BEFORE) & (np.arange(BEFORE + AFTER) < BEFORE + np.arange(AFTER + 1)[:, None])).astype(np.float32)
        marked = sum(mark[:, k : k + wide, None] * taps[k, size] for k in range(self.WIDE)) + self.p["cb"]
        of_length, out = np.minimum(lengths, AFTER), np.zeros(len(where), np.float32)
        first = 0
        while first < len(where):
            low = int(where[first])
            last = int(np.searchsorted(where, low + block))
            c = x[low : int(where[last - 1]) + BEFORE + AFTER]
            both, m = c[:-1] * self.SYMBOLS + c[1:], len(c) - self.WIDE + 1
            conv = pair[0][both[:m]] + pair[1][both[2 : m + 2]] + one[4][c[4 : m + 4]]
            view = np.lib.stride_tricks.sliding_window_view(conv, wide, axis=0).transpose(0, 2, 1)
            for a in range(first, last, part):
                b = min(a + part, last)
                act = view[where[a:b] - low] + marked[of_length[a:b]]
                out[a:b] = np.maximum(act.max(axis=1), 0) @ self.p["out"] + self.p["ob"]
            first = last
        return out

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))

    def probabilities(self, contexts: list[str], lengths: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(contexts, lengths))

    def fit(self, contexts: list[str], lengths: np.ndarray, y: np.ndarray, *, steps: int = 600, batch: int = 128, rate: float = 4e-3, seed: int = 11) -> None:
        """Adam on the logistic loss, the classes weighted alike; about as many steps for any number of rows."""
        rng, x = np.random.default_rng(seed), self.encode(contexts)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        m, v, t = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        size = self.p["emb"].shape[1]
        for _ in range(-(-steps * batch // max(1, len(x)))):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                rows = order[a : a + batch]
                z, (flat, top, pooled) = self._forward(x[rows], lengths[rows])
                dz = ((1 / (1 + np.exp(-z)) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
                g = {"out": pooled.T @ dz, "ob": dz.sum(keepdims=True)}
                da = np.where(pooled > 0, dz[:, None] * self.p["out"], 0).astype(np.float32)
                picked = np.take_along_axis(flat[:, :, :, None], top[:, None, None, :], axis=1)[:, 0]
                g["conv"] = np.einsum("nkf,nf->kf", picked, da)
                g["cb"] = da.sum(axis=0)
                back = np.einsum("nf,kf->nfk", da, self.p["conv"]).reshape(len(rows), -1, self.WIDE, size + 1)[..., :size]
                at = x[rows][np.arange(len(rows))[:, None, None], top[:, :, None] + np.arange(self.WIDE)]
                g["emb"] = np.zeros_like(self.p["emb"])
                np.add.at(g["emb"], at.ravel(), back.reshape(-1, size))
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)

    def calibrate(self, contexts: list[str], lengths: np.ndarray, y: np.ndarray, min_recall: float, kind: np.ndarray | None = None) -> None:
        """Platt scaling by Newton steps on smoothed labels; then the threshold, which keeps min_recall of the positives of each kind (all are one without it)."""
        z = self.logits(contexts, lengths).astype(np.float64)
        target = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
        w = np.array([1.0, 0.0])
        x = np.stack([z, np.ones_like(z)], axis=1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad, hess = x.T @ (p - target) + 1e-3 * (w - [1, 0]), (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            w -= np.linalg.solve(hess, grad)
        self.scale, self.shift = float(w[0]), float(w[1])
        p, kind = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), np.zeros(len(y), int) if kind is None else kind
        each = [np.sort(p[(y == 1) & (kind == k)]) for k in np.unique(kind[y == 1])]
        self.threshold = min((float(q[int((1 - min_recall) * len(q))]) for q in each), default=1.0)
        self.recall = {int(k): (int(((y == 1) & (kind == k)).sum()), float((p[(y == 1) & (kind == k)] >= self.threshold).mean())) for k in np.unique(kind[y == 1])}


def samples(n: int, seed: int = 3) -> list[tuple[str, int, int, int]]:
    """n texts with the span of a value in each and its label: secrets of many forms, and look-alikes."""
    rng = np.random.default_rng(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, k: "".join(np.array(list(chars))[rng.integers(0, len(chars), k)])
    words = lambda k: " ".join(some("etaoinshrdlu", int(rng.integers(2, 9))) for _ in range(k))
    digits, hexes, letters, special = "0123456789", "0123456789abcdef", alnum[:52], "!@$%^&*#"
    names = ["pwd", "auth", "credential", "private_key", "client_key", "passphrase", "access_code"]
    word = lambda: "".join(some("bcdfghlmnprstvw", 1) + some("aeiou", 1) + some("nrstl ", 1).strip() for _ in range(int(rng.integers(3, 6))))

    def trail(k: int) -> str:
        out, between = rng.choice(["/", "", "./"]) + word(), rng.choice(["/", ".", "_", "-", "="])
        while len(out) < k:
            out += between + word()
        return out

    secret = [
        lambda: (rng.choice(["pwd", "auth", "credential", "private_key", "client_key", "passphrase", "access_code"]) + rng.choice(["=", ": ", " = ", '="']), some(alnum, int(rng.integers(14, 40))) + some(digits, 2)),
        lambda: ("Authorization: Bearer ", some(alnum + "-_", int(rng.integers(24, 60))) + some(digits, 1)),
        lambda: ("", "ghp_" + some(alnum, 34) + some(digits, 2)),
        lambda: ("", "sk_live_" + some(alnum, 22) + some(digits, 2)),
        lambda: ("", "xoxb-" + some(digits, 11) + "-" + some(digits, 11) + "-" + some(alnum, 24)),
        lambda: ("", "eyJhbGciOiJIUzI1NiJ9." + some(alnum + "-_", 40) + "." + some(alnum + "-_", 30)),
        lambda: ("", "AIza" + some(alnum + "-_", 34) + some(digits, 1)),
        lambda: (rng.choice(["", "aws_key=", "id: "]), "ASIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)),
        lambda: (rng.choice(["key=", "sig=", "credential: "]), some(hexes, int(rng.integers(18, 31)))),
        lambda: ("key ", some(alnum + "+/", 38) + some(digits, 1) + "=="),
        lambda: (rng.choice(names) + rng.choice([": ", "=", " = "]), some(alnum + special, int(rng.integers(8, 12)))),
        lambda: (rng.choice(names) + rng.choice([": ", "=", " = "]), some(alnum, 4) + some(special, 1) + some(alnum, int(rng.integers(4, 9))) + some(special, 1) + some(alnum, 3)),
        lambda: (rng.choice(["", "key ", rng.choice(names) + ": "]), some(letters, int(rng.integers(16, 44)))),
        lambda: (rng.choice(names) + rng.choice([": ", "=", " = "]), some("abcdefghijklmnopqrstuvwxyz", int(rng.integers(8, 26)))),
        lambda: (trail(int(rng.integers(20, 120))) + "/", some(alnum, int(rng.integers(20, 40)))),
        lambda: (trail(int(rng.integers(20, 120))) + rng.choice([".", "_", "-"]), some(alnum, int(rng.integers(20, 40)))),
        lambda: (trail(int(rng.integers(20, 120))) + rng.choice(["=", "/key=", "?sig="]), some(alnum, int(rng.integers(20, 40)))),
    ]
    plain = [
        lambda: ("", some(digits, int(rng.integers(12, 20)))),
        lambda: ("call ", some(digits, 3) + "-" + some(digits, 3) + "-" + some(digits, 4)),
        lambda: ("", ".".join(str(x) for x in rng.integers(100, 255, 4))),
        lambda: ("", "-".join(some(hexes, k) for k in (8, 4, 4, 4, 12))),
        lambda: ("", some("abcdefghij", 6) + "." + some("klmnopqrst", 5) + some(digits, 2)),
        lambda: (rng.choice(["http://", "https://", "www.", "/usr/"]), some("abcdefgh", 6) + ".com/" + some("abcdefgh", 5) + "/" + some(digits, 4)),
        lambda: ("", f"20{rng.integers(10, 30)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{rng.integers(10, 24)}"),
        lambda: ("version ", f"release-{rng.integers(1, 30)}.{rng.integers(0, 20)}.{rng.integers(0, 9)}"),
        lambda: ("", some("etaoinshrdlu", int(rng.integers(8, 18))) + some(digits, int(rng.integers(1, 5)))),
        lambda: ("", some("etaoin", 5) + "_" + some("shrdlu", 5) + "_" + some(digits, 2)),
        lambda: ("", "=" * int(rng.integers(8, 20)) + some(digits, 2) + "=" * 6),
        lambda: ("", some("etaoinshrdlu", 6) + "..." + some(digits, 1) + "." + some("etaoin", 5)),
        lambda: ("", word() + word() + rng.choice(["", ".", "!", "?"])),
        lambda: ("", word().capitalize() + word() + rng.choice(["", "-" + word()])),
        lambda: ("", word().capitalize() + word().capitalize() + word().capitalize()),
        lambda: (rng.choice(["in ", "see ", "file "]), trail(int(rng.integers(12, 140)))),
        lambda: ("", word() + "@" + word() + rng.choice([".org", ".com", ".net"])),
        lambda: ("", some("=-*#!.$%_~", 1) * int(rng.integers(8, 80))),
        lambda: ("", word().upper() + rng.choice(["", "_" + word().upper()])),
    ]
    out = []
    for k in range(n):
        lead, value = (secret if k % 2 == 0 else plain)[int(rng.integers(0, len(secret if k % 2 == 0 else plain)))]()
        lead = f"{words(4)} {lead}"
        out.append((f"{lead}{value} {words(5)}", len(lead), len(lead) + len(value), int(k % 2 == 0)))
    return out


def generated(n: int, seed: int = 3) -> tuple[list[str], list[int], list[int]]:
    """A window of each of samples() that reads 8 or more characters of the value, or all that its run has, with the run's length from there and the label."""
    rng, contexts, lengths, labels = np.random.default_rng(seed), [], [], []
    for text, a, b, label in samples(n, seed):
        run = next(((m.start(), m.end()) for m in CANDIDATE.finditer(text) if a < m.end() and m.start() < b), (a, b))
        reads = [s for s in windows(*run) if min(b, s + AFTER) - max(a, s) >= 8]
        s = int(rng.choice(reads or [run[0]]))
        contexts.append(context(text, s))
        lengths.append(run[1] - s)
        labels.append(label)
    return contexts, lengths, labels


def findings(docs: DataFrame, most: int = 2000, seed: int = 5) -> DataFrame:
    """Windows of the corpus as in SAMPLE, for train(): of each slice of each label the most with the least hashes.

    A window is positive if it reads a part of a pattern finding; the others of such a run are left out.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: tuple[set, set] = (set(), set())
            for text in texts_of(batch):
                found = base_findings(text)
                spans = Spans(found)
                for a, b, y in candidates(text, found):
                    for s in windows(a, b):
                        if not y or spans.meet(s, min(b, s + AFTER)):
                            c = context(text, s)
                            rows[y].add((zlib.crc32(c.encode("utf-8", "surrogatepass"), seed), c, b - s))
                    if len(rows[y]) > 16 * most:
                        rows[y].intersection_update(heapq.nsmallest(most, rows[y]))
            picked = [(*r, y) for y in (0, 1) for r in heapq.nsmallest(most, rows[y])]
            yield record_batch(SAMPLE, dict(zip(("h", "context", "length", "label"), map(list, zip(*picked, strict=True)), strict=True)) if picked else {"h": [], "context": [], "length": [], "label": []})

    return docs.mapInArrow(find, SAMPLE)


def train(found: DataFrame, max_sample: int = 4000, min_recall: float = 0.98, seed: int = 5) -> Network:
    """A network from a bounded sample of the labelled windows, those with the least hashes."""
    rows = []
    for label in (0, 1):
        rows += found.where(F.col("label") == label).distinct().orderBy("h", "context", "length").limit(max_sample // 2).collect()
    contexts, lengths, labels = generated(max_sample)
    contexts, lengths, labels = contexts + [r.context for r in rows], np.array(lengths + [r.length for r in rows]), np.array(labels + [r.label for r in rows])
    held = np.random.default_rng(seed).random(len(labels)) < 0.25
    pick = lambda keep: ([c for c, k in zip(contexts, keep, strict=True) if k], lengths[keep], labels[keep])
    # a corpus candidate outside the patterns is not surely harmless: those that look like findings to a network
    # that was not told otherwise of them are not trained on
    corpus, half = (labels == 0) & (np.arange(len(labels)) >= max_sample), np.arange(len(labels)) % 2
    doubtful = np.zeros(len(labels), bool)
    for k in (0, 1):
        if (asked := corpus & (half == k)).any():
            net = Network()
            net.fit(*pick(~held & ~asked))
            doubtful[asked] = net.probabilities(*pick(asked)[:2]) > 0.5
    net = Network()
    net.fit(*pick(~held & ~doubtful))
    net.calibrate(*pick(held), min_recall, (np.arange(len(labels)) >= max_sample)[held].astype(int))
    return net


def scan_secrets(docs: DataFrame, *, max_sample: int = 4000, min_recall: float = 0.98) -> DataFrame:
    """All findings of each document; columns as in RESULT.

    Texts are read twice, for the sample and for the scan; only the sample is stored.
    scores: 1 for the patterns, else the calibrated probability.
    """
    docs = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    net = train(stored(findings(docs, max_sample // 2), "windows"), max_sample, min_recall)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch)
            rows, runs = [], []
            for i, text in enumerate(texts):
                found = base_findings(text)
                rows.append([(a, k, b, 1.0) for a, k, b in found])
                runs += [(i, a, b) for a, b, y in candidates(text, found) if not y]
            if runs:
                of, a, b = np.array(runs, np.int64).T
                n = np.maximum(1, -(-(b + TAIL - AFTER + STEP - a) // STEP))  # len(windows(a, b))
                first = np.cumsum(n) - n
                starts = np.repeat(a, n) + STEP * (np.arange(n.sum()) - np.repeat(first, n))
                p = net.calibrated(np.maximum.reduceat(net.run_logits(texts, np.repeat(of, n), starts, np.repeat(b, n) - starts), first))
                for k in np.flatnonzero(p >= net.threshold).tolist():
                    i, start, end = runs[k]
                    rows[i].append((start, KINDS.index("cnn"), end, float(p[k])))
            rows = [sorted(r) for r in rows]
            yield record_batch(RESULT, {"doc_id": batch.column("doc_id"), "kinds": [[KINDS[k] for _, k, _, _ in r] for r in rows], "starts": [[a for a, _, _, _ in r] for r in rows], "ends": [[b for _, _, b, _ in r] for r in rows], "scores": [[q for *_, q in r] for r in rows]})

    return docs.mapInArrow(judge, RESULT)


def digest(result: DataFrame) -> DataFrame:
    """Counts of each kind, the hash of the pattern spans and all spans as text."""
    zipped = F.arrays_zip("kinds", "starts", "ends")
    span = lambda x: F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string"))
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long")
    return result.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.array_join(F.transform(F.filter(zipped, lambda x: x["kinds"] != "cnn"), span), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(zipped, span), ",").alias("spans"),
        count("cnn").alias("n_cnn"),
    )
