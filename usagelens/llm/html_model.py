"""The block labeller: a bidirectional LSTM over the leaf blocks of a page, in numpy.

A block enters as the sum of learned vectors of its tag path's tokens, the shrunk mean of
learned vectors of its distinct hashed words, and a few measures of its text. One LSTM reads the blocks forwards,
one backwards; both states and the block itself give the roles by softmax. Pages of a batch
are padded to the longest and walked together, so a step is one small matrix product.
"""

from __future__ import annotations

import functools
import re
import zlib
from dataclasses import dataclass

import numpy as np

from usagelens.llm import html_samples
from usagelens.llm.html_blocks import BUCKETS, Block, blocks

ROLES = html_samples.ROLES
WORDS = 8192
#: A block's words count as one mean with so many that say nothing.
SHRINK = 3
PATH_WIDTH, WORD_WIDTH, HIDDEN = 24, 12, 24
#: Sampled pages, passes over them, pages of a step.
PAGES, PASSES, BATCH = 2000, 8, 24
_MEASURES = 14
_SPLIT = re.compile(r"\w+|[^\w\s]+")
_KNOWN: dict[str, int] = {}


def _word(word: str) -> int:
    if len(_KNOWN) > 200_000:
        _KNOWN.clear()
    _KNOWN[word] = place = zlib.crc32(word.lower().encode()) % WORDS
    return place


@dataclass
class Inputs:
    """Blocks as index lists (with their owners) and measures."""

    path: np.ndarray
    path_of: np.ndarray
    word: np.ndarray
    word_of: np.ndarray
    measures: np.ndarray
    n: int


def inputs(found: list[Block]) -> Inputs:
    n = len(found)
    path = [t for b in found for t in b.path]
    words: list[int] = []
    counts = []
    measures = np.zeros((n, _MEASURES), np.float32)
    get = _KNOWN.get
    for i, b in enumerate(found):
        own = _SPLIT.findall(b.text)
        places = [p if (p := get(w)) is not None else _word(w) for w in dict.fromkeys(own)]
        words += places
        counts.append(len(places))
        size, text = len(b.text), b.text
        measures[i] = (
            np.log1p(size) / 6,
            np.log1p(len(own)) / 5,
            min(1.0, b.linked / size),
            text[-1] in ".!?…:",
            text.count(",") * 10 / size,
            b.leaf in ("h1", "h2", "h3", "h4", "h5", "h6"),
            b.leaf == "p",
            b.leaf == "li",
            "a" in b.inline,
            any(c.isdigit() for c in text[:1] + text[-1:]),
            "©" in text,
            i == 0,
            i == n - 1,
            1.0,
        )
    sizes = np.fromiter((len(b.path) for b in found), np.int64, n)
    return Inputs(
        np.array(path, np.int64),
        np.repeat(np.arange(n), sizes),
        np.array(words, np.int64),
        np.repeat(np.arange(n), np.array(counts, np.int64)),
        measures,
        n,
    )


def _sum_by(table: np.ndarray, index: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of table rows by owner; owners ascend."""
    out = np.zeros((n, table.shape[1]), np.float32)
    if len(index):
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        for k in range(0, len(first), 4096):  # bounded parts
            stop = first[k + 4096] if k + 4096 < len(first) else len(index)
            part = first[k : k + 4096]
            out[owner[part]] = np.add.reduceat(table[index[part[0] : stop]], part - part[0], axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Labeller:
    """Parameters by name; ``fit`` trains them."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        width = PATH_WIDTH + WORD_WIDTH + _MEASURES
        self.p = {
            "path": rng.normal(0, 0.3, (BUCKETS, PATH_WIDTH)),
            "word": np.zeros((WORDS, WORD_WIDTH)),  # a word never seen says nothing
            "out": rng.normal(0, 0.1, (2 * HIDDEN + width, len(ROLES))),
            "bias": np.zeros(len(ROLES)),
        }
        # words start from nothing, so what reads them must not
        for side in "fb":
            self.p[f"x{side}"] = rng.normal(0, 0.2, (width, 4 * HIDDEN))
            self.p[f"h{side}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            self.p[f"c{side}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def vectors(self, x: Inputs) -> np.ndarray:
        path = _sum_by(self.p["path"], x.path, x.path_of, x.n) / 3
        counts = np.bincount(x.word_of, minlength=x.n)[:, None] + SHRINK
        word = _sum_by(self.p["word"], x.word, x.word_of, x.n) / counts
        return np.concatenate([path, word.astype(np.float32), x.measures], axis=1)

    def _walk(self, side: str, z: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States of all steps of (steps, pages, gates); with the gates, if they are to be kept."""
        steps, many, _ = z.shape
        hidden, weights = HIDDEN, self.p[f"h{side}"]
        h = np.zeros((many, hidden), np.float32)
        c = np.zeros((many, hidden), np.float32)
        states = np.empty((steps, many, hidden), np.float32)
        kept = []
        for t in range(steps):
            a = z[t] + h @ weights
            gates = _sigmoid(a[:, : 3 * hidden])
            g = np.tanh(a[:, 3 * hidden :])
            before = c
            c = gates[:, hidden : 2 * hidden] * c + gates[:, :hidden] * g
            s = np.tanh(c)
            previous, h = h, gates[:, 2 * hidden :] * s
            states[t] = h
            if keep:
                kept.append((gates, g, before, s, previous))
        return states, kept

    def _back(self, side: str, kept: list, dstates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the gates' inputs and of the recurrent weights."""
        steps, many, hidden = dstates.shape
        weights = self.p[f"h{side}"]
        dz = np.empty((steps, many, 4 * hidden), np.float32)
        dh = np.zeros((many, hidden), np.float32)
        dc = np.zeros((many, hidden), np.float32)
        dweights = np.zeros_like(weights)
        for t in range(steps - 1, -1, -1):
            gates, g, before, s, previous = kept[t]
            i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
            dh = dh + dstates[t]
            dc = dc + dh * o * (1 - s * s)
            d = dz[t]
            d[:, :hidden] = dc * g * i * (1 - i)
            d[:, hidden : 2 * hidden] = dc * before * f * (1 - f)
            d[:, 2 * hidden : 3 * hidden] = dh * s * o * (1 - o)
            d[:, 3 * hidden :] = dc * i * (1 - g * g)
            dweights += previous.T @ d
            dh = d @ weights.T
            dc = dc * f
        return dz, dweights

    def scores(self, x: Inputs, sizes: np.ndarray, train: bool = False) -> tuple:
        """Scores of all blocks of pages of these sizes (each one or more), in page order."""
        v = self.vectors(x)
        steps, many = int(sizes.max()), len(sizes)
        page = np.repeat(np.arange(many), sizes)
        step = np.arange(x.n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        turned = sizes[page] - 1 - step
        sides, memory = [], {}
        for side, at in (("f", step), ("b", turned)):
            z = np.zeros((steps, many, 4 * HIDDEN), np.float32)
            z[at, page] = v @ self.p[f"x{side}"] + self.p[f"c{side}"]
            states, kept = self._walk(side, z, train)
            sides.append(states[at, page])
            memory[side] = (at, kept)
        full = np.concatenate([*sides, v], axis=1)
        return full @ self.p["out"] + self.p["bias"], (full, v, page, steps, many, memory)

    def _gradients(self, x: Inputs, sizes: np.ndarray, roles: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        scores, (full, v, page, steps, many, memory) = self.scores(x, sizes, train=True)
        scores = scores - scores.max(axis=1, keepdims=True)
        prob = np.exp(scores)
        prob /= prob.sum(axis=1, keepdims=True)
        loss = float(-np.log(prob[np.arange(x.n), roles] + 1e-9).mean())
        d = prob
        d[np.arange(x.n), roles] -= 1
        d /= x.n
        grad = {"out": full.T @ d, "bias": d.sum(axis=0)}
        dfull = d @ self.p["out"].T
        dv = dfull[:, 2 * HIDDEN :].copy()
        for k, side in enumerate("fb"):
            at, kept = memory[side]
            dstates = np.zeros((steps, many, HIDDEN), np.float32)
            dstates[at, page] = dfull[:, k * HIDDEN : (k + 1) * HIDDEN]
            dz, grad[f"h{side}"] = self._back(side, kept, dstates)
            own = dz[at, page]
            grad[f"x{side}"], grad[f"c{side}"] = v.T @ own, own.sum(axis=0)
            dv += own @ self.p[f"x{side}"].T
        dpath = np.zeros_like(self.p["path"])
        np.add.at(dpath, x.path, dv[x.path_of, :PATH_WIDTH] / 3)
        counts = np.bincount(x.word_of, minlength=x.n) + SHRINK
        dword = np.zeros_like(self.p["word"])
        share = dv[:, PATH_WIDTH : PATH_WIDTH + WORD_WIDTH] / counts[:, None]
        np.add.at(dword, x.word, share[x.word_of])
        return loss, grad | {"path": dpath, "word": dword}

    def fit(self, pages: list[list[Block]], passes: int = PASSES, batch: int = BATCH, seed: int = 7) -> Labeller:
        """Adam over batches of pages, each block with its mark as role."""
        rng = np.random.default_rng(seed)
        pages = [p for p in pages if p]
        ready = [(inputs(p), np.array([ROLES.index(b.mark) for b in p])) for p in pages]
        order_by = np.array([len(p) for p in pages])
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t, rounds = 0, passes * -(-len(pages) // batch)
        for _ in range(passes):
            # pages of about one length together, so that padding stays small
            order = np.argsort(order_by + rng.random(len(pages)) * 8, kind="stable")
            parts = [order[k : k + batch] for k in range(0, len(order), batch)]
            for k in rng.permutation(len(parts)):
                own = [ready[i] for i in parts[k]]
                x, sizes, roles = _joined([a for a, _ in own]), np.array([a.n for a, _ in own]), np.concatenate([r for _, r in own])
                # path tokens and words are left out at random: no name may decide alone
                x = _dropped(x, rng)
                _, grad = self._gradients(x, sizes, roles)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                t += 1
                rate = 0.012 * (1 - 0.9 * t / rounds) * min(1.0, 5.0 / (norm + 1e-9))
                for name, g in grad.items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    s[name] = 0.99 * s[name] + 0.01 * g * g
                    self.p[name] -= rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(s[name] / (1 - 0.99**t)) + 1e-7)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Probabilities of the roles of every block of each page."""
        out: list[np.ndarray] = [np.zeros((0, len(ROLES)), np.float32)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            part = [order[at]]
            # few blocks of padding, and a bounded number of steps times pages
            while (
                at + len(part) < len(order)
                and len(part) < 128
                and (len(part) + 1) * len(pages[order[at + len(part)]]) <= 16_384
            ):
                part.append(order[at + len(part)])
            at += len(part)
            x = inputs([b for i in part for b in pages[i]]) if len(part) == 1 else _joined([inputs(pages[i]) for i in part])
            sizes = np.array([len(pages[i]) for i in part])
            scores, _ = self.scores(x, sizes)
            scores -= scores.max(axis=1, keepdims=True)
            prob = np.exp(scores)
            prob /= prob.sum(axis=1, keepdims=True)
            for i, own in zip(part, np.split(prob, np.cumsum(sizes)[:-1]), strict=True):
                out[i] = own
        return out


def _joined(parts: list[Inputs]) -> Inputs:
    at = np.cumsum([0] + [x.n for x in parts])
    return Inputs(
        np.concatenate([x.path for x in parts]),
        np.concatenate([x.path_of + k for x, k in zip(parts, at, strict=False)]),
        np.concatenate([x.word for x in parts]),
        np.concatenate([x.word_of + k for x, k in zip(parts, at, strict=False)]),
        np.concatenate([x.measures for x in parts]),
        int(at[-1]),
    )


def _dropped(x: Inputs, rng: np.random.Generator, share: float = 0.03) -> Inputs:
    path, word = rng.random(len(x.path)) > share, rng.random(len(x.word)) > 0.2
    # of some blocks only the place in the page is seen
    measures = x.measures.copy()
    measures[rng.random(x.n) < 0.15, :5] = 0
    return Inputs(x.path[path], x.path_of[path], x.word[word], x.word_of[word], measures, x.n)


@functools.lru_cache(maxsize=2)
def trained(pages: int = PAGES, passes: int = PASSES, seed: int = 7) -> Labeller:
    """A labeller fitted on sampled pages; the number of pages bounds the fit."""
    sample = [blocks(p) for p in html_samples.pages(pages, seed)]
    return Labeller(seed).fit(sample, passes, seed=seed)
