"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A block's features are its ancestors' tags and the words of their classes and ids, how much of it is
linked, its length, its ending and its place; the chain has two states, main text or not. The field is
trained on labelled pages with exact gradients, and pages are decoded by Viterbi.

Defined results: null and empty html, and pages without main text, give an empty text; whole pages are
read, however long or broken; repeated rows are extracted separately; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cratewise.llm.dom import Block, blocks
from cratewise.llm.labelled import TELLING, labelled_pages
from cratewise.llm.words import text_chunks

STEPS, RATE, PENALTY = 150, 0.15, 2e-4
_LENGTHS = (2, 5, 12, 30, 80)
_LINKS = (0.01, 0.3, 0.7)
#: Phrases of page furniture in text, per feature.
SAYS = {
    "copyright": ("©", "all rights reserved", "copyright"),
    "cookie": ("cookie",),
    "subscribe": ("subscribe", "newsletter", "sign up", "log in", "sign in"),
    "share": ("share", "tweet", "facebook"),
    "comment": ("comment", "reply"),
    "legal": ("privacy", "terms of"),
    "advert": ("advert", "sponsored", "promoted"),
}


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features of every block of a page."""
    out, headed = [], False
    for i, b in enumerate(page):
        n = b.text.count(" ") + 1
        low = b.text.lower() if n <= 30 else ""
        own = [t for t in b.tags if t != "html"]
        names = [
            "bias",
            f"tag={b.last}",
            *{f"in={t}" for t in own},
            *[f"word={w}" for w in b.words],
            f"length={sum(n > x for x in _LENGTHS)}",
            f"links={sum(b.linked > x * len(b.text) for x in _LINKS)}",
            f"sentence={b.text[-1] in '.!?…:;\"”»'}",
            f"headed={headed}",
        ]
        names += [f"says={k}" for k, words in SAYS.items() if any(w in low for w in words)]
        for outer, inner in (("article", "header"), ("article", "footer"), ("main", "header"), ("td", "h1"), ("td", "p")):
            if outer in own and inner in own and own.index(outer) < own.index(inner):
                names.append(f"in={outer}>{inner}")
        names.append(f"long={n > 5}, linked={2 * b.linked > len(b.text)}, named={bool(b.words)}")
        if i == 0 or i == len(page) - 1:
            names.append("first" if i == 0 else "last")
            names.append(f"{names[-1]}, linked={2 * b.linked > len(b.text)}")
        headed |= "h1" in own
        out.append(names)
    return out


@dataclass
class Model:
    weights: dict[str, tuple[float, float]]  # of a feature, for a block that is not and one that is main text
    steps: np.ndarray  # of a state and the next

    def decode(self, page: list[Block]) -> list[bool]:
        """The most likely states of a page's blocks (Viterbi); ties go to main text."""
        (s00, s01), (s10, s11) = self.steps.tolist()
        get, none = self.weights.get, (0.0, 0.0)
        back, a, b = [], 0.0, 0.0
        for k, names in enumerate(features(page)):
            x = [get(f, none) for f in names]
            u, v = sum(w[0] for w in x), sum(w[1] for w in x)
            if not k:
                a, b = u, v
                continue
            to0, to1 = b + s10 >= a + s00, b + s11 >= a + s01
            back.append((to0, to1))
            a, b = (b + s10 if to0 else a + s00) + u, (b + s11 if to1 else a + s01) + v
        states = [b >= a]
        for to0, to1 in reversed(back):
            states.append(to1 if states[-1] else to0)
        return states[::-1] if page else []


def train(pages: list[tuple[str, list[bool]]]) -> Model:
    """Maximum conditional likelihood with an L2 penalty; all pages take each step of the chain together."""
    chains = [features(blocks(html, TELLING)) for html, _ in pages]
    index = {f: i for i, f in enumerate(sorted({f for c in chains for b in c for f in b}))}
    n, longest = len(chains), max(map(len, chains))
    x = np.zeros((sum(map(len, chains)), len(index)), np.float32)
    y, real = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for k, (c, (_, labels)) in enumerate(zip(chains, pages, strict=True)):
        if len(c) != len(labels):
            raise ValueError(f"labelled page {k} has {len(c)} blocks and {len(labels)} labels")
        y[k, : len(c)], real[k, : len(c)] = labels, True
    for row, names in zip(x, (b for c in chains for b in c), strict=True):
        row[[index[f] for f in names]] = 1
    pair = real[:, 1:]
    gold = np.zeros((n, longest, 2))
    gold[np.arange(n)[:, None], np.arange(longest)[None, :], y] = real
    gold_steps = np.einsum("nti,ntj->ij", gold[:, :-1] * pair[..., None], gold[:, 1:])
    w, s = np.zeros((len(index), 2)), np.zeros((2, 2))
    mw, vw, ms, vs = np.zeros_like(w), np.zeros_like(w), np.zeros_like(s), np.zeros_like(s)
    for step in range(1, STEPS + 1):
        u = np.zeros((n, longest, 2))
        u[real] = x @ w
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = u[:, 0]
        for t in range(1, longest):
            moved = np.logaddexp.reduce(alpha[:, t - 1, :, None] + s, axis=1) + u[:, t]
            alpha[:, t] = np.where(real[:, t, None], moved, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            moved = np.logaddexp.reduce(s + (u[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(real[:, t + 1, None], moved, 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        chance = np.exp(alpha + beta - z[:, None, None]) * real[..., None]
        joint = np.exp(alpha[:, :-1, :, None] + s + (u[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair[..., None, None]
        gw = x.T @ (chance - gold)[real] / n + PENALTY * w
        gs = (joint.sum((0, 1)) - gold_steps) / n + PENALTY * s
        mw, vw, ms, vs = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2, 0.9 * ms + 0.1 * gs, 0.99 * vs + 0.01 * gs**2
        fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w -= RATE * fix * mw / (np.sqrt(vw) + 1e-8)
        s -= RATE * fix * ms / (np.sqrt(vs) + 1e-8)
    return Model({f: (float(w[i, 0]), float(w[i, 1])) for f, i in index.items()}, s)


def main_text(html: str, model: Model) -> str:
    page = blocks(html, TELLING)
    return "\n".join(b.text for b, main in zip(page, model.decode(page), strict=True) if main)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of ``pages`` (``page_id``, ``url``, ``html``)."""
    model = model or train(labelled_pages())

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, htmls in text_chunks(batch, "html"):
                texts = [main_text(h.decode(), model) for h in htmls]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(extracted, "page_id bigint, url string, text string, n_chars bigint")
