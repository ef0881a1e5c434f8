"""A small masked language model over windows of words: trained by averaging what workers learn, generating by denoising in steps."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.functions.text import sentences

#: The mask's word and place, the floor of a probability and the bound of a gradient.
MASK_WORD, MASK, FLOOR, BOUND = "[MASK]", 0, 1e-10, 5.0
#: Weights in a row of the table that workers' results are averaged in.
SLOT = 4096
#: Sentences that are masked and shuffled together, and sentences of a worker's share about.
GROUP, SHARE = 1024, 100_000


@dataclass(frozen=True)
class Shape:
    radius: int = 4
    width: int = 16
    hidden: int = 32
    masked: float = 0.4
    rate: float = 0.5
    batch: int = 8


def corpus(docs: DataFrame, text: str) -> DataFrame:
    """(sentence, words): lower-cased sentences of three words or more; a null text has none."""
    rows = docs.select(F.explode(sentences(F.coalesce(F.col(text), F.lit("")))).alias("s")).select(F.lower("s").alias("sentence"))
    return rows.withColumn("words", F.filter(F.split("sentence", r"\s+"), lambda w: w != ""))


def vocabulary(rows: DataFrame, most: int) -> list[str]:
    """The mask, then the `most` commonest words in order of the alphabet: a bounded table, counted over all rows."""
    top = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [MASK_WORD, *sorted(r["word"] for r in top.collect())]


def started(size: int, shape: Shape, seed: int = 42) -> dict[str, np.ndarray]:
    rng, span = np.random.default_rng(seed), 2 * shape.radius + 1
    sizes = {"emb": (size, shape.width), "pos": (span, shape.width), "w1": (span * shape.width, shape.hidden), "b1": (shape.hidden,), "w2": (shape.hidden, size), "b2": (size,)}
    return {k: np.zeros(s) if len(s) == 1 else rng.normal(0, s[0] ** -0.5 if k[0] == "w" else 0.1, s) for k, s in sizes.items()}


def windows(ids: np.ndarray, radius: int) -> np.ndarray:
    """Each place's ids from `radius` before to `radius` after; the mask beyond the ends."""
    return np.lib.stride_tricks.sliding_window_view(np.pad(ids, radius, constant_values=MASK), 2 * radius + 1)


def forward(w: dict, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = (w["emb"][seen] + w["pos"]).reshape(len(seen), -1)
    h = np.maximum(x @ w["w1"] + w["b1"], 0)
    return h @ w["w2"] + w["b2"], h, x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def gradients(w: dict, seen: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Sum of the cross-entropies, and the gradient of their mean."""
    z, h, x = forward(w, seen)
    p = softmax(z)
    n, at = len(target), np.arange(len(target))
    loss = float(-np.log(np.maximum(p[at, target], FLOOR)).sum())
    p[at, target] -= 1
    dz = p / n
    dh = (dz @ w["w2"].T) * (h > 0)
    dx = (dh @ w["w1"].T).reshape(n, *w["pos"].shape)
    emb = np.zeros_like(w["emb"])
    np.add.at(emb, seen, dx)
    return loss, {"emb": emb, "pos": dx.sum(axis=0), "w1": x.T @ dh, "b1": dh.sum(axis=0), "w2": h.T @ dz, "b2": dz.sum(axis=0)}


def masked_windows(words: list, index: dict, shape: Shape, rng: np.random.Generator, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Windows around masked places and the ids that were there, shuffled.

    An unknown word is a mask that nothing is learnt from; with `whole`, a sentence that has one gives nothing.
    """
    seen, target = [np.zeros((0, 2 * shape.radius + 1), int)], [np.zeros(0, int)]
    for ws in words:
        if not len(ws):
            continue
        ids = np.array([index.get(x, MASK) for x in ws])
        hidden = rng.random(len(ids)) < shape.masked
        if not whole or (ids != MASK).all():
            at = hidden & (ids != MASK)
            seen.append(windows(np.where(hidden, MASK, ids), shape.radius)[at])
            target.append(ids[at])
    order = rng.permutation(sum(len(t) for t in target))
    return np.concatenate(seen)[order], np.concatenate(target)[order]


def in_groups(frames, size: int):
    """Lists of `size` sentences, however the batches they come in are cut; the last list may be shorter."""
    held: list = []
    for f in frames:
        held += list(f["words"])
        while len(held) >= size:
            yield held[:size]
            held = held[size:]
    if held:
        yield held


def train(rows: DataFrame, words: list[str], epochs: int, shape: Shape = Shape(), workers: int | None = None, whole: bool = False) -> tuple[dict[str, np.ndarray], list[tuple[int, float, int]]]:
    """Weights, and (epoch, mean loss, masked places) of each epoch; no rows: the first weights and losses of 0.

    Each epoch every worker starts from the same weights and steps through its own share of all sentences; the results
    are averaged, each by its number of places. The rate falls along a cosine to a tenth. Only averages reach the driver:
    as many numbers as the model has. There are eight workers, or one for each SHARE sentences if those are more. A worker's
    share, its masks and its order depend on the sentences and the epoch alone, not on how Arrow cuts them into batches.
    """
    index = {x: i for i, x in enumerate(words) if i != MASK}
    w, told = started(len(words), shape), []
    names, sizes = list(w), [v.shape for v in w.values()]
    workers = workers or max(8, -(-rows.count() // SHARE))
    dealt = rows.repartition(workers, "sentence").sortWithinPartitions("sentence").persist()

    def learnt(start: dict, epoch: int, rate: float):
        def run(frames):
            own, total, n = {k: v.copy() for k, v in start.items()}, 0.0, 0
            for k, group in enumerate(in_groups(frames, GROUP)):
                rng = np.random.default_rng([epoch, k, zlib.crc32(" ".join(group[0]).encode())])
                seen, target = masked_windows(group, index, shape, rng, whole)
                for i in range(0, len(target), shape.batch):
                    loss, g = gradients(own, seen[i : i + shape.batch], target[i : i + shape.batch])
                    total += loss
                    for k, v in g.items():
                        own[k] -= rate * np.clip(v, -BOUND, BOUND)
                n += len(target)
            if n:
                flat = np.concatenate([own[k].ravel() for k in names]) * n
                at = range(0, len(flat), SLOT)
                yield pd.DataFrame({"slot": list(at), "n": n, "loss": total, "v": [flat[i : i + SLOT] for i in at]})

        return run

    def summed(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["n", "loss"])
        return pd.DataFrame({"slot": f["slot"][:1], "n": f["n"].sum(), "loss": f["loss"].sum(), "v": [np.sum(list(f["v"]), axis=0)]})

    kind = "slot long, n long, loss double, v array<double>"
    try:
        for epoch in range(epochs):
            rate = shape.rate * (0.1 + 0.45 * (1 + np.cos(np.pi * epoch / epochs)))
            got = sorted(dealt.select("words").mapInPandas(learnt(w, epoch, rate), kind).groupBy("slot").applyInPandas(summed, kind).collect())
            n = got[0]["n"] if got else 0
            told.append((epoch, got[0]["loss"] / n if n else 0.0, n))
            if n:
                flat = np.concatenate([r["v"] for r in got]) / n
                parts = np.split(flat, np.cumsum([int(np.prod(s)) for s in sizes])[:-1])
                w = {k: v.reshape(s) for k, v, s in zip(names, parts, sizes, strict=True)}
    finally:
        dealt.unpersist()
    return w, told


def drawn(p: np.ndarray, k: int, rng: np.random.Generator) -> int:
    """One of the k likeliest, in proportion; the lowest id among equals."""
    top = np.argsort(-p, kind="stable")[:k]
    upto = np.cumsum(p[top])
    return int(top[min(np.searchsorted(upto, rng.random() * upto[-1], side="right"), len(top) - 1)])


def denoised(w: dict, ids: list[int], n: int, shape: Shape, steps: int = 10, heat: float = 0.5, k: int = 8, seed: int = 0) -> list[int]:
    """n ids after the prompt's: all masked at first; each step fills the most confident places, the last step all."""
    rng = np.random.default_rng(seed)
    seq = np.array([*ids, *[MASK] * n])
    for step in range(steps):
        left = len(ids) + np.flatnonzero(seq[len(ids) :] == MASK)
        if not len(left):
            break
        p = softmax(forward(w, windows(seq, shape.radius)[left])[0] / heat)
        found = np.array([drawn(x, k, rng) for x in p])
        sure = np.argsort(-p[np.arange(len(left)), found], kind="stable")[: -(-len(left) * (step + 1) // steps)]
        seq[left[sure]] = found[sure]
    return seq[len(ids) :].tolist()


def revealed(w: dict, n: int, shape: Shape, steps: int = 20) -> list[int]:
    """n ids out of masks alone: each step predicts every place anew and keeps the surest, a share that grows to all; places as sure as the last one kept stay too."""
    seq = np.full(n, MASK)
    for step in range(steps if n else 0):
        p = softmax(forward(w, windows(seq, shape.radius))[0])
        found, sure = p.argmax(axis=1), p.max(axis=1)
        k = n * (step + 1) // steps
        limit = np.sort(sure)[::-1][k - 1] if k else np.inf
        seq = np.where(sure >= limit, found, MASK)
    return seq.tolist()


def unmask(lengths: DataFrame, column: str, w: dict, words: list[str], shape: Shape = Shape(), steps: int = 20) -> DataFrame:
    """(length, generated): for each row as many words out of masks alone; a mask that is left stays visible, a null length is none."""

    def run(frames):
        for f in frames:
            made = [" ".join(words[i] for i in revealed(w, 0 if pd.isna(n) else int(n), shape, steps)) for n in f[column]]
            yield pd.DataFrame({column: f[column], "generated": made})

    return lengths.select(F.col(column).cast("long").alias(column)).mapInPandas(run, f"{column} long, generated string")


def generate(prompts: DataFrame, key: str, text: str, w: dict, words: list[str], n: int, shape: Shape = Shape()) -> DataFrame:
    """(key, generated): n places after each prompt, masks left out; unknown words of the prompt are masks, a null prompt is empty."""
    index = {x: i for i, x in enumerate(words) if i != MASK}

    def run(frames):
        for f in frames:
            out = []
            for t in f["_t"]:
                ids = denoised(w, [index.get(x, MASK) for x in t.split()], n, shape, seed=zlib.crc32(t.encode()))
                out.append(" ".join(words[i] for i in ids if i != MASK))
            yield pd.DataFrame({key: f[key], "generated": out})

    rows = prompts.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    return rows.mapInPandas(run, f"{key} {prompts.schema[key].dataType.simpleString()}, generated string")
