"""A convolutional text classifier: hashed word embeddings, filters of several widths, max pooling, trained in numpy.

Spark splits texts into words and hashes them; numpy sees only word numbers. A filter of width w is w tables of
(bucket, filter) responses, so a convolution is w gathers and a sum, and the maximum over a text needs no more than
the text. Training and calibration take every labelled row, scoring every text, all of them whole. A round of training
is one Spark job: each block of rows moves the same model on its own, and the moves are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KeyFilter, discard, map_batches, materialize

#: Buckets of the word hash (0 pads), embedding size, filters of each width, widths.
BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
#: Rounds over all training rows, passes of a block in a round, the step size, and the unit in which moves are summed: whole numbers, so their order makes no difference.
EPOCHS, PASSES, RATE, UNIT = 4, 2, 0.02, 2.0**-24
#: Rows and words of a block of training rows at most (one text alone may have more words), and labelled rows of a partition about.
BLOCK_ROWS, BLOCK_WORDS, PART_ROWS = 2500, 1 << 22, 4000
#: Calibration counts rows by raw score: so many steps of one, and the largest raw score told apart.
STEPS, FAR = 256, 32
#: The score from which a document is toxic, and the least precision that a language's own threshold must reach on held-in rows.
LIMIT, PRECISION = 0.3, 0.8

#: Words are runs of letters; case is folded by Spark's lower.
_SPLIT = r"[^\p{L}]+"


def words(text: Column, buckets: int = BUCKETS) -> Column:
    """Word numbers 1..buckets-1 of a text, in order (null: none)."""
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT), lambda w: w != "")
    return F.transform(parts, lambda w: (F.pmod(F.xxhash64(w), F.lit(buckets - 1)) + 1).cast("int"))


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    responses: list[np.ndarray] | None = None

    def tables(self) -> list[np.ndarray]:
        """For each filter width, the response of each bucket at each place: shape (width, buckets, filters); worked out once."""
        if self.responses is None:
            self.responses = [np.stack([self.embedding @ w[k] for k in range(len(w))]).astype(np.float32) for w in self.filters]
        return self.responses


def _pad(flat: np.ndarray, lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another with most-1 zeros before each; the starts. An empty text is one zero."""
    gaps = np.maximum(lengths, 1) + most - 1
    starts = np.cumsum(gaps) - gaps
    out = np.zeros(int(gaps.sum()), np.int32)
    at = np.repeat(starts + most - 1 - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(flat))
    out[at] = flat
    return out, starts


def pooled(tables: list[np.ndarray], bias: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Largest response of each filter in each text, (texts, filters); no less than zero."""
    most = max(len(t) for t in tables)
    ids, starts = _pad(flat, lengths, most)
    ids = np.concatenate((ids, np.zeros(most - 1, np.int32)))
    parts = []
    n = len(ids) - most + 1
    for t in tables:
        sums = t[0][ids[:n]]
        for k in range(1, len(t)):
            sums += t[k][ids[k : n + k]]
        parts.append(np.maximum.reduceat(sums, starts, axis=0))
    return np.maximum(np.concatenate(parts, axis=1) + bias, 0)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start(rows: tuple[int, int], seen: np.ndarray, seed: int = 7) -> Model:
    """The model before training, from the number of rows of each class and of those that have each bucket, (2, buckets).

    The first embedding channel starts as each bucket's smoothed log odds and one filter of each width passes it on;
    the rest starts small and random. Without rows of both classes the model scores all texts alike.
    """
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
    e[0] = 0
    model = Model(e, [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)
    clean, toxic = rows
    if not clean or not toxic:
        model.out[:] = 0
        model.out_bias = float(np.log((toxic + 0.1) / (clean + 1)))
        return model
    odds = np.log((seen[1] + 0.3) / (toxic + 0.6)) - np.log((seen[0] + 0.3) / (clean + 0.6))
    support = seen.sum(axis=0) / (seen.sum(axis=0) + 2)
    e[1:, 0] = np.clip(odds * support, -2, 4)[1:]
    for w in model.filters:
        w[:, 0, 0] = 1 / len(w)
        w[:, 1:, 0] = 0
    model.out[::FILTERS] = 1
    model.out_bias = float(np.log(toxic / clean))
    return model


def seen_in(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Texts of each class that have each bucket, (2, buckets)."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for ids, label in zip(texts, labels, strict=True):
        seen[int(label), np.unique(ids)] += 1
    return seen


def train(texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """One block alone, from its own start."""
    model = start((int((labels == 0).sum()), int((labels == 1).sum())), seen_in(texts, labels), seed)
    return learn(model, texts, labels, weights, epochs, rate, seed) if model.out.any() else model


def learn(model: Model, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int, rate: float, seed: int) -> Model:
    """Adagrad on weighted log loss, small batches in a fixed shuffled order; changes the model and returns it."""
    rng, y = np.random.default_rng(seed), labels.astype(np.float64)
    most, grads = max(WIDTHS), {}

    def step(name, value, grad, at=None):
        old = grads.setdefault(name, np.full_like(value, 1e-6))
        if at is None:
            old += grad * grad
            value -= rate * grad / np.sqrt(old)
        else:
            old[at] += grad * grad
            value[at] -= rate * grad / np.sqrt(old[at])

    lengths = np.array([len(t) for t in texts])
    bias_box = np.array([model.out_bias])
    for _ in range(epochs):
        for pick in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 50)):
            flat = np.concatenate([texts[i] for i in pick])
            ids, starts = _pad(flat, lengths[pick], most)
            ids = np.concatenate((ids, np.zeros(most - 1, np.int32)))
            n = len(ids) - most + 1
            used, local = np.unique(ids, return_inverse=True)
            own = model.embedding[used]
            acts, places = [], []
            for w in model.filters:
                tables = [own @ w[k] for k in range(len(w))]
                sums = tables[0][local[:n]]
                for k in range(1, len(w)):
                    sums = sums + tables[k][local[k : n + k]]
                ends = np.append(starts[1:], n)
                at = np.stack([s + sums[s:t].argmax(axis=0) for s, t in zip(starts.tolist(), ends.tolist(), strict=True)])
                places.append(at)
                acts.append(np.take_along_axis(sums, at, axis=0))
            pre = np.concatenate(acts, axis=1) + model.bias
            hidden = np.maximum(pre, 0)
            delta = (_logistic(hidden @ model.out + bias_box[0]) - y[pick]) * weights[pick] / weights[pick].sum()
            back = (delta[:, None] * model.out) * (pre > 0)
            change = np.zeros_like(own)
            step("out", model.out, (hidden.T @ delta + 1e-4 * model.out).astype(np.float32))
            step("out_bias", bias_box, np.array([delta.sum()]))
            step("bias", model.bias, back.sum(axis=0).astype(np.float32))
            for j, w in enumerate(model.filters):
                g = back[:, j * FILTERS : (j + 1) * FILTERS].astype(np.float32)
                grad = np.zeros_like(w)
                for k in range(len(w)):
                    there = local[places[j] + k]  # (texts, filters)
                    grad[k] = np.einsum("tf,tfs->sf", g, own[there])
                    np.add.at(change, there, g[:, :, None] * w[k].T[None])
                step(f"filter{j}", w, grad)
            change[used == 0] = 0
            step("embedding", model.embedding, change, used)
    model.out_bias = float(bias_box[0])
    return model


def raw_scores(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    tables, out = model.tables(), []
    for i in range(0, len(texts), 200):
        part = texts[i : i + 200]
        out.append(pooled(tables, model.bias, np.concatenate(part).astype(np.int32), np.array([len(t) for t in part])) @ model.out + model.out_bias)
    return np.concatenate(out) if out else np.zeros(0)


def platt(raw: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a weighted logistic fit, by Newton steps, each halved until the loss falls."""

    def loss(a, b):
        x = a * raw + b
        return float((weights * (np.logaddexp(0, x) - y * x)).sum() + 5e-4 * a * a)

    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = _logistic(at[0] * raw + at[1])
        g, h = weights * (p - y), weights * np.maximum(p * (1 - p), 1e-6)
        m = np.array([[(h * raw * raw).sum() + 1e-3, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-3]])
        move = np.linalg.solve(m, np.array([(g * raw).sum() + 1e-3 * at[0], g.sum()]))
        now, part = loss(*at), 1.0
        while part > 1e-6 and not loss(*(at - part * move)) < now:
            part /= 2
        if part <= 1e-6:
            break
        at = at - part * move
    return (float(max(at[0], 1e-3)), float(at[1]))


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, KeyFilter, DataFrame]:
    """Every row of docs that has a label and whose crc32(doc_id) mod 4 is not 2 (y, apart, lang, words), in parts that its
    values alone decide; the filter of the labels' ids and the labels, both written.

    Labels that are null or name no document are passed over; all rows of a repeated doc_id have its label.
    """
    y = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("y"))
    y = materialize(y.filter(~held_out(F.col("id"))), "labels")
    near = KeyFilter(y, ["id"])
    mine, _ = near.split(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("_text"), F.col("lang").cast("string").alias("lang")))
    # words are made, and shuffled, of rows that a filter of the labelled ids lets pass
    rows = mine.select("id", "lang", words(F.col("_text")).alias("words")).join(y.hint("merge"), "id")
    rows = rows.select("y", _apart(F.col("id")).alias("apart"), "lang", "words", F.xxhash64("id", F.lit(11)).alias("_by"), F.xxhash64("words", "lang").alias("_of"))
    return rows.repartition(max(1, -(-near.n // PART_ROWS)), "_by", "_of").sortWithinPartitions("_by", "_of").drop("_by", "_of"), near, y


def _apart(doc_id: Column) -> Column:
    """A quarter of the labelled rows: they calibrate, the others train."""
    return F.shiftright(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), 2).bitwiseAND(F.lit(3)) == 3


def blocks_of(rows: DataFrame) -> DataFrame:
    """labelled() rows packed, in their order, into blocks of training and of calibration rows: apart, y, lengths and words as packed integers, langs."""

    def tasks(batches):
        held, size = {False: [], True: []}, {False: 0, True: 0}

        def block(apart):
            y, texts, langs = zip(*held[apart], strict=True)
            held[apart], size[apart] = [], 0
            packed = [np.array(y, np.int8), np.array(list(map(len, texts)), "<i4"), np.concatenate(texts).astype("<i4")]
            return pa.RecordBatch.from_arrays([pa.array([apart]), *(pa.array([x.tobytes()], pa.binary()) for x in packed), pa.array([langs if apart else []], pa.list_(pa.string()))], names=["apart", "y", "lengths", "words", "langs"])

        for b in batches:
            column = b.column(3)
            texts = _split(column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()))
            for y, apart, lang, own in zip(*(b.column(k).to_pylist() for k in range(3)), texts, strict=True):
                if held[apart] and (len(held[apart]) == BLOCK_ROWS or size[apart] + len(own) > BLOCK_WORDS):
                    yield block(apart)
                held[apart].append((y, own.copy(), lang))
                size[apart] += len(own)
        yield from (block(apart) for apart in held if held[apart])

    return map_batches(rows, tasks, "apart boolean, y binary, lengths binary, words binary, langs array<string>")


def _split(flat: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(lengths)
    return [flat[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


def _opened(batches) -> Iterator[tuple[np.ndarray, list[np.ndarray], list]]:
    """Labels, texts and languages of each block."""
    for b in batches:
        for i in range(b.num_rows):
            y, lengths, flat = (np.frombuffer(b.column(k)[i].as_buffer(), t) for k, t in ((1, np.int8), (2, "<i4"), (3, "<i4")))
            yield y.astype(np.int64), _split(flat, lengths), b.column(4)[i].as_py()


def class_counts(blocks: DataFrame) -> tuple[tuple[int, int], np.ndarray]:
    """Training rows of each class, and of those the rows that have each bucket: what start() asks for, from all training rows."""

    def tasks(batches):
        seen = np.zeros((2, BUCKETS), np.int64)
        for y, texts, _ in _opened(batches):
            own = seen_in(texts, y)
            own[:, 0] = np.bincount(y, minlength=2)  # no word has bucket 0: it counts the rows
            seen += own
        met = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(seen[0, met]), pa.array(seen[1, met])], names=["bucket", "clean", "toxic"])

    counted = map_batches(blocks.filter("NOT apart"), tasks, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    seen = np.zeros((2, BUCKETS), np.int64)
    seen[:, counted["bucket"].to_numpy()] = np.stack([counted["clean"].to_numpy(), counted["toxic"].to_numpy()])
    rows = (int(seen[0, 0]), int(seen[1, 0]))
    seen[:, 0] = 0
    return rows, seen


def _vectors(model: Model) -> np.ndarray:
    """All that is learnt, as rows of SIZE numbers: the embedding, then the rest."""
    rest = np.concatenate([*(w.ravel() for w in model.filters), model.bias, model.out, [model.out_bias]])
    return np.concatenate([model.embedding, np.pad(rest, (0, -len(rest) % SIZE)).reshape(-1, SIZE)]).astype(np.float64)


def _model_of(vectors: np.ndarray) -> Model:
    rest, at, filters = vectors[BUCKETS:].ravel(), 0, []
    for w in WIDTHS:
        filters.append(rest[at : at + w * SIZE * FILTERS].reshape(w, SIZE, FILTERS).astype(np.float32))
        at += w * SIZE * FILTERS
    n = FILTERS * len(WIDTHS)
    return Model(vectors[:BUCKETS].astype(np.float32), filters, rest[at : at + n].astype(np.float32), rest[at + n : at + 2 * n].astype(np.float32), float(rest[at + 2 * n]))


def one_round(blocks: DataFrame, model: Model, seed: int) -> Model:
    """Each block of training rows learns from the same model; each number moves by the mean of the moves of the blocks that move its row.

    A task sends a row for each bucket it has moved, summed over its blocks; the driver gets no more than the model has.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(_vectors(model))

    def tasks(batches):
        sums, met = np.zeros(shared.value.shape, np.int64), np.zeros(len(shared.value), np.int64)
        for y, texts, _ in _opened(batches):
            own = _vectors(learn(_model_of(shared.value), texts, y, np.ones(len(y)), PASSES, RATE, seed))
            at = np.flatnonzero((own != shared.value).any(axis=1))
            sums[at] += np.rint((own[at] - shared.value[at]) / UNIT).astype(np.int64)
            met[at] += 1
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(met[at]), *(pa.array(sums[at, k]) for k in range(SIZE))], names=["row", "blocks", *moves])

    moves = [f"m{k}" for k in range(SIZE)]
    moved = map_batches(blocks.filter("NOT apart"), tasks, ", ".join(f"{c} long" for c in ("row", "blocks", *moves))).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("blocks", *moves))).toArrow()
    vectors, at = _vectors(model), moved["row"].to_numpy()
    vectors[at] += np.stack([moved[c].to_numpy() for c in moves], axis=1) * UNIT / moved["blocks"].to_numpy()[:, None]
    shared.unpersist()
    return _model_of(vectors)


def score_counts(blocks: DataFrame, model: Model) -> DataFrame:
    """Rows apart, counted by language and raw score in whole STEPS: lang, bin, clean, toxic. Written."""
    shared = _shared(blocks, model)

    def tasks(batches):
        counts: dict = {}
        for y, texts, langs in _opened(batches):
            bins = np.floor(np.clip(raw_scores(shared.value, texts), -FAR, FAR) * STEPS).astype(np.int64)
            for lang, k, label in zip(langs, bins.tolist(), y.tolist(), strict=True):
                counts.setdefault((lang, k), [0, 0])[label] += 1
        columns = [[x for x, _ in counts], [k for _, k in counts], [n for n, _ in counts.values()], [n for _, n in counts.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["lang", "bin", "clean", "toxic"])

    counted = map_batches(blocks.filter("apart"), tasks, "lang string, bin long, clean long, toxic long")
    return materialize(counted.groupBy("lang", "bin").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "bins")


def language_thresholds(counted: DataFrame, scale: tuple[float, float], limit: float = LIMIT, precision: float = PRECISION) -> dict[str, float]:
    """Of each language, the lowest score of at least `limit` from which the share of toxic rows is `precision`; limit where none is or toxic rows are fewer than 5."""
    raw = (np.arange(-FAR * STEPS, FAR * STEPS + 1)) / STEPS
    least = int(np.searchsorted(_logistic(scale[0] * raw + scale[1]), limit)) - FAR * STEPS
    # a language has as many rows as there are steps, at most
    above = Window.partitionBy("lang").orderBy(F.desc("bin"))
    n, toxic = F.sum(F.col("clean") + F.col("toxic")).over(above), F.sum("toxic").over(above)
    good = F.when((toxic >= precision * n) & (F.col("bin") >= least), F.col("bin"))
    cuts = counted.withColumn("good", good).groupBy("lang").agg(F.sum("toxic").alias("toxic"), F.min("good").alias("cut")).filter("toxic >= 5 AND lang IS NOT NULL")
    edge = lambda k: float(np.floor(_logistic(scale[0] * k / STEPS + scale[1]) * 1e6) / 1e6)
    return {r["lang"]: limit if r["cut"] is None else max(limit, edge(r["cut"])) for r in cuts.collect()}


def fit(docs: DataFrame, labels: DataFrame, epochs: int = EPOCHS) -> Model:
    """Train on three quarters of all labelled rows whose crc32(doc_id) mod 4 is not 2, and calibrate on the other quarter. No row is left out.

    The driver holds the model, the counts of its buckets and of the steps of raw scores; the result depends on the rows
    alone, not on their order or how they are dealt.
    """
    rows, near, y = labelled(docs, labels)
    blocks = materialize(blocks_of(rows), "blocks")
    model = start(*class_counts(blocks))
    if model.out.any():
        for k in range(epochs):
            model = one_round(blocks, model, k)
    counted = score_counts(blocks, model)
    bins = counted.groupBy("bin").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).orderBy("bin").toArrow()
    at, clean, toxic = (bins[c].to_numpy() for c in ("bin", "clean", "toxic"))
    if clean.sum() and toxic.sum():
        raw, weights = (at + 0.5) / STEPS, np.concatenate([clean, toxic]).astype(np.float64)
        model.scale = platt(np.tile(raw, 2), np.repeat([0.0, 1.0], len(raw)), weights / weights.mean())
        model.thresholds = language_thresholds(counted, model.scale)
    discard(blocks, counted, y, *([near.table] if near.n else []))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def _judge(model: Model, column: pa.ListArray, langs: list, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores of texts given as word numbers, and the thresholds of their languages."""
    tables, (a, b), found = model.tables(), model.scale, []
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.diff(column.offsets.to_numpy())
    at, i = 0, 0
    while i < len(ends):  # some texts at a time: the responses of a batch stay in the processor's cache
        j, size = i, 0
        while j < len(ends) and (size == 0 or size + ends[j] <= 20_000):
            size += int(ends[j])
            j += 1
        found.append(pooled(tables, model.bias, flat[at : at + size], ends[i:j]) @ model.out + model.out_bias)
        at, i = at + size, j
    scores = np.round(_logistic(a * np.concatenate(found or [np.zeros(0)]).astype(np.float64) + b), 6)
    return scores, np.array([model.thresholds.get(x, limit) for x in langs], np.float64)


def _shared(docs: DataFrame, model: Model):
    """The model as a broadcast of fixed size; a worker keeps the object, and the responses worked out with it, for its next tasks."""
    return docs.sparkSession.sparkContext.broadcast(replace(model, responses=None))


def score(docs: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, lang, held_out, score, predicted, threshold (the language's), flagged (score reaches it).

    Null and empty texts score as texts without words. The language only picks the threshold, never moves the score.
    """
    shared = _shared(docs, model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), held_out(F.col("doc_id").cast("long")).alias("held_out"), words(F.col("text")).alias("words"))

    def tasks(batches):
        for part in batches:
            scores, limits = _judge(shared.value, part.column(3), part.column(1).to_pylist(), limit)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(scores), pa.array((scores >= limit).astype(np.int32)), pa.array(limits), pa.array(scores >= limits)], names=["doc_id", "lang", "held_out", "score", "predicted", "threshold", "flagged"])

    return map_batches(rows, tasks, "doc_id long, lang string, held_out boolean, score double, predicted int, threshold double, flagged boolean")


def toxicity(docs: DataFrame, labels: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    return score(docs, fit(docs, labels, epochs))


def not_toxic(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, **how) -> DataFrame:
    """docs without those that the model flags at their language's threshold.

    The verdict is a condition on the row itself: nothing is joined or shuffled, so null and repeated doc_ids, repeated
    rows and other columns of any name make no difference. Null and empty texts are judged as texts without words.
    """
    shared = _shared(docs, fit(docs, labels, **how))

    @F.arrow_udf("boolean")
    def flagged(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, langs in parts:
            scores, limits = _judge(shared.value, column, langs.to_pylist(), limit)
            yield pa.array(scores >= limits)

    return docs.filter(~flagged(words(F.col("text")), F.col("lang").cast("string")))
