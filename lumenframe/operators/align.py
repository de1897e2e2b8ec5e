"""Alignment of two embeddings by contrastive training of projection heads.

``fit_heads`` trains over a table: the rows of an epoch are dealt to minibatches and packed, a step is one job over some minibatches, whose gradients are
added in the executors, and the driver holds the heads and the optimiser's moments. ``train`` is the same loop in memory, for a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.arrow import map_arrow
from ..functions.storage import Workspace

#: Numbers of a gradient that are sent and added at once.
STRIP = 1 << 15


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-8)


def soft_targets(image: np.ndarray, gene: np.ndarray, alpha: float, temperature: float) -> np.ndarray:
    """softmax((alpha * gene similarity + (1 - alpha) * image similarity) / temperature), rows sum to 1."""
    g, i = unit(gene), unit(image)
    return softmax((alpha * g @ g.T + (1 - alpha) * i @ i.T) / temperature)


def soft_loss(image: np.ndarray, gene: np.ndarray, target: np.ndarray, tau: float) -> float:
    """Symmetric soft cross-entropy of the pair similarities with a target distribution."""
    tau = min(max(tau, 1e-3), 2.0)
    logits = unit(image) @ unit(gene).T / tau
    one = -(target * np.log(np.maximum(softmax(logits), 1e-30))).sum(axis=1).mean()
    two = -(target.T * np.log(np.maximum(softmax(logits.T), 1e-30))).sum(axis=1).mean()
    return float((one + two) / 2)


def info_nce(image: np.ndarray, gene: np.ndarray, tau: float) -> float:
    """Bidirectional InfoNCE: the target is the identity."""
    return soft_loss(image, gene, np.eye(len(image)), tau)


def _similarities(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """(batch, i, j, value): dot products of the unit vectors (batch, id, v) of each batch; a batch is some tens of rows."""
    pairs = a.select("batch", F.col("id").alias("i"), F.col("v").alias("x")).join(b.select("batch", F.col("id").alias("j"), F.col("v").alias("y")), "batch")
    return pairs.select("batch", "i", "j", S.dot(F.col("x"), F.col("y")).alias(value))


def _units(rows: DataFrame, key: str, batch: str, vector: str) -> DataFrame:
    return rows.select(F.col(batch).alias("batch"), F.col(key).alias("id"), S.l2_normalised(F.col(vector)).alias("v"))


def _soft(scores: DataFrame, row: str, score: str, name: str) -> DataFrame:
    """``scores`` with ``name``, the softmax of a row's scores in its batch."""
    across = Window.partitionBy("batch", row)
    shifted = scores.withColumn(name, F.exp(F.col(score) - F.max(score).over(across)))
    return shifted.withColumn(name, F.col(name) / F.sum(name).over(across))


def target_table(rows: DataFrame, key: str, batch: str, image: str, gene: str, alpha: float = 0.5, temperature: float = 0.1) -> DataFrame:
    """(batch, i, j, target): ``soft_targets`` of every batch as a table. Rows with a null key, batch or vector are left out; keys are unique
    within a batch, and a batch has as few rows as one training step."""
    rows = rows.dropna(subset=[key, batch, image, gene])
    g, i = (_units(rows, key, batch, c) for c in (gene, image))
    both = _similarities(g, g, "gg").join(_similarities(i, i, "ii"), ["batch", "i", "j"])
    return _soft(both.withColumn("score", (alpha * F.col("gg") + (1 - alpha) * F.col("ii")) / temperature), "i", "score", "target").select("batch", "i", "j", "target")


def loss_table(rows: DataFrame, key: str, batch: str, image: str, gene: str, tau: float = 0.1, targets: DataFrame | None = None) -> DataFrame:
    """(batch, n, loss): symmetric cross-entropy of each batch's pair similarities with ``targets`` (batch, i, j, target), by default each row
    with itself: bidirectional InfoNCE. tau is held to 0.001 to 2; rows as in ``target_table``."""
    tau = min(max(tau, 1e-3), 2.0)
    rows = rows.dropna(subset=[key, batch, image, gene])
    logits = _similarities(_units(rows, key, batch, image), _units(rows, key, batch, gene), "s").withColumn("s", F.col("s") / tau)
    soft = _soft(_soft(logits, "i", "s", "p"), "j", "s", "q")
    wanted = soft.join(targets, ["batch", "i", "j"]) if targets is not None else soft.withColumn("target", (F.col("i") == F.col("j")).cast("double"))
    floor = lambda c: F.log(F.greatest(c, F.lit(1e-30)))
    sums = wanted.groupBy("batch").agg(F.countDistinct("i").alias("n"), F.sum(-F.col("target") * (floor("p") + floor("q"))).alias("t"))
    return sums.select("batch", "n", (F.col("t") / (2 * F.col("n"))).alias("loss"))


@dataclass
class Head:
    """Linear, tanh-approximated GELU, layer norm, and length 1."""

    weight: np.ndarray
    bias: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        h = x @ self.weight + self.bias
        h = 0.5 * h * (1 + np.tanh(0.7978845608 * (h + 0.044715 * h**3)))
        h = (h - h.mean(axis=1, keepdims=True)) / np.sqrt(h.var(axis=1, keepdims=True) + 1e-5)
        return unit(h)

    def gradient(self, x: np.ndarray, out_grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = x @ self.weight + self.bias
        t = np.tanh(0.7978845608 * (z + 0.044715 * z**3))
        h = 0.5 * z * (1 + t)
        dev = np.sqrt(h.var(axis=1, keepdims=True) + 1e-5)
        y = (h - h.mean(axis=1, keepdims=True)) / dev
        length = np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), 1e-8)
        u = y / length
        g = (out_grad - u * (out_grad * u).sum(axis=1, keepdims=True)) / length
        g = (g - g.mean(axis=1, keepdims=True) - y * (g * y).mean(axis=1, keepdims=True)) / dev
        g = g * (0.5 * (1 + t) + 0.5 * z * (1 - t**2) * 0.7978845608 * (1 + 3 * 0.044715 * z**2))
        return x.T @ g, g.sum(axis=0)


@dataclass
class Aligned:
    image: Head
    gene: Head
    history: list[dict] = field(default_factory=list)
    best_epoch: int = 0


@dataclass
class Rule:
    """What a minibatch's loss is."""

    alpha: float = 0.5
    temperature: float = 0.1
    tau: float = 0.1
    soft: bool = True

    def target(self, image: np.ndarray, gene: np.ndarray) -> np.ndarray:
        return soft_targets(image, gene, self.alpha, self.temperature) if self.soft else np.eye(len(image))

    def loss(self, heads: list[Head], image: np.ndarray, gene: np.ndarray) -> float:
        return soft_loss(heads[0](image), heads[1](gene), self.target(image, gene), self.tau)

    def gradient(self, heads: list[Head], image: np.ndarray, gene: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The loss, and its gradients by both heads' weights and biases."""
        a, b, t = heads[0](image), heads[1](gene), self.target(image, gene)
        logits = a @ b.T / self.tau
        pull = ((softmax(logits) * t.sum(1, keepdims=True) - t) + (softmax(logits.T) * t.T.sum(1, keepdims=True) - t.T).T) / (2 * len(image) * self.tau)
        return soft_loss(a, b, t, self.tau), [*heads[0].gradient(image, pull @ b), *heads[1].gradient(gene, pull.T @ a)]


def begun_heads(widths: tuple[int, int], latent: int, rng: np.random.Generator) -> list[Head]:
    return [Head(rng.normal(0, 1 / np.sqrt(w), (w, latent)), np.zeros(latent)) for w in widths]


class AdamW:
    """Adam's moments with decay of the weights themselves."""

    def __init__(self, heads: list[Head], rate: float, decay: float):
        self.of = [p for h in heads for p in (h.weight, h.bias)]
        self.state = [[np.zeros_like(p), np.zeros_like(p)] for p in self.of]
        self.rate, self.decay, self.step = rate, decay, 0

    def __call__(self, gradients: list[np.ndarray]) -> None:
        self.step += 1
        for p, g, s in zip(self.of, gradients, self.state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.999 * s[1] + 0.001 * g * g
            p -= self.rate * (s[0] / (1 - 0.9**self.step) / (np.sqrt(s[1] / (1 - 0.999**self.step)) + 1e-8) + self.decay * p)


@dataclass
class Patience:
    """Keeps the heads of the best epoch, and says when ``most`` epochs in a row weren't better by 1e-6."""

    most: int
    out: Aligned
    best: float = np.inf
    waited: int = 0

    def enough(self, epoch: int, train_loss: float | None, value: float, heads: list[Head]) -> bool:
        self.out.history.append({"epoch": epoch, "train_loss": train_loss, "val_loss": value})
        if value < self.best - 1e-6:
            self.best, self.waited, self.out.best_epoch = value, 0, epoch
            self.out.image, self.out.gene = (Head(h.weight.copy(), h.bias.copy()) for h in heads)
        else:
            self.waited += 1
        return self.waited >= self.most


def train(image: np.ndarray, gene: np.ndarray, latent: int = 128, epochs: int = 20, batch: int = 64, patience: int = 5, rate: float = 1e-3, decay: float = 1e-4, alpha: float = 0.5, temperature: float = 0.1, tau: float = 0.1, soft: bool = True, seed: int = 17) -> Aligned:
    """Heads fitted with AdamW to a bounded sample; early stop on validation loss, and the best epoch's own copy is returned.

    One seed drives the split, the shuffles and the start."""
    rng, rule = np.random.default_rng(seed), Rule(alpha, temperature, tau, soft)
    order = rng.permutation(len(image))
    cut = max(1, int(0.8 * len(order)))
    fit, check = order[:cut], order[cut:] if cut < len(order) else order[:cut]
    heads = begun_heads((image.shape[1], gene.shape[1]), latent, rng)
    update, kept = AdamW(heads, rate, decay), Patience(patience, Aligned(*heads))
    for epoch in range(1, epochs + 1):
        losses = []
        shuffled = rng.permutation(fit)
        for low in range(0, len(shuffled), batch):
            at = shuffled[low : low + batch]
            if len(at) >= 2:
                loss, gradients = rule.gradient(heads, image[at], gene[at])
                losses.append(loss)
                update(gradients)
        if kept.enough(epoch, float(np.mean(losses)) if losses else None, rule.loss(heads, image[check], gene[check]), heads):
            break
    return kept.out


def _packed(rows: DataFrame, number, count: int) -> DataFrame:
    """(batch, n, image, gene): the rows of each minibatch as bytes, in the order of keys; those of one row are left out."""
    flat = lambda c: F.flatten(F.transform("them", lambda x: x[c])).alias(c)
    grouped = rows.groupBy(F.pmod(number, F.lit(count)).cast("int").alias("batch")).agg(F.sort_array(F.collect_list(F.struct("key", "image", "gene"))).alias("them"))
    return grouped.select("batch", F.size("them").alias("n"), flat("image"), flat("gene")).where("n > 1")


def _pair(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    n = batch.column("n")[i].as_py()
    return tuple(batch.column(c)[i].values.to_numpy().reshape(n, -1) for c in ("image", "gene"))


def _summed(packed: DataFrame, heads: list[Head], rule: Rule, gradients: bool) -> tuple[int, float, np.ndarray]:
    """How many minibatches there are, the sum of their losses, and of their gradients one after another: added in tasks, then by strips in
    executors."""
    shared = packed.sparkSession.sparkContext.broadcast((heads, rule))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, r = shared.value
        total = None
        for batch in batches:
            for i in range(len(batch)):
                pair = _pair(batch, i)
                loss, parts = r.gradient(hs, *pair) if gradients else (r.loss(hs, *pair), [])
                flat = np.concatenate([[1.0, loss], *(p.reshape(-1) for p in parts)])
                total = flat if total is None else total + flat
        if total is not None:
            starts = range(0, len(total), STRIP)
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([total[i : i + STRIP].tobytes() for i in starts], pa.binary())], ["strip", "g"])

    def add(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in group:
            for blob in batch.column("g"):
                g = np.frombuffer(blob.as_buffer())
                total = g.copy() if total is None else total + g
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["strip", "g"])

    strips = sorted((r.strip, r.g) for r in map_arrow(packed.select("n", "image", "gene"), run, "strip int, g binary").groupBy("strip").applyInArrow(add, "strip int, g binary").collect())
    if not strips:
        return 0, 0.0, np.zeros(0)
    flat = np.concatenate([np.frombuffer(g) for _, g in strips])
    return int(flat[0]), float(flat[1]), flat[2:]


def fit_heads(df: DataFrame, key: str, image: str, gene: str, latent: int = 128, epochs: int = 20, batch: int = 64, steps: int = 20, patience: int = 5, rate: float = 1e-3, decay: float = 1e-4, rule: Rule | None = None, seed: int = 17) -> Aligned:
    """Heads fitted with AdamW to all rows of a table, stopped early on a fifth of them that is held out by a hash of the key.

    An epoch deals its rows to minibatches of about ``batch`` by a hash of key and epoch, and makes ``steps`` steps (fewer if there are fewer minibatches),
    each by the mean gradient of its share of the minibatches; the validation loss is the mean over fixed minibatches of the held-out rows, of all rows
    if none is held out. The driver holds parameters only, and a task one minibatch.

    Rows with a null key or a vector that is null or holds null are left out; vectors of one column have one length; rows that repeat a key lie in the same
    minibatches. A table with fewer than two rows is an error."""
    rule, work = rule or Rule(), Workspace(df.sparkSession, "alignment")
    whole = lambda c: F.coalesce((F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x)), F.lit(False))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(image).cast("array<double>").alias("image"), F.col(gene).cast("array<double>").alias("gene"))
    rows = work.save(rows.where(F.col("key").isNotNull() & whole("image") & whole("gene")).withColumn("held", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(5)) == 0))
    first, n, held = rows.first(), rows.count(), rows.where("held").count()
    if n < 2:
        raise ValueError("there are too few rows to fit")
    fit, check = (rows.where("not held"), rows.where("held")) if 2 <= held <= n - 2 else (rows, rows)
    split = n - held if 2 <= held <= n - 2 else n
    count = lambda m: max(1, round(m / batch))
    tests = work.save(_packed(check, F.xxhash64("key", F.lit(seed), F.lit(0)), count(n - split or n)))
    heads = begun_heads((len(first["image"]), len(first["gene"])), latent, np.random.default_rng(seed))
    update, kept = AdamW(heads, rate, decay), Patience(patience, Aligned(*heads))
    many = count(split)
    each = -(-many // steps)
    for epoch in range(1, epochs + 1):
        packed = _packed(fit, F.xxhash64("key", F.lit(seed), F.lit(epoch)), many).withColumn("step", F.floor(F.col("batch") / each).cast("int"))
        packed = work.save(packed.repartition("step", "batch"), by="step")
        seen = losses = 0
        for step in range(-(-many // each)):
            m, loss, flat = _summed(packed.where(F.col("step") == step), heads, rule, True)
            if m:
                ends = np.cumsum([p.size for p in update.of])
                update([g.reshape(p.shape) / m for g, p in zip(np.split(flat, ends[:-1]), update.of, strict=True)])
                seen, losses = seen + m, losses + loss
        work.drop(packed)
        m, loss, _ = _summed(tests, heads, rule, False)
        if kept.enough(epoch, losses / seen if seen else None, loss / max(m, 1), heads):
            break
    return kept.out


def apply_head(df: DataFrame, key: str, vector: str, head: Head, name: str, rows: int = 2048) -> DataFrame:
    """(key, name): a head's output for every row, in chunks."""
    shared = df.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), rows):
                part = batch.slice(low, rows)
                x = shared.value(np.stack([np.asarray(v, np.float64) for v in part.column("v").to_pylist()]))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("k"), lists], ["k", "v"])

    kind = df.schema[key].dataType.simpleString()
    given = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    return map_arrow(given, run, f"k {kind}, v array<double>").toDF(key, name)
