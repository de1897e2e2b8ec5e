"""Training over a table against the loop in memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import align


def data(n=150, seed=0):
    rng = np.random.default_rng(seed)
    hidden = rng.standard_normal((n, 4))
    return hidden @ rng.standard_normal((4, 6)) + 0.1 * rng.standard_normal((n, 6)), hidden @ rng.standard_normal((4, 5)) + 0.1 * rng.standard_normal((n, 5))


def table(spark, image, gene, odd=()):
    rows = [(i, a.tolist(), b.tolist(), 0) for i, (a, b) in enumerate(zip(image, gene, strict=True))]
    return spark.createDataFrame([*rows, *odd], "k long, i array<double>, g array<double>, batch int").repartition(5)


@pytest.mark.parametrize(("steps", "each"), [(100, 1), (2, 2)])
def test_the_curve_is_that_of_the_loop_in_memory(spark, steps, each):
    image, gene = data()
    df = table(spark, image, gene, odd=[(None, [1.0] * 6, [1.0] * 5, 0), (900, None, [1.0] * 5, 0), (901, [None] * 6, [1.0] * 5, 0)])
    out = align.fit_heads(df, "k", "i", "g", latent=3, epochs=3, batch=32, steps=steps)
    own = df.where("k < 900").select("k", (F.pmod(F.xxhash64("k", F.lit(17)), F.lit(5)) == 0).alias("held"), *(F.xxhash64("k", F.lit(17), F.lit(e)).alias(f"h{e}") for e in range(4))).collect()
    held, fit = [r for r in own if r.held], [r for r in own if not r.held]
    count = lambda rows: max(1, round(len(rows) / 32))
    batches = lambda rows, e: [b for b in (sorted(r.k for r in rows if r[f"h{e}"] % count(rows) == c) for c in range(count(rows))) if len(b) > 1]
    rule = align.Rule()
    heads = align.begun_heads((6, 5), 3, np.random.default_rng(17))
    update = align.AdamW(heads, 1e-3, 1e-4)
    for e in range(1, 4):
        every = batches(fit, e)
        losses = []
        for low in range(0, len(every), each):
            found = [rule.gradient(heads, image[b], gene[b]) for b in every[low : low + each]]
            losses += [loss for loss, _ in found]
            update([np.mean(g, axis=0) for g in zip(*(g for _, g in found), strict=True)])
        check = [rule.loss(heads, image[b], gene[b]) for b in batches(held, 0)]
        assert out.history[e - 1]["train_loss"] == pytest.approx(np.mean(losses), rel=1e-9)
        assert out.history[e - 1]["val_loss"] == pytest.approx(np.mean(check), rel=1e-9)
    assert len(out.history) == 3 and np.allclose(out.image.weight, heads[0].weight) or out.best_epoch < 3


def test_early_stop_and_too_few_rows(spark):
    image, gene = data(40)
    out = align.fit_heads(table(spark, image, gene), "k", "i", "g", latent=3, epochs=6, batch=16, steps=1, patience=2, rate=0.0)
    assert [h["epoch"] for h in out.history] == [1, 2, 3] and out.best_epoch == 1  # nothing gets better without a rate
    with pytest.raises(ValueError, match="too few"):
        align.fit_heads(table(spark, image[:1], gene[:1]), "k", "i", "g")
