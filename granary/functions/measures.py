"""Formulas of training and evaluation as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def perplexity(ce: Column) -> Column:
    return F.exp(F.least(ce, F.lit(700.0)))


def bits_per_byte(nll: Column, n_bytes: Column) -> Column:
    return F.when(n_bytes > 0, nll / F.lit(math.log(2)) / n_bytes).otherwise(F.raise_error(F.lit("bytes must be positive")).cast("double"))


def learning_rate(step: Column, peak: float, warmup: int, last: int, floor: float) -> Column:
    """Linear warm-up, cosine to floor * peak, the floor from then on."""
    least = peak * floor
    part = (step - warmup) / F.lit(float(max(1, last - warmup)))
    cosine = F.lit(least) + F.lit(0.5) * (1 + F.cos(F.lit(math.pi) * part)) * F.lit(peak - least)
    return F.when(step < warmup, F.lit(peak) * (step + 1) / F.lit(float(max(1, warmup)))).when(step >= last, F.lit(least)).otherwise(cosine)


def parameter_counts(vocab: Column, context: Column, width: Column, layers: Column, hidden: Column, tied: Column, bias: Column) -> dict[str, Column]:
    """Sizes of a decoder's parts. Norms always have a weight and a bias; an untied head has no bias."""
    b = bias.cast("long")
    linear = lambda a, c: a * c + c * b
    block = 4 * width + linear(width, 3 * width) + linear(width, width) + linear(width, hidden) + linear(hidden, width)
    out = {"token_embedding": vocab * width, "positional_embedding": context * width, "blocks": layers * block, "final_norm": 2 * width, "lm_head": F.when(tied, 0).otherwise(vocab * width)}
    out["total"] = sum(out.values(), F.lit(0))
    out["non_embedding"] = out["total"] - out["token_embedding"] - out["positional_embedding"]
    return out


def accumulation_steps(batch: Column, micro: Column) -> Column:
    return F.when(batch % micro == 0, F.floor(batch / micro)).otherwise(F.raise_error(F.lit("the batch is no multiple of the micro-batch")).cast("long"))


def head_class(distance: Column, entropy: Column, context: int) -> Column:
    """local, diffuse, long-range or mixed by mean distance and normalised entropy."""
    near, wide = distance < 0.05 * context, entropy > 0.7
    return F.when(near & ~wide, "local").when(wide & ~near, "diffuse").when(distance > 0.25 * context, "long-range").otherwise("mixed")


def chance_level(template: Column, entities: Column) -> Column:
    return F.when(template == "numeric_equality", 0.5).otherwise(1 / F.greatest(F.lit(1), entities))
