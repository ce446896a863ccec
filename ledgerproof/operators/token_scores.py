"""Per-step features from stored score vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALLEST_PROBABILITY = 1e-12
ENERGY_FIELDS = (
    "token_logit", "step_logsumexp_logits", "negative_step_logsumexp_energy", "selected_step_energy_gap",
    "spilled_probability_mass_after_top1", "spilled_probability_mass_after_top2",
)
IDENTITIES = (
    "selected_step_energy_gap_vs_negative_logprob", "negative_step_logsumexp_energy_vs_step_logsumexp",
    "token_energy_vs_token_logit", "marginal_energy_vs_next_state_logsumexp",
    "spilled_energy_delta_formula", "spilled_energy_abs_delta_formula",
)


def _sum(xs: Column, f) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x))


def step_features(steps: DataFrame) -> DataFrame:
    """(qid, position, token_id, scores) -> distribution features of each step.

    The largest score is subtracted before exponents; ties in the top two go to the
    smaller token id.
    """
    scores = F.col("scores").cast("array<double>")
    ranked = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("n"), i.alias("i"))))
    base = steps.withColumns({"_s": scores, "_top": F.slice(ranked, 1, 2)})
    peak = -F.col("_top")[0]["n"]
    lse = base.withColumn("lse", peak + F.log(_sum(F.col("_s"), lambda x: F.exp(x - peak))))
    c = F.col
    with_p = lse.withColumns(
        {
            "token_logit": F.get(c("_s"), c("token_id")),
            "_p": F.transform("_s", lambda x: F.exp(x - c("lse"))),
            "top1_probability": F.exp(-c("_top")[0]["n"] - c("lse")),
            "top2_probability": F.exp(-c("_top")[1]["n"] - c("lse")),
        }
    )
    entropy = -_sum(c("_p"), lambda p: p * F.log(F.greatest(p, F.lit(SMALLEST_PROBABILITY))))
    return with_p.select(
        "qid",
        "position",
        "token_id",
        "token_logit",
        c("lse").alias("step_logsumexp_logits"),
        (-c("lse")).alias("negative_step_logsumexp_energy"),
        (c("lse") - c("token_logit")).alias("selected_step_energy_gap"),
        (c("token_logit") - c("lse")).alias("token_logprob"),
        F.exp(c("token_logit") - c("lse")).alias("token_probability"),
        entropy.alias("token_entropy"),
        c("_top")[0]["i"].cast("bigint").alias("top1_token_id"),
        c("_top")[1]["i"].cast("bigint").alias("top2_token_id"),
        "top1_probability",
        "top2_probability",
        (c("top1_probability") - c("top2_probability")).alias("top2_margin"),
        (1 - c("top1_probability")).alias("spilled_probability_mass_after_top1"),
        (1 - c("top1_probability") - c("top2_probability")).alias("spilled_probability_mass_after_top2"),
    )


def next_step_features(features: DataFrame) -> DataFrame:
    """Adds the next step's log-sum-exp minus the chosen score. Joined on document and
    position, so a long document has no single task; the last step has none."""
    following = features.select(
        "qid",
        (F.col("position") - 1).alias("position"),
        F.col("step_logsumexp_logits").alias("next_state_logsumexp_logits"),
    )
    delta = F.col("next_state_logsumexp_logits") - F.col("token_logit")
    return features.join(following, ["qid", "position"], "left").withColumns(
        {
            "token_energy": -F.col("token_logit"),
            "marginal_energy": -F.col("next_state_logsumexp_logits"),
            "spilled_energy_delta": delta,
            "spilled_energy_abs_delta": F.abs(delta),
        }
    )


def identity_errors(features: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """(formula, largest_error, passed) over all tokens."""
    c = F.col
    errors = [
        c("selected_step_energy_gap") + c("token_logprob"),
        c("negative_step_logsumexp_energy") + c("step_logsumexp_logits"),
        c("token_energy") + c("token_logit"),
        c("marginal_energy") + c("next_state_logsumexp_logits"),
        c("spilled_energy_delta") - (c("next_state_logsumexp_logits") - c("token_logit")),
        c("spilled_energy_abs_delta") - F.abs(c("spilled_energy_delta")),
    ]
    wide = features.agg(*[F.max(F.abs(e)).alias(n) for n, e in zip(IDENTITIES, errors)])
    return wide.unpivot([], list(IDENTITIES), "formula", "largest_error").withColumn(
        "passed", F.coalesce(F.col("largest_error") <= tolerance, F.lit(False))
    )
