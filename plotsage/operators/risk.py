"""Risk tiers by a fixed decision tree, evidence rows, and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotsage.functions.text import TIERS, tier_label
from plotsage.operators.zonal import BASELINE, CONTEXT, CROPLAND, FOREST, LATENCY_BAND, LOSS

LOSS_THRESHOLD = 0.10
# Rule, tier, whether the boundary is uncertain; the first whose condition holds counts.
RULES = (
    ("low.outside_2020_forest", "low", False),
    ("low.crop_context_downgrade", "low", False),
    ("low.pre_cutoff_disturbance_only", "low", False),
    ("mins.band21_latency", "more-info-needed", True),
    ("high.inside_forest_post_cutoff_loss", "high", False),
    ("mins.sub_threshold_loss", "more-info-needed", False),
    ("mins.inside_forest_no_context", "more-info-needed", False),
)


def assess(samples: DataFrame, threshold: float = LOSS_THRESHOLD) -> DataFrame:
    """samples with rule_id, risk, boundary_uncertain and rationale."""
    post, pre = F.size("post_bands") > 0, F.size("pre_bands") > 0
    conditions = (
        F.col("forest_fraction") < 0.5,
        F.col("cropland_fraction") >= 0.5,
        pre & ~post,
        F.col("post_bands") == F.array(F.lit(LATENCY_BAND)),
        post & (F.col("loss_fraction") >= threshold),
        post,
        F.lit(True),
    )
    percent = F.format_string("%.2f%%", F.col("loss_fraction") * 100)
    limit = f"{threshold:.0%}"
    reasons = (
        F.lit("No forest in the 2020 baseline."),
        F.lit("Cropland context: the baseline is known to map shaded crops as forest."),
        F.lit("Loss only before the cutoff."),
        F.lit("Loss only in the first band after the cutoff, which may hold earlier clearings."),
        F.concat(F.lit("Forest in 2020 and loss after the cutoff on "), percent, F.lit(f" of the plot (threshold {limit}).")),
        F.concat(F.lit("Loss after the cutoff on "), percent, F.lit(f" of the plot, below the threshold of {limit}.")),
        F.lit("Forest in 2020, no loss and no context."),
    )
    picked = None
    for condition, (rule, tier, uncertain), reason in zip(conditions, RULES, reasons, strict=True):
        row = F.struct(F.lit(rule).alias("rule_id"), F.lit(tier).alias("risk"), F.lit(uncertain).alias("boundary_uncertain"), reason.alias("rationale"))
        picked = F.when(condition, row) if picked is None else picked.when(condition, row)
    told = samples.withColumn("_picked", picked)
    return told.select("*", "_picked.*").drop("_picked")


def layer_rows(assessed: DataFrame) -> DataFrame:
    """Long form, a row for each plot and layer in fixed order: layer_order, layer, value, covered_fraction, verdict."""
    newest = F.coalesce(F.array_max("post_bands"), F.array_max("pre_bands"), F.lit(0)).cast("double")
    inside, crop = F.col("forest_fraction") >= 0.5, F.col("cropland_fraction") >= 0.5
    rows = (
        (LOSS, newest, F.col("loss_fraction"), F.format_string("post_cutoff_loss_fraction=%.6f", "loss_fraction")),
        (BASELINE, F.when(inside, float(FOREST)).otherwise(0.0), F.col("forest_fraction"), F.when(inside, "inside_2020_forest").otherwise("outside_2020_forest")),
        (CONTEXT, F.when(crop, float(CROPLAND)).otherwise(0.0), F.col("cropland_fraction"), F.when(crop, "cropland_context").otherwise("no_cropland_context")),
    )
    each = F.array(*[F.struct(F.lit(i).alias("layer_order"), F.lit(n).alias("layer"), v.alias("pixel_value"), c.alias("covered_fraction"), F.concat_ws("|", "risk", t).alias("verdict")) for i, (n, v, c, t) in enumerate(rows)])
    return assessed.withColumn("_layer", F.explode(each)).select("*", "_layer.*").drop("_layer")


def evidence(assessed: DataFrame, datasets: DataFrame, run_id: str | Column) -> DataFrame:
    """Ledger rows: run_id, plot_id, layer_order, dataset_name, dataset_version, rule_id, pixel_value, covered_fraction, verdict.

    datasets: layer, dataset_name, dataset_version (one row for each layer)."""
    run = F.lit(run_id) if isinstance(run_id, str) else run_id
    return layer_rows(assessed).join(F.broadcast(datasets), "layer").select(run.alias("run_id"), "plot_id", "layer_order", "dataset_name", "dataset_version", "rule_id", "pixel_value", "covered_fraction", "verdict")


def rank(tier: Column) -> Column:
    return F.create_map(*[F.lit(x) for i, t in enumerate(TIERS) for x in (t, i)])[tier]


def highest(tier: Column) -> Column:
    """Aggregate: the highest tier of a group; low if there is none."""
    return F.element_at(F.array(*map(F.lit, TIERS)), F.coalesce(F.max(rank(tier)), F.lit(0)) + 1)


def tier_counts(assessed: DataFrame) -> DataFrame:
    """Plots by tier, those without a risk as 'not assessed'; tiers without plots have 0."""
    tiers = assessed.sparkSession.createDataFrame([(t,) for t in (*TIERS, "not assessed")], "risk string")
    counted = assessed.groupBy(F.coalesce("risk", F.lit("not assessed")).alias("risk")).agg(F.count("*").alias("n"))
    return tiers.join(counted, "risk", "left").na.fill(0, ["n"])


def labelled(assessed: DataFrame) -> DataFrame:
    return assessed.withColumn("label", tier_label(F.col("risk")))
