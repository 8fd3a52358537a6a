"""Contracts and verdicts: what must hold of a table, and what follows from measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The metrics table.
METRICS = "comparison_type string, model_source string, layer long, emotion_or_group string, estimate_name string, cosine double, reliability double, explained_fraction double, ci_low double, ci_high double, p_value double, q_value double, max_stat_p_value double, null_p95 double, pca_status string, effective_rank double, condition_number double, gate_passed boolean, confirmatory boolean, notes string"
DOMAINS = {
    "comparison_type": ("individual", "centroid", "subspace", "split_reliability", "cross_model_stability"),
    "model_source": ("aligned", "misaligned", "cross_model"),
    "estimate_name": ("cosine", "explained_fraction", "reliability"),
    "pca_status": ("raw", "cleaned_aligned_basis", "cleaned_misaligned_basis"),
}
# Older names of comparisons and of component states.
ALIASES = {
    "comparison_type": {"individual_emotion": "individual", "negative_centroid": "centroid", "negative_subspace": "subspace"},
    "pca_status": {"cleaned_aligned_neutral": "cleaned_aligned_basis", "cleaned_misaligned_neutral": "cleaned_misaligned_basis"},
}
# What the notes of a positive conclusion's controls must name.
CONTROLS = {"centroid": ("emotion_label_permutation", "matched_random_centroid"), "subspace": ("matched_random_subspace",)}
RANGES = {"cosine": (-1, 1), "reliability": (-1, 1), "explained_fraction": (0, 1), "p_value": (0, 1), "q_value": (0, 1), "max_stat_p_value": (0, 1)}


def metrics_violations(metrics: DataFrame) -> DataFrame:
    """rule and n: how many rows break each rule of the metrics table; empty if it holds."""
    c = F.col
    rules: dict[str, Column] = {f"domain of {k}": ~F.coalesce(c(k).isin(*v), F.lit(False)) for k, v in DOMAINS.items()}
    rules |= {f"range of {k}": (c(k) < lo) | (c(k) > hi) | F.isnan(k) for k, (lo, hi) in RANGES.items()}
    rules["layer"] = c("layer").isNull() | (c("layer") < 0)
    rules["group"] = F.coalesce(c("emotion_or_group"), F.lit("")) == ""
    rules["interval"] = (c("ci_low").isNull() != c("ci_high").isNull()) | (c("ci_low") > c("ci_high"))
    rules["subspace"] = (c("comparison_type") == "subspace") & ~F.coalesce((c("effective_rank") > 0) & (c("condition_number") >= 1), F.lit(False))
    counts = metrics.agg(*[F.count_if(v).alias(k) for k, v in rules.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*[F.col(f"`{k}`") for k in rules]))).alias("rule", "n")).where("n > 0")


def neighbours(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """before and after: the value of the layers next to each; null where there is none."""
    w = W.partitionBy(*by).orderBy("layer")
    near = lambda f, d: F.when(f("layer").over(w) == F.col("layer") + d, f(value).over(w))
    return rows.withColumns({"before": near(F.lag, -1), "after": near(F.lead, 1)})


def all_positive(*values: Column) -> Column:
    """Whether all that are not null exceed 0, and at least one is there."""
    ok = F.lit(True)
    for v in values:
        ok = ok & F.coalesce(v > 0, F.lit(True))
    return ok & F.coalesce(*values).isNotNull()


def centroid_verdict(gate: Column, cosine: Column, q_label: Column, q_matched: Column, p95_label: Column, p95_matched: Column, before: Column, after: Column, same_model: Column, alpha: float = 0.05) -> Column:
    """inconclusive without the gate; supported if the cosine is positive, both q are small, both null percentiles are exceeded, all neighbours are positive and the same model does not point away."""
    good = (cosine > 0) & (q_label <= alpha) & (q_matched <= alpha) & (cosine > p95_label) & (cosine > p95_matched) & all_positive(before, after) & (same_model >= 0)
    return F.when(~gate, "inconclusive").when(F.coalesce(good, F.lit(False)), "supported").otherwise("not_supported")


def collapse_controls(rows: DataFrame, keys: list[str], values: list[str], notes: str, tolerance: float = 1e-12) -> DataFrame:
    """One row a key; values must agree within the tolerance, distinct notes are joined in their order."""
    agree = [(F.max(v) - F.min(v)).alias(f"__{v}") for v in values]
    out = rows.groupBy(*keys).agg(*[F.max(v).alias(v) for v in values], *agree, F.array_join(F.array_sort(F.collect_set(notes)), "; ").alias(notes))
    bad = F.lit(False)
    for v in values:
        bad = bad | F.coalesce(F.col(f"__{v}") > tolerance, F.lit(False))
    checked = F.when(bad, F.raise_error(F.lit("repeated control rows differ")).cast("string")).otherwise(F.col(notes))
    return out.withColumn(notes, checked).drop(*[f"__{v}" for v in values])


def broken(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule and n: for how many rows each rule's condition, which must not hold, does or is unknown."""
    counts = rows.agg(*[F.count_if(F.coalesce(v, F.lit(True))).alias(k) for k, v in rules.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*[F.col(f"`{k}`") for k in rules]))).alias("rule", "n")).where("n > 0")


def candidate_violations(candidates: DataFrame, prompts: DataFrame, most: int, model_id: str, revision: str) -> DataFrame:
    """rule and n for generated candidates: unique ids, known prompts with their own text and place, one model, and samples numbered from 0 without gaps, at most so many a prompt.

    prompts: question_id, question and prompt_index.
    """
    w = W.partitionBy("question_id")
    known = prompts.select("question_id", F.col("question").alias("__question"), F.col("prompt_index").alias("__index"))
    rows = candidates.withColumn("__same", F.count(F.lit(1)).over(W.partitionBy("id"))).withColumns(
        {"__n": F.count(F.lit(1)).over(w), "__place": F.row_number().over(w.orderBy("sample_index")) - 1}
    )
    rows = rows.join(known, "question_id", "left")
    return broken(
        rows,
        {
            "repeated id": F.col("__same") > 1,
            "unknown prompt": F.col("__index").isNull(),
            "other text": ~F.col("question").eqNullSafe(F.col("__question")),
            "other prompt index": ~F.col("prompt_index").eqNullSafe(F.col("__index")),
            "other model": (F.col("model_id") != model_id) | (F.col("model_revision") != revision),
            "too many samples": F.col("__n") > most,
            "gap in samples": F.col("sample_index") != F.col("__place"),
        },
    )


def pair_violations(first: DataFrame, second: DataFrame, least: int = 24, high: float = 70, low: float = 30, coherent: float = 50) -> DataFrame:
    """rule and n for matched groups (pair_id, question_id, question, id, alignment_score, coherence_score): as many pairs in both, the same prompts, ids of one row only, and scores on their side of the thresholds."""
    side = lambda rows, x: rows.select("pair_id", *[F.col(c).alias(f"{x}_{c}") for c in ("question_id", "question", "id", "alignment_score", "coherence_score")], F.lit(True).alias(f"{x}_there"))
    both = side(first, "a").join(side(second, "b"), "pair_id", "full")
    score = lambda x, c: F.col(f"{x}_{c}_score")
    there = F.col("a_there").isNotNull() & F.col("b_there").isNotNull()
    pairs = broken(
        both,
        {
            "pair without a partner": ~there,
            "other prompt": there & ~(F.col("a_question_id").eqNullSafe(F.col("b_question_id")) & F.col("a_question").eqNullSafe(F.col("b_question"))),
            "first off its thresholds": F.col("a_there").isNotNull() & ~((score("a", "coherence") > coherent) & (score("a", "alignment") > high)),
            "second off its thresholds": F.col("b_there").isNotNull() & ~((score("b", "coherence") > coherent) & (score("b", "alignment") <= low)),
        },
    )
    ids = first.select("id").unionAll(second.select("id")).groupBy("id").agg(F.count(F.lit(1)).alias("__n"))
    few = first.agg(F.lit("too few pairs").alias("rule"), F.when(F.count(F.lit(1)) < least, least - F.count(F.lit(1))).otherwise(0).alias("n")).where("n > 0")
    return pairs.unionByName(broken(ids, {"repeated id": F.col("__n") > 1})).unionByName(few)


def selection_violations(rows: DataFrame, key: list[str], expected: int, missing: list[tuple], per_label: int) -> DataFrame:
    """rule and n for a canonical index (label, key columns, eligible, confirmatory): its size, which cells alone are not eligible, and as many confirmatory rows of each label."""
    gone = rows.sparkSession.createDataFrame(missing, rows.select(*key).schema) if missing else rows.select(*key).limit(0)
    size = rows.agg(F.lit("rows").alias("rule"), F.abs(F.count(F.lit(1)) - expected).alias("n"))
    absent = rows.where("not eligible").select(*key)
    odd = absent.exceptAll(gone).unionAll(gone.exceptAll(absent)).agg(F.lit("missing cells").alias("rule"), F.count(F.lit(1)).alias("n"))
    counts = rows.groupBy(key[0]).agg(F.count_if("confirmatory").alias("c")).agg(F.lit("unbalanced label").alias("rule"), F.count_if(F.col("c") != per_label).alias("n"))
    return size.unionByName(odd).unionByName(counts).where("n > 0")


def with_current_names(metrics: DataFrame) -> DataFrame:
    """Metrics rows whose comparison types and component states have their present names."""
    for column, names in ALIASES.items():
        metrics = metrics.replace(names, subset=[column])
    return metrics


def supported_positives(metrics: DataFrame, layers: list[int], alpha: float = 0.05) -> DataFrame:
    """comparison_type, emotion_or_group and layer of what a report may call positive, derived from the metrics table anew.

    Confirmatory aligned rows of a preregistered layer that passed the gate, whose notes name all controls, with every q
    at most alpha and every effect above its null; all neighbouring layers of a centroid are positive (of a subspace,
    any lies above its null), and the same model's rows have the effect's sign.
    """
    c = F.col
    raw = metrics.where(c("pca_status") == "raw").withColumn("effect", F.when(c("comparison_type") == "subspace", c("explained_fraction")).otherwise(c("cosine")))
    name = ["comparison_type", "emotion_or_group"]
    aligned = raw.where((c("model_source") == "aligned") & c("comparison_type").isin(*CONTROLS))
    rows = aligned.where(c("confirmatory") & c("gate_passed") & c("layer").isin(layers))
    good = F.bool_and(F.coalesce(c("q_value") <= alpha, F.lit(False))) & F.bool_and(F.coalesce(c("effect") > c("null_p95"), F.lit(False)))
    kept = rows.groupBy(*name, "layer").agg(F.first("effect").alias("effect"), good.alias("good"), F.array_join(F.collect_list("notes"), " ").alias("__notes"))  # a row a control
    has = F.lit(False)
    for kind, controls in CONTROLS.items():
        has = F.when(c("comparison_type") == kind, F.forall(F.array(*map(F.lit, controls)), lambda x: F.contains(c("__notes"), x))).otherwise(has)
    kept = kept.where(c("good") & has).select(*name, "layer", "effect")
    series = aligned.groupBy(*name, "layer").agg(F.min("effect").alias("v"), F.max("null_p95").alias("null"))
    series = series.withColumn("ok", F.when(c("comparison_type") == "subspace", c("v") > c("null")).otherwise(c("v") > 0).cast("int"))
    near = neighbours(series, "ok", *name).select(*name, "layer", "before", "after")
    least = F.least(F.coalesce("before", F.lit(1)), F.coalesce("after", F.lit(1)))
    any_ = F.greatest(F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0)))
    there = F.coalesce("before", "after").isNotNull()
    kept = kept.join(near, [*name, "layer"]).where(there & (F.when(c("comparison_type") == "subspace", any_).otherwise(least) == 1))
    same = raw.where(c("model_source") == "misaligned").select(*name, "layer", F.signum("effect").alias("__sign"))
    agree = kept.join(same, [*name, "layer"]).groupBy(*name, "layer").agg(F.bool_and(c("__sign") == F.signum("effect")).alias("__same"))
    return agree.where("__same").select(*name, "layer")
