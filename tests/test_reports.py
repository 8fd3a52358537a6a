"""Source tables of figures from small metrics tables, whole and broken."""

import statistics

from vectrine.operators import gates as G
from vectrine.operators import reports as R

COLUMNS = [x.split()[0] for x in G.METRICS.split(", ")]
LABELS = ["fear", "anger"]


def row(kind, source, status, name, layer, estimate, value, notes=""):
    column = {"cosine": "cosine", "reliability": "reliability", "explained_fraction": "explained_fraction"}[estimate]
    found = {"comparison_type": kind, "model_source": source, "pca_status": status, "emotion_or_group": name, "layer": layer, "estimate_name": estimate, column: value, "gate_passed": True, "confirmatory": False, "notes": notes}
    return tuple(found.get(c) for c in COLUMNS)


def whole():
    out = []
    for layer in (0, 1):
        for source in ("aligned", "misaligned"):
            for status in ("raw", f"cleaned_{source}_basis"):
                for k, name in enumerate([*LABELS, "calm"]):
                    out.append(row("individual", source, status, name, layer, "cosine", 0.1 * k + 0.01 * layer + (0.5 if status == "raw" else 0)))
                    out.append(row("split_reliability", source, status, name, layer, "reliability", 0.9 - 0.1 * k))
                for note in ("one", "two"):
                    out.append(row("centroid", source, status, "group", layer, "cosine", 0.3 + 1e-14 * (note == "two"), note))
                out.append(row("subspace", source, status, "group", layer, "explained_fraction", 0.2))
        for k, name in enumerate([*LABELS, "calm"]):
            out.append(row("cross_model_stability", "cross_model", "raw", name, layer, "cosine", 0.8 + 0.01 * k))
    return out


def test_tables(spark):
    metrics = spark.createDataFrame(whole(), G.METRICS)
    cells = R.figure_cells(metrics, LABELS)
    got = {(r.figure, r.model_source, r.pca_status, r.emotion_or_group, r["layer"]): (round(r.value, 9), r.n) for r in R.figure_sources(cells).collect()}
    counts = {f: sum(k[0] == f for k in got) for f in R.FIGURES}
    assert counts == {"individual_heatmap": 4, "centroid_overlap": 4, "subspace_fraction": 4, "split_half_reliability": 12, "cross_model_stability": 6, "raw_vs_cleaned": 4}
    assert got["raw_vs_cleaned", "aligned", "raw", None, 1] == (round(statistics.median([0.51, 0.61]), 9), 2)
    assert got["individual_heatmap", "aligned", "raw", "anger", 0] == (0.6, 1) and got["split_half_reliability", "misaligned", "raw", "calm", 1] == (0.7, 1)
    assert R.figure_faults(cells, LABELS).count() == 0


def faults(spark, rows, labels=LABELS):
    return {tuple(r) for r in R.figure_faults(R.figure_cells(spark.createDataFrame(rows, G.METRICS), labels), labels).collect()}


def test_faults(spark):
    rows = whole()
    place = lambda kind, **want: next(i for i, r in enumerate(rows) if r[0] == kind and all(r[COLUMNS.index(k)] == v for k, v in want.items()))
    assert faults(spark, rows + [rows[place("subspace", pca_status="raw")]]) == {("subspace_fraction", "repeated cell", 1)}
    assert faults(spark, rows + [row("centroid", "aligned", "raw", "group", 0, "cosine", 0.31)]) == {("centroid_overlap", "controls differ", 1)}
    i = place("individual", model_source="aligned", pca_status="raw", emotion_or_group="fear")
    assert faults(spark, rows[:i] + rows[i + 1 :]) == {("individual_heatmap", "missing cell", 1), ("raw_vs_cleaned", "missing cell", 1)}
    assert faults(spark, [r for r in rows if r[0] != "cross_model_stability"]) == {("cross_model_stability", "no rows", 1)}
    assert faults(spark, [r for r in rows if r[COLUMNS.index("pca_status")] == "raw"]) == {("raw_vs_cleaned", "missing cell", 4)}
    assert faults(spark, rows, [*LABELS, "envy"]) == {("individual_heatmap", "missing cell", 2), ("raw_vs_cleaned", "missing cell", 4)}
    hollow = row("split_reliability", "aligned", "raw", "fear", 0, "reliability", None)
    j = place("split_reliability", model_source="aligned", pca_status="raw", emotion_or_group="fear")
    assert faults(spark, rows[:j] + rows[j + 1 :] + [hollow]) == {("split_half_reliability", "no value", 1)}
    assert {f for f, what, _ in faults(spark, []) if what == "no rows"} == set(R.FIGURES)
