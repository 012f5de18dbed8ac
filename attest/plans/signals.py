"""Signal jobs on series derived from the text and vector tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attest.operators import signals as sg
from attest.plans import views as v
from attest.plans.registry import query
from attest.sources.signals import code_points

FS = 50.0


def text_windows(spark, sf):
    """Each document's code points as one channel and the reversed text as the other."""
    docs = v.table(spark, sf, "documents")
    return docs.select(F.col("source").alias("record"), F.col("doc_id").alias("segment"), code_points(F.col("text")).alias("ecg")) \
        .withColumn("resp", F.reverse("ecg"))


@query("bandpass")
def bandpass(spark, sf):
    rows = sg.bandpass(text_windows(spark, sf), "ecg", FS)
    energy = F.aggregate("filtered", F.lit(0.0), lambda a, x: a + x * x)
    return rows.select("record", "segment", F.size("filtered").alias("samples"), energy.alias("energy"))


@query("detect_beats")
def detect_beats(spark, sf):
    rows = sg.detect_beats(text_windows(spark, sf), "ecg", FS)
    return rows.select("record", "segment", F.size("beats").alias("n_beats"))


@query("paired_series")
def paired_series(spark, sf):
    kept, excluded = sg.paired_series(text_windows(spark, sf), ["record", "segment"], FS, 4.0, 0.05, 0.5)
    accepted = kept.select("record", "segment", F.lit(None).cast("string").alias("reason"), F.size("source").alias("grid_samples"))
    return accepted.unionByName(excluded.select("record", "segment", "reason", F.col("qc.grid_samples").alias("grid_samples")))


@query("normalise")
def normalise(spark, sf):
    rows = sg.normalise(v.pairs(spark, sf), ["source", "target"], v.FS, 0.05)
    return rows.select("window_id", F.element_at("source", 1).alias("first_source"), F.element_at("target", -1).alias("last_target"))


@query("spectral_peaks")
def spectral_peaks(spark, sf):
    rows = sg.spectrum(v.pairs(spark, sf), "source", v.FS, ["window_id"])
    strongest = sg.dominant_hz(v.pairs(spark, sf), "source", v.FS).select("window_id", "freq_hz")
    # The strongest bin of the spectrum and, as the studies use it, the strongest local maximum.
    return (rows.groupBy("window_id").agg(F.max_by("hz", "power").alias("top_hz"), F.max("power").alias("top_power"))
            .join(strongest, "window_id"))
