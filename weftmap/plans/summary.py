"""Composed runs: everything that a map's report needs, from one written copy of the map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from ..operators import bands, blocks, detect, metrics, spectra, windows


def analysis(contact: DataFrame, ranges: DataFrame, n: int) -> dict[str, DataFrame]:
    """Lazy results by name; the map is written once and all results read that copy."""
    cm = written(contact, "map")
    profile = bands.intra_profile(cm, ranges, bands.decay_limit(n))
    insulation = windows.normalised_insulation(windows.insulation(cm, n))
    return {
        "expected": bands.expected_by_distance(cm, n),
        "decay": bands.decay_fit(profile),
        "insulation": insulation,
        "boundaries": windows.boundaries(insulation),
        "directionality": windows.directionality(cm, n),
        "library": blocks.library_quality(cm, ranges),
        "support": blocks.join_support(cm, ranges, n),
        "checkerboard": spectra.checkerboard(cm, ranges),
    }


def health(contact: DataFrame, ranges: DataFrame, n: int) -> DataFrame:
    """One row: the health score of a map from its own analyses.

    Misassemblies are sought among the domain boundaries and the sign changes of the compartments.
    """
    cm = written(contact, "map")
    a = analysis(cm, ranges, n)
    track = written(spectra.compartments(cm, n).select("p", "e1", "eigenvalue"), "track")
    flags = detect.misassemblies(a["boundaries"], track, ranges).agg(F.count(F.lit(1)).alias("flags"))
    one = metrics.assembly_metrics(ranges).select("n50", "total")
    for part in (a["decay"].select(F.col("slope").alias("exponent")), a["library"].select("cis_ratio"), flags, a["checkerboard"].agg(F.avg("score").alias("checkerboard")), track.agg(F.max("eigenvalue").alias("eigenvalue"))):
        one = one.crossJoin(part)  # one row each
    return metrics.health_score(one)
