"""Operators without state run unchanged on streams: scan, rescoring and peptide scoring of arriving sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.cleavage import scan_cleavage, score_sites
from ..operators.ml import predict_peptides


def stream_sites(sequences: DataFrame, pwm: DataFrame | None = None) -> DataFrame:
    """Cut sites of a stream of proteins (id, seq), rescored by a static matrix if one is given."""
    sites = scan_cleavage(sequences)
    return sites if pwm is None else score_sites(sites, pwm)


def stream_predictions(sequences: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """Scores of a stream of peptides (id, seq) by a fitted model."""
    return predict_peptides(sequences, model, threshold)
