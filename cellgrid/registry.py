"""Verbs by name, and methods added to them from outside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

_METHODS: dict[tuple[str, str], Callable[..., DataFrame]] = {}


def register(verb: str, method: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Adds a method to a verb: @register("cluster", "mine")."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _METHODS[verb, method] = f
        return f

    return add


def call(verb: str, df: DataFrame, *args, method: str, **options) -> DataFrame:
    """A verb's method, registered ones first."""
    if (verb, method) in _METHODS:
        return _METHODS[verb, method](df, *args, **options)
    from .operators import batch, cluster, discovery, metacluster, reduce, sample, upsample

    built_in = {
        "cluster": cluster.cluster, "metacluster": metacluster.metacluster, "downsample": sample.downsample, "upsample": upsample.upsample,
        "reduce_dimensions": reduce.reduce_dimensions, "batch_correct": batch.batch_correct, "analyze_abundance": discovery.analyze_abundance, "analyze_expression": discovery.analyze_expression,
    }
    if verb not in built_in:
        raise ValueError(f"no verb {verb!r}")
    return built_in[verb](df, *args, method=method, **options)
