"""QUERIES: name -> (spark, sf_dir) -> DataFrame; ORACLES: name -> the same rows as DuckDB SQL."""

from __future__ import annotations

from plectra.plans import q_extra, q_features, q_intervals, q_maps, q_models, q_more, q_pairs, q_sources

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (q_pairs, q_maps, q_intervals, q_features, q_models, q_more, q_sources, q_extra):
    QUERIES |= _part.BOOK.queries
    ORACLES |= _part.BOOK.oracles
