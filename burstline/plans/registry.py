"""Every named query: a builder ``(spark, sf_dir) -> DataFrame`` and, where SQL can express it, its SQL."""

from __future__ import annotations

from burstline.plans import detection, diagnostics, folds, library, matching, signals, streams

_ALL = {**detection.QUERIES, **library.QUERIES, **matching.QUERIES, **folds.QUERIES, **diagnostics.QUERIES, **signals.QUERIES, **streams.QUERIES}

QUERIES = {name: builder for name, (builder, _) in _ALL.items()}
SQL: dict[str, str] = {name: sql for name, (_, sql) in _ALL.items() if sql}
