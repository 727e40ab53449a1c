"""Registry of the engine's own queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_corpus, q_data, q_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**q_corpus.QUERIES, **q_data.QUERIES, **q_text.QUERIES}
ORACLES: dict[str, str] = {**q_corpus.ORACLES, **q_data.ORACLES, **q_text.ORACLES}
