"""Answers kept in factors: which question has which block, and each block once.

Many questions share countries.  Joined out, an answer repeats a country's
whole listing for every question that names it, so it grows with questions
times listings.  In factors it grows with their sum: ``answers`` has one row
per (question, key), ``blocks`` each key's rows once, with the number of
questions that refer to them.  Readers expand what they look at.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commsight.operators.joins import bounded_broadcast
from commsight.sources.tables import read_table, write_table


class Factored(NamedTuple):
    """``answers`` (query_id, key) and ``blocks`` (key, n_refs, ...)."""

    answers: DataFrame
    blocks: DataFrame


def factorise(selection: DataFrame, listing: DataFrame, key: str = "Country", query_id: str = "query_id",
              refs: str = "n_refs") -> Factored:
    """The answers of ``selection`` (query_id, key) over ``listing`` (key, ...).

    Keys that no question has are not in the blocks, keys without a block are
    not in the answers; null keys are in neither.  A selection that repeats
    counts once.  The reference counts are taken before the listing is met,
    so neither side is ever multiplied by the other.
    """
    chosen = selection.select(query_id, key).where(F.col(key).isNotNull()).distinct()
    counts = chosen.groupBy(key).agg(F.count(F.lit(1)).alias(refs))
    # (Joined, not filtered: the count of a key goes along.)
    blocks = listing.join(bounded_broadcast(counts), key)
    held = listing.select(key).distinct()
    return Factored(chosen.join(bounded_broadcast(held), key, "left_semi").select(query_id, key), blocks)


def expand(answer: Factored, key: str = "Country", refs: str = "n_refs", questions: DataFrame | None = None,
           query_id: str = "query_id") -> DataFrame:
    """The rows of all questions, or of ``questions`` (query_id) only."""
    answers = answer.answers if questions is None else answer.answers.join(
        bounded_broadcast(questions.select(query_id).distinct()), query_id, "left_semi")
    return answers.join(answer.blocks.drop(refs), key).select(query_id, key, *[
        c for c in answer.blocks.columns if c not in (key, refs)])


def condense(answer: Factored, by: Sequence[str], *measures: Column, key: str = "Country",
             refs: str = "n_refs") -> Factored:
    """The same answers over one row per key and ``by`` with ``measures`` of its
    block rows.  All questions share a block, so its measures are taken once;
    ``expand`` then gives what grouping the expanded rows by question, key and
    ``by`` would, without the rows."""
    return Factored(answer.answers, answer.blocks.groupBy(key, *by, refs).agg(*measures))


def write_factored(answer: Factored, path: str) -> tuple[int, int]:
    """Both factors as tables under ``path``; returns their row counts."""
    return write_table(answer.answers, f"{path}/answers", min_rows=0), write_table(answer.blocks, f"{path}/blocks", min_rows=0)


def read_factored(spark, path: str) -> Factored:
    return Factored(read_table(spark, f"{path}/answers"), read_table(spark, f"{path}/blocks"))
