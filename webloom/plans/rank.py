"""The rank pass as one batch job: R2, S4, V10, K8."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators.pagerank import pagerank, resume_pagerank
from webloom.operators.scans import rank_input
from webloom.operators.upserts import persist_ranks, with_ranks
from webloom.operators.vertexprogram import VertexResult


@dataclass
class RankPass:
    """New ranks alone, documents with them, scores whose id is no link id, and the run.

    Write ``ranks``, which hold no text; ``docs`` is for those who keep both together.
    """

    ranks: DataFrame
    docs: DataFrame
    rejects: DataFrame
    result: VertexResult


def rank_pass(
    links: DataFrame,
    edges: DataFrame,
    docs: DataFrame,
    as_of: datetime | Column,
    last: DataFrame | None = None,
    **options: object,
) -> RankPass:
    """Rank the links and edges older than ``as_of`` and write the scores into the documents.

    ``last(id, score)``, the vertices of the pass before, makes it go on from there.
    Scheduling is the caller's: run it as often as ranks should be renewed.
    """
    vertices, older = rank_input(links, edges, as_of)
    graph = vertices.select("id"), older.select("src", "dst")
    result = pagerank(*graph, **options) if last is None else resume_pagerank(*graph, last.select("id", F.col("score")), **options)
    ranks, rejects = persist_ranks(docs.select("link_id", "pagerank"), result.vertices)
    return RankPass(ranks, with_ranks(docs, ranks), rejects, result)
