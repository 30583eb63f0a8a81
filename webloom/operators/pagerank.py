"""PageRank as a vertex program: V9, V10, A3-A7, P8, P9, J9.

Superstep 0 counts the vertices, superstep 1 gives each 1/N, and from then on

    new = (1 - d)/N + d * (sum of incoming) + d * (mass of dead ends of the step before)/N

until the sum of absolute differences falls below the tolerance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators.vertexprogram import Globals, VertexResult, run_vertex_program
from webloom.schemas import DAMPING, TOLERANCE


#: Shares of the tolerance that residuals too small to send, and what dead ends have sent,
#: may take; the rest is for what is on its way.
UNSENT_SHARE, SAVED_SHARE = 0.9, 0.02


def without_self_links(edges: DataFrame) -> DataFrame:
    """P8."""
    return edges.where(F.col("src") != F.col("dst"))


def _checked(damping: float, tolerance: float) -> tuple[float, float]:
    if not 0 <= damping <= 1:
        raise ValueError("damping must be in the range [0, 1]")
    if not 0 <= tolerance < 1:
        raise ValueError("tolerance must be in the range [0, 1)")
    return damping or DAMPING, tolerance or TOLERANCE


def pagerank(
    vertices: DataFrame,
    edges: DataFrame,
    damping: float = DAMPING,
    tolerance: float = TOLERANCE,
    max_steps: int | None = None,
    on_unknown_dst: str = "error",
    post_step: Callable[[int, Globals], None] | None = None,
    **layout: object,
) -> VertexResult:
    """Scores ``(id, out_degree, score, delta)`` of ``vertices(id)`` over ``edges(src, dst)``.

    0 for ``damping`` or ``tolerance`` means the default.  There is no limit on
    supersteps unless ``max_steps`` gives one (superstep 0 counts); with
    damping 1 a periodic graph never converges.
    """
    damping, tolerance = _checked(damping, tolerance)

    def update(step: int, g: Globals) -> dict[str, Column]:
        n = float(g["vertex_count"])
        if step == 1:
            score = F.lit(1.0 / n)
        else:
            base = (1.0 - damping) / n + damping * (g["residual"] or 0.0)
            score = F.lit(base) + F.lit(damping) * F.coalesce("msg", F.lit(0.0))
        return {"score": score, "delta": F.abs(score - F.col("score"))}

    dead_end = F.when(F.col("out_degree") == 0, F.col("score"))
    started = vertices.select("id", F.lit(0.0).alias("score"), F.lit(0.0).alias("delta"))
    # Superstep 0 only counts, and the layout of the vertices has done that.
    steps = None if max_steps is None else max(max_steps - 1, 0)
    n_of: dict[str, float] = {}

    def aggregates(step: int) -> dict[str, Column]:
        return {
            "sad": F.sum("delta"),
            "residual": F.coalesce(F.sum(dead_end), F.lit(0.0)) / F.count(F.lit(1)),
        }

    def keep_running(step: int, g: Globals) -> bool:
        return not (step > 1 and g["sad"] < tolerance)

    def remember(step: int, g: Globals) -> None:
        n_of["page_count"] = g["vertex_count"]

    result = run_vertex_program(
        started,
        without_self_links(edges).select("src", "dst"),
        update=update,
        message=F.col("score") / F.nullif("out_degree", F.lit(0)),
        combine=F.sum,
        aggregates=aggregates,
        pre_step=remember,
        post_step=post_step,
        keep_running=keep_running,
        first_step=1,
        max_steps=steps,
        on_unknown_dst=on_unknown_dst,
        **layout,
    )
    if n_of:
        n = n_of["page_count"]
        first = {"superstep": 0, "active": n, "sad": 0.0, "residual": 0.0}
        result.history = [{**row, "page_count": n} for row in [first, *result.history]]
    return result


def resume_pagerank(
    vertices: DataFrame,
    edges: DataFrame,
    last: DataFrame,
    damping: float = DAMPING,
    tolerance: float = TOLERANCE,
    max_steps: int | None = None,
    on_unknown_dst: str = "error",
    **layout: object,
) -> VertexResult:
    """Scores ``(id, out_degree, score)`` from those of an earlier run, ``last(id, score)``.

    The first superstep sends the last scores along all edges, and the second finds what
    each vertex lacks: its residual, the difference between what it gets and what it has.
    From then on only vertices whose residual counts add it to their score and send it
    on, so the work follows what has changed.  ``pushed_edges`` of the history is the
    number of edges that carried something.

    The residuals left over sum to less than ``tolerance``, as those of ``pagerank`` do, so
    the scores are off the exact ones by less than ``tolerance / (1 - damping)`` in all.
    They need not be those of a full run digit by digit.  What dead ends send goes to all
    vertices alike; it is saved up until it counts.  A vertex that ``last`` does not have,
    or with a null, starts at 0.
    """
    damping, tolerance = _checked(damping, tolerance)
    zero = F.lit(0.0)
    saved = {"each": 0.0}  # what every vertex is still to get from dead ends

    def update(step: int, g: Globals) -> dict[str, Column]:
        n = float(g["vertex_count"])
        if step == 1:
            return {"sent": F.col("score")}
        saved["each"] += damping * float(g["dead"] or 0.0) / n
        given = 0.0
        if step == 2 or n * abs(saved["each"]) > SAVED_SHARE * tolerance:
            given, saved["each"] = saved["each"], 0.0
        held = F.lit((1.0 - damping) / n) - F.col("score") if step == 2 else F.col("residual")
        found = held + F.lit(damping) * F.coalesce("msg", zero) + F.lit(given)
        # If no vertex is above this, what is left over is below the tolerance.
        counts = F.abs(found) > UNSENT_SHARE * tolerance / n
        return {
            "score": F.when(counts, F.col("score") + found).otherwise(F.col("score")),
            "sent": F.when(counts, found).otherwise(zero),
            "residual": F.when(counts, zero).otherwise(found),
        }

    def aggregates(step: int) -> dict[str, Column]:
        return {
            "left": F.sum(F.abs("residual")) + F.lit(damping) * F.sum(F.abs("sent")),
            "dead": F.sum(F.when(F.col("out_degree") == 0, F.col("sent")).otherwise(zero)),
            "pushed_edges": F.sum(F.when(F.col("sent") != 0, F.col("out_degree")).otherwise(F.lit(0))),
        }

    def keep_running(step: int, g: Globals) -> bool:
        return step < 2 or g["left"] + g["vertex_count"] * abs(saved["each"]) >= tolerance

    score = F.coalesce(F.col("score").cast("double"), zero)
    started = vertices.select("id").join(last.select("id", "score"), "id", "left")
    result = run_vertex_program(
        started.select("id", score.alias("score"), zero.alias("residual"), zero.alias("sent")),
        without_self_links(edges).select("src", "dst"),
        update=update,
        message=F.when(F.col("sent") != 0, F.col("sent") / F.nullif("out_degree", F.lit(0))),
        combine=F.sum,
        aggregates=aggregates,
        keep_running=keep_running,
        first_step=1,
        max_steps=max_steps,
        on_unknown_dst=on_unknown_dst,
        **layout,
    )
    result.vertices = result.vertices.select("id", "out_degree", (F.col("score") + F.col("residual")).alias("score"))
    return result
