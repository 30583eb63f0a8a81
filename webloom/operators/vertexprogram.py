"""Vertex programs as DataFrame supersteps: V1-V8, P13, A9-A12, J3, J4.

A program is written in Column expressions.  In each superstep the vertices
that are active or have a message compute new values; those that computed send
their message along their out-edges, and it is delivered in the next superstep.

Physical design, per superstep one job of two stages:

* Vertices get a number each, and edges and messages carry these 8 bytes in
  place of ids several times as long.  Encoding the edges costs two joins,
  which also find edges of unknown vertices, and is paid back by the supersteps.
* Edges are partitioned and sorted by source once, written to the shared
  folder (``checkpoint``) and cached.  They are never shuffled again.
* Vertices stay partitioned by number.  Messages are summed per task before they
  are shuffled, so a hub that receives a third of all messages costs one row
  per task.
* The out-edges of a source with more than ``edges_per_block`` of them lie apart,
  spread over all partitions.  In a superstep the rows of these sources, at most
  100,000 by the choice of the bound, are broadcast to them; the other vertices
  and edges stay where they are.
* The new vertices are checkpointed by the same job that computes them.  That
  ends the lineage of the superstep, so a lost executor costs one superstep at
  most, and it keeps the plan of the next one small.  The partitioning
  survives, so the join with the messages shuffles the messages alone.
* Only one row of metrics comes back to the driver.  It is observed while the
  vertices are written, not computed by a second pass over them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from webloom.operators.skew import hot_keys, lookup_join
from webloom.session import planning, shared_dir

Globals = Mapping[str, float]
MAX_BLOCKED_SOURCES = 100_000
#: An edge is two numbers, so a partition of 40 million is some 640 MB before it is packed.
EDGES_PER_PARTITION = 40_000_000
VERTICES_PER_PARTITION = 5_000_000
#: Edges by the ids of their ends, as they are encoded, are several times as large and are sorted.
GIVEN_PER_PARTITION = 1_000_000


class UnknownDestination(ValueError):
    """A message has a destination that is no vertex."""


@dataclass
class VertexResult:
    """Final vertices, the number of the last superstep and the metrics; the edges if steps set their values."""

    vertices: DataFrame
    superstep: int
    history: list[dict[str, float]] = field(default_factory=list)
    edges: DataFrame | None = None

    def history_frame(self) -> DataFrame:
        """One row per superstep and metric."""
        rows = [
            (int(step["superstep"]), name, None if value is None else float(value))
            for step in self.history
            for name, value in step.items()
            if name != "superstep"
        ]
        return self.vertices.sparkSession.createDataFrame(rows, "superstep int, name string, value double")


def metric_delta(history: DataFrame) -> DataFrame:
    """Change of each metric since the superstep before."""
    order = Window.partitionBy("name").orderBy("superstep")
    return history.withColumn("delta", F.col("value") - F.lag("value", 1, 0.0).over(order))


def unknown_destinations(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of known sources whose destination is no vertex.

    Distinct destinations are compared first, so a hub is looked up once.  Both
    tables are read several times and written for that first.
    """
    shared_dir(edges.sparkSession)
    ids, edges = vertices.select("id").checkpoint(), edges.checkpoint()
    missing = edges.select("dst").distinct().join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    known, _ = hot_keys(edges, ["src", "dst"])
    lost = lookup_join(edges, missing.withColumnRenamed("dst", "_key"), "dst", "left_semi", known=known)
    return lookup_join(lost, ids.withColumnRenamed("id", "_key"), "src", "left_semi", known=known)


def out_degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices with ``out_degree``; parallel edges count, unknown sources do not."""
    counts = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    return (
        vertices.join(counts, "id", "left")
        .withColumn("out_degree", F.coalesce("_n", F.lit(0)))
        .drop("_n")
    )


def _single_value(vertices: DataFrame) -> DataFrame:
    """V7: one row per id; of several the greatest wins."""
    values = [c for c in vertices.columns if c != "id"]
    if not values:
        return vertices.select("id").distinct()
    return vertices.groupBy("id").agg(F.max(F.struct(*values)).alias("_v")).select("id", "_v.*")


class _Layout:
    """Vertices and edges laid out for the loop."""

    def __init__(
        self,
        spark: SparkSession,
        vertices: DataFrame,
        edges: DataFrame,
        on_unknown_dst: str,
        partitions: int | None,
        edges_per_block: int,
    ) -> None:
        self.edge_values = [c for c in edges.columns if c not in ("src", "dst")]
        # The numbers are not repeatable, so they are written before any use.
        self.keyed = _single_value(vertices).withColumn("_key", F.monotonically_increasing_id()).checkpoint()
        given = edges.persist()
        hot, total = hot_keys(given, ["src", "dst"])
        cores = spark.sparkContext.defaultParallelism
        with planning(spark, {"spark.sql.shuffle.partitions": max(cores, math.ceil(total / GIVEN_PER_PARTITION))}):
            base, encoded, valid, edge_count = self._encode(given, hot, on_unknown_dst)
            size = base.agg(F.count(F.lit(1)).alias("v"), F.max("out_degree").alias("hub")).first()
        self.vertex_count, hub = size["v"], size["hub"] or 0
        self.partitions = partitions or max(
            cores,
            math.ceil(edge_count / EDGES_PER_PARTITION),
            math.ceil(self.vertex_count / VERTICES_PER_PARTITION),
        )
        self.block = max(edges_per_block, math.ceil(edge_count / MAX_BLOCKED_SOURCES))
        self.blocked = hub > self.block
        hub_edges = None
        if self.blocked:
            hubs = base.where(F.col("out_degree") > self.block).select(F.col("_key").alias("_src"), F.lit(True).alias("_hub"))
            marked = valid.join(F.broadcast(hubs), "_src", "left")
            hub_edges, valid = marked.where("_hub").drop("_hub"), marked.where("_hub is null").drop("_hub")
        with planning(spark, self.settings()):
            self.edges = (
                valid.repartition(self.partitions, "_src").sortWithinPartitions("_src").checkpoint().persist()
            )
            self.hub_edges = hub_edges and hub_edges.repartition(self.partitions, *hub_edges.columns).checkpoint().persist()
            self.vertices = base.repartition(self.partitions, "_key").checkpoint()
        for frame in (base, encoded, given):
            frame.unpersist()

    def _encode(
        self, given: DataFrame, hot: Mapping[str, DataFrame | None], on_unknown_dst: str
    ) -> tuple[DataFrame, DataFrame, DataFrame, int]:
        """Vertices with their out-degrees, all edges by number, those of known destinations, and the number of all."""
        by_id = self.keyed.select(F.col("id").alias("_key"), F.col("_key").alias("_number"))
        encoded = lookup_join(given, by_id, "src", "inner", known=hot).withColumnRenamed("_number", "_src")
        encoded = lookup_join(encoded, by_id, "dst", "left", known=hot).withColumnRenamed("_number", "_dst")
        encoded = encoded.drop("src", "dst").persist()
        counted = encoded.agg(
            F.count(F.lit(1)).alias("all"), F.count_if(F.col("_dst").isNull()).alias("lost")
        ).first()
        if counted["lost"] and on_unknown_dst == "error":
            given.unpersist()
            encoded.unpersist()
            raise UnknownDestination(f"{counted['lost']} edges lead to unknown vertices")
        valid = encoded.where(F.col("_dst").isNotNull()) if counted["lost"] else encoded
        degrees = valid.groupBy(F.col("_src").alias("_key")).agg(F.count(F.lit(1)).alias("out_degree"))
        base = (
            self.keyed.join(degrees, "_key", "left")
            .withColumn("out_degree", F.coalesce("out_degree", F.lit(0)))
            .persist()
        )
        return base, encoded, valid, counted["all"]

    def release(self) -> None:
        self.edges.unpersist()
        if self.blocked:
            self.hub_edges.unpersist()

    def settings(self) -> dict[str, object]:
        # The partitioning is known and has to stay as it is from step to
        # step, so nothing is left for adaptive execution to decide.
        return {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": self.partitions}

    def update_edges(self, state: DataFrame, new: Mapping[str, Column], message: Column) -> None:
        """V8: the edges after a superstep, with the message each of them carries.

        Sources that computed set the values of their out-edges.  Edges lie with their
        sources, and those of hubs get the rows of the hubs, so nothing is shuffled.
        The edges before are given up once these are written.
        """
        unknown = set(new) - set(self.edge_values)
        if unknown:
            raise ValueError(f"edge_update sets columns that no edge has: {sorted(unknown)}")
        ran, same = F.col("_ran"), F.col("_key") == F.col("_src")
        values = [F.when(ran, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in self.edge_values]

        def step(edges: DataFrame, sources: DataFrame) -> DataFrame:
            changed = edges.drop("msg").join(sources, same).select("_src", "_dst", "_ran", *values, *self._others(sources))
            sent = changed.withColumn("msg", F.when(ran, message))
            after = sent.select("_src", "_dst", *self.edge_values, "msg").checkpoint()
            edges.unpersist()
            _forget(edges)
            return after

        self.edges = step(self.edges, state)
        if self.blocked:
            self.hub_edges = step(self.hub_edges, F.broadcast(state.where(F.col("out_degree") > self.block)))

    def _others(self, sources: DataFrame) -> list[str]:
        return [c for c in sources.columns if c not in ("_key", "_ran", "_active", *self.edge_values)]

    def carried(self) -> DataFrame:
        """The messages that ``update_edges`` left on the edges, as ``(_dst, msg)``."""
        sent = self.edges.select("_dst", "msg")
        return sent.unionByName(self.hub_edges.select("_dst", "msg")) if self.blocked else sent

    def final_edges(self, state: DataFrame) -> DataFrame:
        """The edges by the ids of their ends; those of the sources are found where the edges lie."""
        sources, same = state.select("_key", F.col("id").alias("src")), F.col("_key") == F.col("_src")
        every = self.edges.join(sources, same).select("src", "_dst", *self.edge_values)
        if self.blocked:
            hubs = F.broadcast(state.where(F.col("out_degree") > self.block).select("_key", F.col("id").alias("src")))
            every = every.unionByName(self.hub_edges.join(hubs, same).select("src", "_dst", *self.edge_values))
        ends = self.edges.select("_dst")
        if self.blocked:
            ends = ends.unionByName(self.hub_edges.select("_dst"))
        known, _ = hot_keys(ends, ["_dst"])
        ids = self.keyed.select("_key", F.col("id").alias("dst"))
        return lookup_join(every, ids, "_dst", "inner", known=known).select("src", "dst", *self.edge_values)

    def messages(self, senders: DataFrame, message: Column) -> DataFrame:
        """The messages the out-edges carry, as ``(_dst, msg)``."""
        same = F.col("_key") == F.col("_src")
        # The edges are the streamed side, which is not buffered by key.
        sent = self.edges.join(senders, same).select("_dst", message.alias("msg"))
        if self.blocked:
            hubs = F.broadcast(senders.where(F.col("out_degree") > self.block))
            sent = sent.unionByName(self.hub_edges.join(hubs, same).select("_dst", message.alias("msg")))
        return sent

    def addressed(self, sent: DataFrame, lost: Observation) -> DataFrame:
        """V6: messages ``(dst, msg)`` to given ids, as ``(_dst, msg)``.

        Those to unknown ids are counted in ``lost`` by the job that delivers the others.
        """
        ids = self.keyed.select(F.col("id").alias("dst"), F.col("_key").alias("_dst"))
        found = sent.select("dst", "msg").join(ids, "dst", "left").select("_dst", "msg")
        counted = found.observe(lost, F.count_if(F.col("_dst").isNull()).alias("lost"))
        return counted.where(F.col("_dst").isNotNull())


def run_vertex_program(
    vertices: DataFrame,
    edges: DataFrame,
    *,
    update: Callable[[int, Globals], Mapping[str, Column]],
    message: Column,
    combine: Callable[[str], Column] = F.sum,
    aggregates: Callable[[int], Mapping[str, Column]] | None = None,
    running: frozenset[str] | set[str] = frozenset(),
    halt: Callable[[int, Globals], Column] | None = None,
    send: Callable[[int, DataFrame], DataFrame] | None = None,
    edge_update: Callable[[int, Globals], Mapping[str, Column]] | None = None,
    pre_step: Callable[[int, Globals], None] | None = None,
    post_step: Callable[[int, Globals], None] | None = None,
    keep_running: Callable[[int, Globals], bool] | None = None,
    first_step: int = 0,
    max_steps: int | None = None,
    on_unknown_dst: str = "error",
    partitions: int | None = None,
    edges_per_block: int = 1_000_000,
) -> VertexResult:
    """Run supersteps until ``keep_running`` says no, or for ``max_steps``.

    * ``vertices`` has ``id`` and value columns, ``edges`` has ``src``, ``dst``
      and edge columns.  Edges of unknown sources are ignored (P9).
    * ``update(superstep, globals)`` maps value columns to expressions over the
      value columns, ``out_degree`` and ``msg``, the combined message or NULL.
    * ``message`` is an expression over value and edge columns; a NULL is not
      sent.  ``send(superstep, vertices)`` may add ``(dst, msg)`` rows for any
      destination (V6).
    * ``edge_update(superstep, globals)`` maps edge columns to expressions over the new
      values of the source and the values of the edge; an edge whose source computed
      takes them before its message is made (V8).  The result then has the edges.
    * ``aggregates(superstep)`` are aggregates over the vertices, whose column
      ``_ran`` tells those that computed; those named in ``running`` add up
      over the supersteps, others start anew.  ``globals`` holds their latest values, ``vertex_count`` and
      ``active``, the number of vertices that computed (A12).
    * A vertex for which ``halt`` holds sleeps until it gets a message (V5).
    * ``on_unknown_dst``: ``"error"`` or ``"drop"`` (J4).

    Without ``keep_running`` the run ends when nothing is left to compute.
    """
    if on_unknown_dst not in ("error", "drop"):
        raise ValueError("on_unknown_dst must be 'error' or 'drop'")
    spark = vertices.sparkSession
    shared_dir(spark)
    layout = _Layout(spark, vertices, edges, on_unknown_dst, partitions, edges_per_block)
    values = [c for c in vertices.columns if c != "id"]
    state = layout.vertices.withColumns({"_active": F.lit(True), "_ran": F.lit(False)})
    globals_: dict[str, float] = {"vertex_count": layout.vertex_count, "active": layout.vertex_count}
    history: list[dict[str, float]] = []
    step = first_step
    try:
        with planning(spark, layout.settings()):
            while layout.vertex_count and (max_steps is None or len(history) < max_steps):
                if pre_step:
                    pre_step(step, globals_)
                carried = layout.carried() if edge_update and history else None
                lost = Observation() if send and history else None
                inbox = _inbox(layout, state, message, combine, send, step, lost, carried) if history else None
                before = state
                state, metrics = _superstep(state, inbox, values, update, aggregates, halt, step, globals_)
                if lost and on_unknown_dst == "error" and lost.get["lost"]:
                    raise UnknownDestination(f"{lost.get['lost']} messages were sent to unknown vertices")
                _forget(before)
                if edge_update:
                    layout.update_edges(state, dict(edge_update(step, globals_)), message)
                for name in running:
                    if name in metrics or name in globals_:
                        metrics[name] = (globals_.get(name) or 0) + (metrics.get(name) or 0)
                globals_.update(metrics)
                history.append({"superstep": step, **metrics})
                step += 1
                if post_step:
                    post_step(step - 1, globals_)
                if keep_running is None:
                    if not globals_["active"]:
                        break
                elif not keep_running(step - 1, globals_):
                    break
    finally:
        layout.release()
    final = layout.final_edges(state) if edge_update else None
    return VertexResult(state.select("id", "out_degree", *values), step - 1, history, final)


def _forget(state: DataFrame) -> None:
    """Delete the checkpoint of a superstep whose successor is written.

    The cleaner does that only where the session is set up for it, and late.
    """
    plan = state._jdf.queryExecution().logical()
    if plan.nodeName().startswith("LogicalRDD") or "LogicalRDD" in plan.getClass().getName():
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            spark = state.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _inbox(
    layout: _Layout,
    state: DataFrame,
    message: Column,
    combine: Callable[[str], Column],
    send: Callable[[int, DataFrame], DataFrame] | None,
    step: int,
    lost: Observation | None,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Combined messages of the superstep before, one row per destination."""
    senders = state.where("_ran")
    sent = layout.messages(senders, message) if carried is None else carried
    sent = sent.where(F.col("msg").isNotNull())
    if send:
        extra = send(step - 1, senders.drop("_key", "_active", "_ran"))
        sent = sent.unionByName(layout.addressed(extra, lost))
    return sent.groupBy("_dst").agg(combine("msg").alias("msg"))


def _superstep(
    state: DataFrame,
    inbox: DataFrame | None,
    values: list[str],
    update: Callable[[int, Globals], Mapping[str, Column]],
    aggregates: Callable[[int], Mapping[str, Column]] | None,
    halt: Callable[[int, Globals], Column] | None,
    step: int,
    globals_: Globals,
) -> tuple[DataFrame, dict[str, float]]:
    if inbox is None:
        # The type does not matter: no message is there to be read.
        delivered = state.withColumn("msg", F.lit(None).cast("double"))
    else:
        delivered = state.join(inbox, F.col("_key") == F.col("_dst"), "left").drop("_dst")
    runs = F.col("_active") | F.col("msg").isNotNull()
    new = dict(update(step, globals_))
    unknown = set(new) - set(values)
    if unknown:
        raise ValueError(f"update sets columns that no vertex has: {sorted(unknown)}")
    sleeps = halt(step, globals_) if halt else F.lit(False)
    next_state = delivered.select(
        "_key",
        "id",
        "out_degree",
        *[F.when(runs, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in values],
        (runs & ~F.coalesce(sleeps, F.lit(False))).alias("_active"),
        runs.alias("_ran"),
    )
    wanted = aggregates(step) if aggregates else {}
    seen = Observation()
    state = next_state.observe(
        seen, F.count_if("_ran").alias("active"), *[c.alias(name) for name, c in wanted.items()]
    ).checkpoint()
    return state, seen.get
