"""Vertex programs: supersteps over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .materialise import cut


@dataclass
class Step:
    """What a superstep leaves: vertices' new state, messages (dst, payload), and vertices to add.

    vertices has the columns it came with; a column `active` that is false is a vote to halt.
    """

    vertices: DataFrame
    messages: DataFrame | None = None
    added: DataFrame | None = None


Compute = Callable[..., Step]
#: What a control function may ask for: stop after this superstep, or wake all vertices for the next.
STOP, WAKE_ALL = "stop", "wake all"


def run(
    vertices: DataFrame,
    compute: Compute,
    supersteps: int,
    combiner: Callable[[Column], Column] | None = None,
    stop_when_quiet: bool = False,
    aggregators: dict[str, Column] | None = None,
    control: Callable[[int, dict], str | None] | None = None,
) -> DataFrame:
    """Run `supersteps` rounds over vertices(vid, state...); returns their last state.

    In every round compute() gets the active vertices with a column `inbox`: null in the first round
    and for vertices without mail, else the combined payload (without combiner an array). All vertices
    are active at first, later those that have not voted to halt and those with mail. Messages to
    unknown vertices are dropped. An added vid that is there already keeps its old state.

    aggregators are worked out over all vertices after every superstep; the next one's compute() gets
    them as a third argument (an empty dict at first), and control(superstep, aggregates) may answer
    STOP or WAKE_ALL.
    """
    state = vertices if "active" in vertices.columns else vertices.withColumn("active", F.lit(True))
    state, mail = cut(state.withColumn("active", F.lit(True))), None
    gather = combiner or (lambda c: F.sort_array(F.collect_list(c)))
    columns, totals = state.columns, {}
    for step in range(1, supersteps + 1):
        if mail is None:
            ready = state.withColumn("inbox", F.lit(None)) if step == 1 else state.limit(0).withColumn("inbox", F.lit(None))
            asleep = state.limit(0)
        else:
            box = mail.groupBy(F.col("dst").alias("vid")).agg(gather(F.col("payload")).alias("inbox"))
            got = state.join(box, "vid", "left")
            awake = F.col("active") | F.col("inbox").isNotNull()
            ready, asleep = got.filter(awake).withColumn("active", F.lit(True)), got.filter(~awake).select(*columns)
        done = compute(ready, step, totals) if aggregators is not None else compute(ready, step)
        state = done.vertices.select(*columns).unionByName(asleep)
        if done.added is not None:
            new = done.added.withColumn("active", F.lit(True)).select(*columns).dropDuplicates(["vid"])
            state = state.unionByName(new.join(state.select("vid"), "vid", "left_anti"))
        state = cut(state)
        mail = cut(done.messages.select("dst", "payload")) if done.messages is not None else None
        if aggregators is not None:
            totals = state.agg(*[c.alias(k) for k, c in aggregators.items()]).first().asDict()
        asked = control(step, totals) if control else None
        if asked == STOP:
            break
        if asked == WAKE_ALL:
            state, mail = state.withColumn("active", F.lit(True)), mail if mail is not None else state.select(F.col("vid").alias("dst"), F.lit(None).alias("payload")).limit(0)
        if stop_when_quiet and (mail is None or not mail.limit(1).count()) and not state.filter("active").limit(1).count():
            break
    return state


def multicast(senders: DataFrame, edges: DataFrame, payload: Column) -> DataFrame:
    """Messages from every row of senders(vid, ...) to its neighbours in edges(src, dst)."""
    return senders.select("vid", payload.alias("payload")).join(edges.select("src", "dst"), F.col("vid") == F.col("src")).select("dst", "payload")


def least_reachable(vertices: DataFrame, edges: DataFrame, supersteps: int) -> DataFrame:
    """(vid, least): the least vid within supersteps - 1 edges, by min-combined messages."""

    def compute(rows: DataFrame, step: int) -> Step:
        if step == 1:
            state = rows.withColumn("least", F.col("vid"))
            return Step(state, multicast(state, edges, F.col("least")))
        better = rows.withColumn("least", F.least("least", F.coalesce("inbox", "least")))
        changed = rows.filter(F.col("inbox") < F.col("least")).withColumn("least", F.col("inbox"))
        return Step(better.withColumn("active", F.lit(False)), multicast(changed, edges, F.col("least")))

    start = vertices.select("vid").withColumn("least", F.col("vid"))
    return run(start, compute, supersteps, combiner=F.min).select("vid", "least")
