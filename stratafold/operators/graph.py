"""Connected components, flood fill and the patch sieve of rasters, on runs instead of cells.

Cells of a row that hang together become runs (one window along each row), and runs of neighbouring rows that overlap become
edges. Components are found in two steps that are the same at every size. First each partition of edges, which lie together by
bands of rows, is solved on its own: a long snake within a band is one step. What is left is a small graph of the partitions'
local labels that share a node, the nodes on the borders of bands. Labels spread over that graph in driver loops over written
tables; each round also jumps to the label's own label, so a component's rounds grow with the logarithm of the bands it winds
through. Nothing is collected but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.session import materialize, release

#: Rows of a band of edges that are solved together.
BAND_ROWS = 512


def runs_of(cells: DataFrame, group: str) -> DataFrame:
    """Horizontal runs of cells (``r, c, group``): ``run_id, r, group, start, stop``; absent cells end a run.

    Rows and columns are 32-bit numbers from 0; an id is the row and the first column in one long.
    """
    w = Window.partitionBy("r").orderBy("c")
    joined = (F.lag("c").over(w) == F.col("c") - 1) & (F.lag(group).over(w) == F.col(group))
    numbered = cells.withColumn("__n", F.sum(F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).over(w))
    runs = numbered.groupBy("r", "__n").agg(F.first(group).alias(group), F.min("c").alias("start"), F.max("c").alias("stop")).drop("__n")
    return runs.withColumn("run_id", F.shiftleft(F.col("r").cast("long"), 32).bitwiseOR(F.col("start").cast("long")))


def run_edges(runs: DataFrame, group: str, band: int = 256) -> DataFrame:
    """Pairs of runs of one group in neighbouring rows that share a column (``a`` above ``b``), with the band of rows they lie in.

    Runs are spread over column bands, so that the join has an equality on (row, band) besides the overlap.
    """
    spread = F.explode(F.sequence(F.floor(F.col("start") / band), F.floor(F.col("stop") / band))).alias("band")
    left = runs.select(F.col("run_id").alias("a"), (F.col("r") - 1).alias("r"), F.col(group).alias("g"), F.col("start").alias("s1"), F.col("stop").alias("e1"), spread)
    right = runs.select(F.col("run_id").alias("b"), "r", F.col(group).alias("g"), F.col("start").alias("s2"), F.col("stop").alias("e2"), spread)
    # Two runs meet in the first band that both touch, and are a pair once.
    first = F.greatest(F.floor(F.col("s1") / band), F.floor(F.col("s2") / band)) == F.col("band")
    return left.join(right, ["r", "band", "g"]).where(first & (F.col("s1") <= F.col("e2")) & (F.col("s2") <= F.col("e1"))).select("a", "b", F.floor(F.col("r") / BAND_ROWS).alias("place"))


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}
    kind = None

    def root(x):
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        ids = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([root(x) for x in ids], kind)], names=["id", "found"])


def components(nodes: DataFrame, edges: DataFrame, most: int = 64) -> DataFrame:
    """``id, label``: the least id of each node's component. ``nodes``: id; ``edges``: a, b in either direction and, where edges
    that lie near each other are known, ``place``. Ids are longs or texts without nulls.

    ``most`` rounds reach through components of 2 ** ``most`` bands; more is an error.
    """
    placed = edges.repartition("place") if "place" in edges.columns else edges.repartition("a")
    kind = nodes.schema["id"].dataType
    pair = T.StructType([T.StructField("id", kind), T.StructField("found", kind)])
    local = materialize(placed.select("a", "b").mapInArrow(_union_find, pair))
    # Nodes that several partitions met: their local labels are of one component.
    shared = local.groupBy("id").agg(F.min("found").alias("low"), F.collect_set("found").alias("found")).where(F.size("found") > 1)
    links = materialize(shared.select("low", F.explode("found").alias("other")).where("low <> other").distinct())
    both = links.selectExpr("low AS a", "other AS b").unionByName(links.selectExpr("other AS a", "low AS b"))
    before = labels = materialize(both.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id")))
    changed = bool(labels.limit(1).count())
    for _ in range(most):
        if not changed:
            break
        heard = both.join(labels.withColumnsRenamed({"id": "b"}), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("heard"))
        lowered = labels.join(heard, "id", "left").select("id", "label", F.least("label", F.coalesce("heard", "label")).alias("low"))
        # Jump: follow the new label to that node's own new label.
        jump = lowered.select(F.col("id").alias("low"), F.col("low").alias("next"))
        low = F.least("low", F.coalesce("next", "low"))
        after = materialize(lowered.join(jump, "low", "left").select("id", low.alias("label"), (low != F.col("label")).alias("changed")))
        release(before)
        before, labels = after, after.select("id", "label")
        changed = bool(after.where("changed").limit(1).count())
    if changed:
        raise RuntimeError(f"labels still changed after {most} rounds")
    own = local.join(labels.withColumnsRenamed({"id": "found"}), "found", "left").groupBy("id").agg(F.min(F.coalesce("label", "found")).alias("label"))
    return nodes.select("id").join(own, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def label_cells(cells: DataFrame, group: str) -> DataFrame:
    """``cells`` with ``component``, the least run of the 4-connected patch of one group."""
    runs = materialize(runs_of(cells, group))
    labels = components(runs.select(F.col("run_id").alias("id")), run_edges(runs, group))
    labelled = runs.join(labels, runs.run_id == labels.id).select("r", F.col("label").alias("component"), F.explode(F.sequence("start", "stop")).alias("c"))
    return cells.join(labelled, ["r", "c"])


def flood(cells: DataFrame, open_: str, seed: str) -> DataFrame:
    """Cells that 4-connected steps over ``open_`` cells reach from ``seed`` cells (boolean columns)."""
    labelled = label_cells(cells.where(F.col(open_)).withColumn("__open", F.lit(1)), "__open")
    reached = labelled.where(F.col(seed)).select("component").distinct()
    return labelled.join(reached, "component", "left_semi").drop("__open", "component")


def sieve(cells: DataFrame, value: str, least: int, passes: int = 2) -> DataFrame:
    """Patches of fewer than ``least`` cells take the class with most border contacts around them, the lowest on a tie."""
    for _ in range(passes):
        labelled = materialize(label_cells(cells, value))
        small = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least).select("component")
        inside = labelled.join(small, "component", "left_semi")
        around = inside.select("component", F.explode(F.array(*(F.struct((F.col("r") + i).alias("r"), (F.col("c") + j).alias("c")) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0))))).alias("p")).select("component", "p.r", "p.c")
        contact = around.join(labelled.select("r", "c", F.col("component").alias("other"), F.col(value).alias("k")), ["r", "c"]).where("other <> component")
        votes = contact.groupBy("component", "k").count().groupBy("component").agg(F.max(F.struct("count", (-F.col("k")).alias("order"), "k")).alias("best")).select("component", F.col("best.k").alias("__new"))
        cells = materialize(labelled.join(votes, "component", "left").withColumn(value, F.coalesce("__new", value)).drop("__new", "component"))
    return cells
