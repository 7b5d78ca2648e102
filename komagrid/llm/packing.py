"""Filling fixed-capacity containers: bounded-space online packing.

Each partition keeps a fixed number of open windows for each spec. An item goes into the window that it fills
best; if none has room and all windows are in use, the fullest is emitted. What is left open at the end of the
partitions is merged by packing the windows themselves, in rounds, until few are left. Memory is the open windows only.

Defined results: an item larger than the capacity is cut into full pieces and a remainder, any other stays whole;
an item that equals the capacity fits; a null or negative size counts as 0; repeated items are packed each; an empty
table gives no container; a capacity that is null or not above 0 is an error.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from komagrid.session import bounded_rows, cut

MAX_SPECS = 1_000
WINDOWS = 64


class Windows:
    """The open windows of one spec in one partition."""

    def __init__(self, capacity: int, windows: int, prefix: str) -> None:
        self.capacity, self.most, self.prefix = capacity, windows, prefix
        self.free: list[tuple[int, int]] = []  # (room left, window), sorted
        self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made

    def place(self, size: int) -> int:
        """The window that ``size`` (at most the capacity) goes into."""
        at = bisect_left(self.free, (size, 0))
        if at < len(self.free):
            room, window = self.free.pop(at)
        else:
            room, window = self.capacity, self.new()
            if len(self.free) >= self.most:
                self.free.pop(0)  # the fullest one is emitted
        if room > size:
            insort(self.free, (room - size, window))
        return window


def _pack(items: DataFrame, specs: list[tuple[str, int]], windows: int, round_: int) -> DataFrame:
    """(spec_name, item, piece, size, container, room): room is null once the container is emitted.

    ``items``: spec_name (null for every spec), item, size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        open_ = {name: Windows(capacity, windows, f"{name}-{round_}-{part}-") for name, capacity in specs}
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("spec_name", "item", "piece", "size", "container")}
            for spec, item, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                size = max(0, size or 0)
                for name, w in open_.items() if spec is None else ((spec, open_[spec]),):
                    whole, rest = divmod(size, w.capacity)
                    pieces = [w.capacity] * whole + [rest] * (rest > 0 or not whole)
                    for piece, part_size in enumerate(pieces):
                        rows["spec_name"].append(name)
                        rows["item"].append(item)
                        rows["piece"].append(piece)
                        rows["size"].append(part_size)
                        rows["container"].append(w.prefix + str(w.new() if part_size == w.capacity else w.place(part_size)))
            yield pa.RecordBatch.from_pydict(rows | {"room": pa.nulls(len(rows["item"]), pa.int64())}, schema=schema)
        left = [(name, w.prefix + str(window), room) for name, w in open_.items() for room, window in w.free]
        if left:
            names, containers, rooms = zip(*left, strict=True)
            none = [None] * len(left)
            yield pa.RecordBatch.from_pydict(
                {"spec_name": names, "item": none, "piece": none, "size": none, "container": containers, "room": rooms}, schema=schema
            )

    schema = pa.schema([("spec_name", "string"), ("item", "string"), ("piece", "int64"), ("size", "int64"), ("container", "string"), ("room", "int64")])
    kind = "spec_name string, item string, piece bigint, size bigint, container string, room bigint"
    return items.select("spec_name", "item", "size").mapInArrow(run, kind)


def pack(items: DataFrame, specs: DataFrame, item: str = "doc_id", size: str = "n_tokens", windows: int = WINDOWS) -> DataFrame:
    """Where each piece of each item goes: spec_name, ``item``, piece, size, capacity, container.

    ``specs``: spec_name, capacity; a dimension of at most ``MAX_SPECS`` rows.
    """
    spark = items.sparkSession
    capacities = [(r[0], r[1]) for r in bounded_rows(specs.select("spec_name", "capacity").distinct(), MAX_SPECS, "specs")]
    if any(n is None or c is None or c <= 0 for n, c in capacities) or len({n for n, _ in capacities}) < len(capacities):
        raise ValueError("each spec needs one name and one capacity above 0")
    kind = items.schema[item].dataType
    source = items.select(F.lit(None).cast("string").alias("spec_name"), F.col(item).cast("string").alias("item"), F.col(size).cast("bigint").alias("size"))
    placed = cut(_pack(source, capacities, windows, 0))
    moves = None
    left = placed.where("room is not null").select("spec_name", "container", "room")
    by_name = spark.createDataFrame(capacities, "spec_name string, capacity bigint")
    round_ = 0
    parts = source.rdd.getNumPartitions()
    while parts > 1:
        # what partitions left open, as items of a coarser packing; the larger first, 16 partitions into one
        round_ += 1
        parts = -(-parts // 16)
        fills = left.join(F.broadcast(by_name), "spec_name").select("spec_name", F.col("container").alias("item"), (F.col("capacity") - F.col("room")).alias("size"))
        fills = fills.repartition(parts, "item").sortWithinPartitions(F.desc("size"), "item")
        merged = cut(_pack(fills, capacities, windows, round_))
        step = merged.where("item is not null").select(F.col("item").alias("container"), F.col("container").alias("into"))
        if moves is None:
            moves = step
        else:
            onward = step.select(F.col("container").alias("into"), F.col("into").alias("next"))
            moves = moves.join(onward, "into", "left").select("container", F.coalesce("next", "into").alias("into"))
        left = merged.where("room is not null").select("spec_name", "container", "room")
    out = placed.where("item is not null").drop("room")
    if moves is not None:
        out = out.join(moves, "container", "left").withColumn("container", F.coalesce("into", "container")).drop("into")
    out = out.join(F.broadcast(by_name), "spec_name")
    return out.select(
        "spec_name", F.col("item").cast(kind).alias(item), "piece", "size", "capacity", "container"
    )


def split_items(placed: DataFrame, item: str = "doc_id") -> DataFrame:
    """The items that don't fit into one container of a spec: those with a second piece."""
    return placed.where("piece = 1").select("spec_name", item).distinct()


def containers(placed: DataFrame) -> DataFrame:
    """What each container holds: spec_name, container, n_pieces, used, unused."""
    return (
        placed.groupBy("spec_name", "container", "capacity")
        .agg(F.count("*").alias("n_pieces"), F.sum("size").alias("used"))
        .select("spec_name", "container", "n_pieces", "used", (F.col("capacity") - F.col("used")).alias("unused"))
    )
