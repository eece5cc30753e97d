"""Problem 8: filling fixed-capacity containers with documents, measured in tokens of a public tokenizer.

A document longer than the capacity is cut into full pieces and a rest; no other is split. Dynamic programming over the
global histogram of piece lengths chooses bucket boundaries of the least padding. Buckets, not pieces, are then packed:
the largest first, into the open containers with the least room that still takes them, then into new ones. The plan is
a short list of rank ranges, so that every piece finds its container by its rank in its bucket.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm.splits import ranked_within
from trajlake.runtime import checkpoint, table

#: Buckets of lengths; the histogram itself never has more entries than the capacity.
MAX_BUCKETS = 256


def default_tokenizer() -> str:
    """Path of the installed byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_counts(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens) of the whole text of each document; null texts are left out, empty ones have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64())})

    return documents.where("text is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least padding.

    Exact: f(k, j) = b_j N_j - S_j + min over i of f(k-1, i) + S_i - b_j N_i, lines of falling slope, rising queries.
    """
    size = sorted(histogram)
    d = len(size)
    if d <= buckets:
        return size
    n, s = [0], [0]
    for x in size:
        n.append(n[-1] + histogram[x])
        s.append(s[-1] + histogram[x] * x)
    best = [0.0] + [float("inf")] * d
    back: list[list[int]] = []
    for _ in range(buckets):
        hull: list[tuple[int, float, int]] = []
        new, arg, at = [float("inf")] * (d + 1), [0] * (d + 1), 0
        for j in range(1, d + 1):
            i = j - 1
            if best[i] < float("inf"):
                m, c = -n[i], best[i] + s[i]
                while len(hull) >= 2 and (c - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, c, i))
            at = min(at, max(len(hull) - 1, 0))
            b = size[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * b + hull[at + 1][1] <= hull[at][0] * b + hull[at][1]:
                at += 1
            if hull:
                new[j], arg[j] = b * n[j] - s[j] + hull[at][0] * b + hull[at][1], hull[at][2]
        back.append(arg)
        best = new
    out, j = [], d
    for arg in reversed(back):
        if j <= 0:
            break
        out.append(size[j - 1])
        j = arg[j]
    return sorted(out)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Segments (bucket, from rank, to rank, first container, pieces a container) and the number of containers.

    Best fit, largest bucket first, over groups of containers with equal room.
    """
    segments: list[tuple[int, int, int, int, int]] = []
    rooms: list[tuple[int, int, int]] = []  # (room, first container, number), by room
    total = 0
    for b in sorted(counts, reverse=True):
        left, lo = counts[b], 0
        if b <= 0:  # nothing to lay: with the first container
            segments.append((b, 0, left, 0, max(left, 1)))
            total = max(total, 1)
            continue
        k = bisect_left(rooms, (b, -1, -1))
        while left:
            if k < len(rooms):
                room, first, number = rooms.pop(k)
            else:
                room, first, number = capacity, total, -(-left // (capacity // b))
                total += number
            each = room // b
            full = min(number, left // each)
            if full:
                segments.append((b, lo, lo + full * each, first, each))
                lo, left = lo + full * each, left - full * each
                if room - each * b > 0:
                    insort(rooms, (room - each * b, first, full))
            if full < number:
                if left:
                    segments.append((b, lo, lo + left, first + full, left))
                    if room - left * b > 0:
                        insort(rooms, (room - left * b, first + full, 1))
                    lo, left, full = lo + left, 0, full + 1
                if full < number:
                    insort(rooms, (room, first + full, number - full))
            k = bisect_left(rooms, (b, -1, -1))
    return segments, total


def plan_in_buckets(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """As :func:`plan`, with containers of one bucket each: batches of equal padded length."""
    segments, total = [], 0
    for b in sorted(counts, reverse=True):
        each = capacity // b if b > 0 else max(counts[b], 1)
        segments.append((b, 0, counts[b], total, each))
        total += -(-counts[b] // each)
    return segments, total


def pack(sizes: DataFrame, capacity: int, combine: bool = True) -> DataFrame:
    """(doc_id, part_no, n_tokens, container_no) of every piece of ``sizes`` (doc_id, n_tokens).

    Buckets share containers (``combine``), or each batch forms inside its bucket. No piece is split but those of documents beyond the capacity; a document of no tokens takes no room; repeated
    documents are laid one by one; an empty table gives an empty result.
    """
    spark = sizes.sparkSession
    c = F.lit(capacity).cast("long")
    parts = F.greatest(F.ceil(F.col("n_tokens") / c), F.lit(1)).cast("int")
    pieces = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part_no"))
    pieces = pieces.select("doc_id", "part_no", F.least(c, F.col("n_tokens") - F.col("part_no") * c).alias("n_tokens"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("n_tokens").agg(F.count("*")).collect()}  # at most capacity + 1 rows
    bounds = boundaries({k: v for k, v in histogram.items() if k > 0}, MAX_BUCKETS)
    counts: dict[int, int] = {}
    for k, v in histogram.items():
        b = bounds[bisect_left(bounds, k)] if k > 0 else 0
        counts[b] = counts.get(b, 0) + v
    segments, _ = (plan if combine else plan_in_buckets)(counts, capacity)
    where = spark.createDataFrame(segments, "bucket long, lo long, hi long, first long, each long")  # bounded by buckets and their splits
    by_size = spark.createDataFrame([(k, bounds[bisect_left(bounds, k)] if k > 0 else 0) for k in histogram], "n_tokens long, bucket long")
    keyed = pieces.join(F.broadcast(by_size), "n_tokens").withColumn("piece", F.struct("doc_id", "part_no"))
    ranked = ranked_within(keyed, ["bucket"], "piece")
    laid = ranked.join(F.broadcast(where), "bucket").where("rank >= lo and rank < hi")
    return laid.select("doc_id", "part_no", "n_tokens", (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).alias("container_no"))


def p8_containers(spark: SparkSession, sf_dir: str, tokenizer: str | None = None, combine: bool = True) -> DataFrame:
    """(container_name, doc_id, part_no, n_tokens, container_no) for every capacity and every document with a text."""
    sizes = checkpoint(token_counts(table(spark, sf_dir, "documents"), tokenizer or default_tokenizer()))
    out = None
    for name, capacity in table(spark, sf_dir, "container_sizes").where("capacity_tokens > 0").orderBy("container_name").select("container_name", "capacity_tokens").collect():  # fixed small table
        one = pack(sizes, capacity, combine).select(F.lit(name).alias("container_name"), "doc_id", "part_no", "n_tokens", "container_no")
        out = one if out is None else out.unionByName(one)
    return out


def p8_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``p8_fill``, of batches that form inside one bucket each."""
    return p8_fill(spark, sf_dir, combine=False)


def p8_fill(spark: SparkSession, sf_dir: str, combine: bool = True) -> DataFrame:
    """(container_name, containers, tokens, fill): how full the containers of each capacity are."""
    laid = p8_containers(spark, sf_dir, combine=combine).groupBy("container_name").agg(F.countDistinct("container_no").alias("containers"), F.sum("n_tokens").alias("tokens"))
    sizes = table(spark, sf_dir, "container_sizes")
    return laid.join(sizes, "container_name").select("container_name", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
