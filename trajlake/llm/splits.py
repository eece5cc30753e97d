"""Problem 7: splits that keep related records together.

Registered names become graph nodes, a row with two different names an edge. Connected components are found by
alternating large-star and small-star joins (each node keeps one edge per neighbour, so a hub never gathers in one
task), and components are bundled by (size, label profile). The bundles, not the components, go into a min-cost flow.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.runtime import checkpoint, table





def host_of(value: Column) -> Column:
    """Host of a website or domain: without scheme, user, port, path, case, outer spaces and final dot."""
    x = F.lower(F.regexp_replace(value, r"^[\s\p{Z}\p{Cc}]+|[\s\p{Z}\p{Cc}]+$", ""))
    x = F.regexp_replace(x, r"^[a-z][a-z0-9+.\-]*://|^//", "")
    x = F.regexp_replace(x, r"[/?#\\].*$", "")
    x = F.regexp_replace(x, r"^.*@", "")
    x = F.regexp_replace(x, r":\d*$", "")
    return F.regexp_replace(x, r"[.\s]+$", "")


def registered_name(host: Column, suffixes: list[str]) -> Column:
    """Longest suffix of the list and one more label; null where the host has no such form."""
    if not suffixes:
        return F.lit(None).cast("string")
    # the leftmost match has the longest suffix; a suffix itself names no owner
    tails = "|".join(s.replace(".", r"\.") for s in sorted(suffixes, key=lambda s: (-len(s), s)))
    name = F.regexp_extract(host, rf"^(?:[^\s]*?\.)??([^.\s/@:]+\.(?:{tails}))$", 1)
    return F.when(~host.isin(*suffixes), F.nullif(name, F.lit("")))


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root) for edges (a, b): the root is the smallest node that can be reached.

    Large-star and small-star in turns until the edge set no longer changes; lineage is cut every round.
    Each step is a minimum, partly taken before its shuffle, and an equi-join with one row per node: the edges of a hub meet
    one row, so that adaptive execution may split them over tasks.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))

    def large_star(e: DataFrame) -> DataFrame:
        nb = both(e)
        least = nb.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return nb.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(least, "u").where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return linked.union(least.select(F.col("u"), F.col("m")))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        e = checkpoint(small_star(large_star(e).distinct()).distinct())
        after = mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task with its group_key; null where neither website nor domain has a registered name.

    Nulls, blanks and junk in website or domain link nothing; repeated rows stay, each under its own task_id.
    """
    suffixes = [r[0] for r in table(spark, sf_dir, "host_suffixes").select("suffix").where("suffix is not null").collect()]  # fixed small table
    t = table(spark, sf_dir, "tasks").select(
        "task_id", host_of(F.col("website")).alias("w"), host_of(F.col("domain")).alias("d")
    )
    t = t.select("task_id", registered_name(F.col("w"), suffixes).alias("w"), registered_name(F.col("d"), suffixes).alias("d"))
    root = components(t.where("w <> d").select(F.col("w").alias("a"), F.col("d").alias("b")).distinct())
    named = t.withColumn("name", F.coalesce("w", "d"))
    return named.join(root, F.col("name") == F.col("node"), "left").select("task_id", F.coalesce("root", "name").alias("group_key"))


Arcs = list[tuple[int, int]]


def min_cost_flow(supply: list[int], cost: list[list[int | Arcs]], room: list[int | Arcs]) -> list[list[int]]:
    """Integral flow of ``supply`` units to sinks with ``room`` at the least cost (successive shortest paths with potentials).

    A cost may be a list of (capacity, cost of a unit) of rising cost, as may a room: deviations that cost more the larger they are.
    """
    n, m = len(supply), len(room)
    size, graph = n + m + 2, [[] for _ in range(n + m + 2)]

    def add(u: int, v: int, cap: int, w: int) -> None:
        graph[u].append([v, cap, w, len(graph[v])])
        graph[v].append([u, 0, -w, len(graph[u]) - 1])

    for i, s in enumerate(supply):
        add(0, 1 + i, s, 0)
        for j in range(m):
            for cap, w in cost[i][j] if isinstance(cost[i][j], list) else [(s, cost[i][j])]:
                add(1 + i, 1 + n + j, cap, w)
    for j in range(m):
        for cap, w in room[j] if isinstance(room[j], list) else [(room[j], 0)]:
            add(1 + n + j, size - 1, cap, w)
    pot = [0] * size
    while True:
        dist, back = [float("inf")] * size, [None] * size
        dist[0], heap = 0, [(0, 0)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for k, (v, cap, w, _) in enumerate(graph[u]):
                if cap > 0 and (nd := d + w + pot[u] - pot[v]) < dist[v]:
                    dist[v], back[v] = nd, (u, k)
                    heapq.heappush(heap, (nd, v))
        if back[-1] is None:
            break
        pot = [p + (d if d < float("inf") else 0) for p, d in zip(pot, dist)]
        push, v = 1 << 62, size - 1
        while v:
            u, k = back[v]
            push, v = min(push, graph[u][k][1]), u
        v = size - 1
        while v:
            u, k = back[v]
            graph[u][k][1] -= push
            graph[v][graph[u][k][3]][1] += push
            v = u
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for v, _, _, r in graph[1 + i]:
            if v > n:
                flow[i][v - 1 - n] += graph[v][r][1]
    return flow


def deviation(target: float, most: int, weight: int) -> Arcs:
    """Arcs whose cost is the square of the deviation from ``target``: exact near it, in steps that double further off."""
    steps, step = {0, most}, 1
    while step < 2 * most + 2:
        steps |= {x for x in (int(target) - step + 1, int(target) + step) if 0 < x < most}
        step *= 2
    at = sorted(steps)
    shift = 16 * weight * (2 * most + 2)  # every unit takes one such arc: a constant changes nothing, and costs stay positive
    return [(b - a, shift + round(16 * weight * (a + b - 2 * target))) for a, b in zip(at, at[1:])]


def allocate(bundles: list[tuple[int, str, int]], shares: list[tuple[str, float]]) -> dict[tuple[int, str], list[tuple[str, int]]]:
    """How many components of each bundle (size, profile, count) go to each split.

    Sizes are placed in descending order, so that small components even out what large ones cannot. Each size is one
    flow of all its bundles to all splits: the further a split is from its share of the rows still to place, and a
    profile from its share in the split, the more the next component costs there. Flows of whole components are integral.
    """
    norm = sum(x for _, x in shares) or 1.0
    names, share = [n for n, _ in shares], [x / norm for _, x in shares]
    total, of_profile = 0, {}
    for s, p, c in bundles:
        total += s * c
        of_profile[p] = of_profile.get(p, 0) + s * c
    left = [total * x for x in share]
    owed = {p: [n * x for x in share] for p, n in of_profile.items()}
    out: dict[tuple[int, str], list[tuple[str, int]]] = {}
    by_size: dict[int, list[tuple[str, int]]] = {}
    for s, p, c in bundles:
        by_size.setdefault(s, []).append((p, c))

    def wanted(rows: list[float], count: int) -> list[float]:
        pool = sum(max(0.0, v) for v in rows)
        return [count * max(0.0, v) / pool for v in rows] if pool else [count * x for x in share]

    for s in sorted(by_size, reverse=True):
        rows, count = by_size[s], sum(c for _, c in by_size[s])
        cost = [[deviation(t, c, 1) for t in wanted(owed[p], c)] for p, c in rows]
        flow = min_cost_flow([c for _, c in rows], cost, [deviation(t, count, 4) for t in wanted(left, count)])
        for (p, _), f in zip(rows, flow):
            out[(s, p)] = [(n, k) for n, k in zip(names, f) if k]
            for j, k in enumerate(f):
                left[j] -= s * k
                owed[p][j] -= s * k
    return out


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, group_key) of each task in a group of two or more tasks."""
    g = grouped_tasks(spark, sf_dir).where("group_key is not null")
    many = g.groupBy("group_key").agg(F.count("*").alias("n")).where("n > 1").select("group_key")
    return g.join(many, "group_key", "left_semi").select("task_id", "group_key").distinct()


def p7_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, group_key, split_name) of every task; a task without a registered name is a group of its own.

    Empty tables give an empty result. Ties between components of a bundle are broken by hash of the key, then the key.
    """
    shares = [(r[0], float(r[1])) for r in table(spark, sf_dir, "split_shares").where("share > 0").orderBy("split_name").collect()]  # fixed small table
    g = grouped_tasks(spark, sf_dir).withColumn("unit", F.coalesce("group_key", F.concat(F.lit("task:"), F.col("task_id").cast("string"))))
    profile = F.regexp_extract("unit", r"([^.]+)$", 1)
    units = checkpoint(
        g.groupBy("unit").agg(F.count("*").alias("size")).withColumn("profile", F.when(F.col("unit").startswith("task:"), F.lit("")).otherwise(profile))
    )
    # bundles: one row per (size, profile); k different sizes need k²/2 rows, profiles are top-level labels
    bundles = [(r["size"], r["profile"], r["n"]) for r in units.groupBy("size", "profile").agg(F.count("*").alias("n")).collect()]
    cuts, rows = allocate(bundles, shares), []
    for (size, prof), parts in cuts.items():
        lo = 0
        for name, k in parts:
            rows.append((size, prof, lo, lo + k, name))
            lo += k
    plan = spark.createDataFrame(rows, "size long, profile string, lo long, hi long, split_name string")
    ranked = ranked_within(units, ["size", "profile"], "unit")
    placed = ranked.join(
        F.broadcast(plan), ["size", "profile"]
    ).where("rank >= lo and rank < hi").select("unit", "split_name")
    return g.join(placed, "unit").select("task_id", "group_key", "split_name")


def ranked_within(df: DataFrame, keys: list[str], by: str, shards: int = 64) -> DataFrame:
    """``df`` with a dense 0-based ``rank`` per keys, in hash order of ``by``.

    A key is ranked in hash ranges and the ranges are offset by their counts, so that a hot key is never one task.
    """
    from pyspark.sql import Window

    h = df.withColumn("_h", F.xxhash64(by)).withColumn("_s", F.shiftrightunsigned("_h", 58) if shards == 64 else F.pmod("_h", F.lit(shards)))
    n = h.groupBy(*keys, "_s").agg(F.count("*").alias("_n"))
    off = n.withColumn("_o", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_s")) - F.col("_n")).drop("_n")
    local = F.row_number().over(Window.partitionBy(*keys, "_s").orderBy("_h", by)) - 1
    return h.withColumn("_r", local).join(off, [*keys, "_s"]).withColumn("rank", F.col("_r") + F.col("_o")).drop("_h", "_s", "_r", "_o")
