"""Problem 10: the subjects of each document, by propagating hand labels over a verified sentence similarity graph.

Nodes are the sentences of all documents. A star graph links them: every pair of neighbouring content words has a hub,
the shortest sentence that holds it, and a sentence is a candidate for the hubs of its pairs. An edge stands only if it
is verified: the words that sentence and hub share must carry at least ``SIMILAR`` of the weight of the lighter of the
two. So a group of similar sentences costs one edge each, and no group is ever multiplied out into pairs.

Labels start at the sentences of labelled documents and go along edges to hubs and from hubs to all sentences, in
DataFrame joins. A label is trusted only if the graph does not contradict it. Hubs with few labelled neighbours take
the subjects of their other neighbours, round by round, until a round changes no hub or ``ROUNDS`` are done; a document
with a trusted label keeps it. Any other document gets every subject that at least a quarter of its sentences are about.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.runtime import table, written

#: Least share of a document's sentences, words of a sentence, and the share of all sentences from which a word is a stop word; copies count once.
SHARE, MIN_WORDS, STOP_SHARE = 0.25, 3, 0.03
#: Least shared weight of sentence and hub, as a share of the lighter.
SIMILAR = 0.3
#: Document frequencies are counted under this many bits of a word's hash, so their table has one size whatever the corpus.
FREQUENCY_BITS = 20
#: Weight of the corpus-wide make-up in a hub's, a hub's votes below which it also listens to unlabelled neighbours, and rounds.
PRIOR, FEW, ROUNDS = 1.0, 3.0, 6
#: A subject counts at a hub as far as its share is more than LIFT times that of the corpus; a sentence needs EVIDENCE of it.
LIFT, EVIDENCE = 2.0, 0.15


def sentences_of(documents: DataFrame) -> DataFrame:
    """(sid, doc_id, words): one row per sentence, words as hashes; headings, link lines and scraps of fewer than three words left out.

    Repeated sentences of a document count each; the whole text counts; rows of one doc_id are one document.
    """
    body = F.regexp_replace(F.regexp_replace("text", r"\\n", "\n"), r"(?m)^#+ .*$", "\n")
    parts = F.split(F.lower(body), r"(?<=[.!?;])[\"”»]?\s+|\n+|\"")
    words = F.filter(F.split("s", r"[^\p{L}]+"), lambda w: w != "")
    s = documents.where("text is not null").select("doc_id", F.explode(parts).alias("s")).select("doc_id", words.alias("w")).where(F.size("w") >= MIN_WORDS)
    return s.select(F.monotonically_increasing_id().alias("sid"), "doc_id", F.transform("w", lambda w: F.xxhash64(w)).alias("words"))


def word_weights(said: DataFrame) -> np.ndarray:
    """Weight of every hash bucket of words, in quarters: the log of all different sentences over those with the word; 0 for stop words."""
    first = written(said.groupBy(F.xxhash64("words").alias("code")).agg(F.min("sid").alias("sid")))  # a text that is a third of the corpus must not make its words stop words
    n, size = max(first.count(), 20), 1 << FREQUENCY_BITS
    at = F.col("w").bitwiseAND(size - 1)
    counts = said.select("sid", "words").join(first.select("sid"), "sid", "left_semi").select(F.explode(F.array_distinct("words")).alias("w")).groupBy(at.alias("b")).agg(F.count("*").alias("n")).toPandas()  # 2 ** FREQUENCY_BITS rows at most
    out = np.zeros(size, np.uint8)
    seen = counts.n.to_numpy(float)
    out[counts.b.to_numpy(np.int64)] = np.where(seen <= STOP_SHARE * n, np.clip(np.log(n / seen) * 4, 1, 63), 0)
    return out


def content_of(said: DataFrame) -> DataFrame:
    """``said`` as (sid, doc_id, skey, weight, terms, pairs): words without stop words, each with its weight in the low six
    bits, and neighbouring ones as pairs. ``skey`` orders sentences by length and names their content.
    """
    weights = said.sparkSession.sparkContext.broadcast(word_weights(said))  # 2 ** FREQUENCY_BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(2)
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            with np.errstate(over="ignore"):
                mass = w[flat & ((1 << FREQUENCY_BITS) - 1)]
                keep = mass > 0
                full, owner = flat[keep], owner[keep]
                term = ((full >> 32) & ~np.int64(63)) | mass[keep]
                same = owner[1:] == owner[:-1]
                pair = (full[:-1] * np.int64(-7046029254386353131) + full[1:])[same]
                n = np.bincount(owner, minlength=b.num_rows)
                code = np.zeros(b.num_rows, np.int64)
                np.add.at(code, owner, full * np.int64(-4417276706812531889))
                skey = (np.minimum(n, 32000).astype(np.int64) << 48) | ((code >> 16) & ((1 << 48) - 1))
            total = np.bincount(owner, term & 63, minlength=b.num_rows).astype(np.float32)

            def column(values: np.ndarray, at: np.ndarray, rows: int = b.num_rows) -> pa.Array:
                ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=rows))]).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))

            yield pa.record_batch({"sid": b.column(0), "doc_id": b.column(1), "skey": pa.array(skey), "weight": pa.array(total), "terms": column(term.astype(np.int32), owner), "pairs": column(pair, owner[1:][same])})

    kind = dict(said.dtypes)["doc_id"]
    return said.mapInArrow(run, f"sid long, doc_id {kind}, skey long, weight float, terms array<int>, pairs array<long>")


def edges_of(said: DataFrame) -> DataFrame:
    """(sid, doc_id, hid, sim): the verified edges between sentences and hubs; a hub found through several pairs counts by each."""
    content = written(content_of(said))
    pick = content.select("skey", F.explode(F.array_distinct("pairs")).alias("pair")).groupBy("pair").agg(F.min("skey").alias("hid"), F.count("*").alias("n")).where("n > 1").select("pair", "hid")
    pick = written(pick)
    hubs = content.select("skey", "weight", "terms").join(pick.select(F.col("hid").alias("skey")).distinct(), "skey", "left_semi")
    hubs = hubs.dropDuplicates(["skey"]).select(F.col("skey").alias("hid"), F.col("weight").alias("hub_weight"), F.col("terms").alias("hub_terms"))
    near = content.select("sid", "doc_id", "weight", "terms", F.explode(F.array_distinct("pairs")).alias("pair")).join(pick, "pair").select("sid", "doc_id", "weight", "terms", "hid")
    shared = F.aggregate(F.array_intersect("terms", "hub_terms"), F.lit(0), lambda a, t: a + t.bitwiseAND(63))
    sim = (shared / F.least("weight", "hub_weight")).cast("float")
    return written(near.join(hubs, "hid").select("sid", "doc_id", "hid", F.least(sim, F.lit(1.0)).alias("sim")).where(F.col("sim") >= SIMILAR))


class Graph:
    """Propagation over the edges of :func:`edges_of` for subjects 0 … k-1."""

    def __init__(self, edges: DataFrame, k: int) -> None:
        self.edges, self.k = edges, range(k)

    def cols(self, name: str) -> list[str]:
        return [f"{name}{i}" for i in self.k]

    def total(self, name: str) -> Column:
        return reduce(lambda a, b: a + b, map(F.col, self.cols(name)), F.lit(0.0))

    def votes(self, voters: DataFrame, on: str, edges: DataFrame) -> DataFrame:
        """(hid, s0, …, n): what the neighbours in ``voters`` (``on``, p0, …) say; one that has no subject counts in n alone."""
        said = edges.join(voters, on)
        return said.groupBy("hid").agg(*[F.sum(F.col("sim") * F.col(f"p{i}")).alias(f"s{i}") for i in self.k], F.sum("sim").alias("n"))

    def sentences(self, edges: DataFrame, hubs: DataFrame, base: list[float]) -> DataFrame:
        """(doc_id, sid, p0, …): the subject of each sentence that has one, as shares."""
        excess = lambda i: F.greatest((F.col(f"s{i}") + PRIOR * base[i]) / (F.col("n") + PRIOR) - LIFT * base[i], F.lit(0.0))
        strong = hubs.select("hid", *[excess(i).alias(f"e{i}") for i in self.k]).where(self.total("e") > 0.02)
        v = edges.join(strong, "hid").groupBy("doc_id", "sid").agg(*[F.sum(F.col("sim") * F.col(f"e{i}") * F.col(f"e{i}")).alias(f"v{i}") for i in self.k])
        best = F.greatest(*map(F.col, self.cols("v")), F.lit(0.0))
        return v.where((best >= EVIDENCE) & (best > 0.5 * self.total("v"))).select("doc_id", "sid", *[(F.col(f"v{i}") / self.total("v")).alias(f"p{i}") for i in self.k])

    def shares(self, sentences: DataFrame, said: DataFrame) -> DataFrame:
        """(doc_id, h0, …): the share of each document's sentences that each subject has."""
        hits = sentences.groupBy("doc_id").agg(*[F.sum((F.col(f"p{i}") > 0.5).cast("double")).alias(f"h{i}") for i in self.k])
        n = said.groupBy("doc_id").agg(F.count("*").alias("n"))
        return n.join(hits, "doc_id", "left").select("doc_id", *[(F.coalesce(f"h{i}", F.lit(0.0)) / F.col("n")).alias(f"h{i}") for i in self.k])

    def base(self, votes: DataFrame) -> list[float]:
        r = votes.agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in self.k], F.sum("n").alias("n")).first()
        return [max((r[f"s{i}"] or 0.0) / max(r["n"] or 0.0, 1.0), 1e-3) for i in self.k]


def propagate(documents: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, h0, h1, …): share of each document's sentences about each subject; 1 or 0 where a trusted label settles it."""
    said = written(sentences_of(documents))
    g = Graph(edges_of(said), len(names))
    k = g.k
    lab = labels.where("doc_id is not null and subject is not null").select("doc_id", "subject").distinct()
    seeds = lab.groupBy("doc_id").agg(*[F.max((F.col("subject") == n).cast("double")).alias(f"a{i}") for i, n in zip(k, names)])
    seeds = written(seeds)
    even = lambda s: s.select("doc_id", *[(F.col(f"a{i}") / F.greatest(g.total("a"), F.lit(1.0))).alias(f"p{i}") for i in k])
    # which labels to trust: the graph, asked without holding any sentence to its document's label, must not contradict
    votes = written(g.votes(even(seeds), "doc_id", g.edges))
    found = g.shares(g.sentences(g.edges.join(seeds.select("doc_id"), "doc_id", "left_semi"), votes, g.base(votes)), said.join(seeds.select("doc_id"), "doc_id", "left_semi"))
    against = [F.when(F.col(f"a{i}") > 0, F.col(f"h{i}") < SHARE / 2).otherwise(F.col(f"h{i}") >= SHARE) for i in k]
    trusted = written(seeds.join(found, "doc_id").where(~reduce(lambda a, b: a | b, against)).select("doc_id", *g.cols("a")))
    hubs = written(g.votes(even(trusted), "doc_id", g.edges))
    base, few = g.base(hubs), F.col("n") < FEW
    # hubs of few labelled neighbours, and those of none, listen to the rest
    firm = hubs.where(~few)
    weak = written(g.edges.join(firm.select("hid"), "hid", "left_anti"))
    around = written(g.edges.join(weak.select("sid").distinct(), "sid", "left_semi"))
    seeded, heard = hubs.where(few), -1.0
    for _ in range(ROUNDS):
        p = g.sentences(around, hubs, base).join(trusted.select("doc_id"), "doc_id", "left_anti").drop("doc_id")
        new = g.votes(p, "sid", weak)
        sums = seeded.unionByName(new).groupBy("hid").agg(*[F.sum(c).alias(c) for c in (*g.cols("s"), "n")])
        hubs = written(firm.unionByName(sums))
        now = hubs.agg(F.sum(F.round("n", 3)).alias("n")).first()["n"] or 0.0
        if abs(now - heard) <= 1e-3 * max(now, 1.0):
            break
        heard = now
    shares = g.shares(g.sentences(g.edges, hubs, base), said)
    held = shares.join(trusted, "doc_id", "left")
    settle = lambda i: F.when(F.col(f"a{i}").isNull(), F.col(f"h{i}")).when(F.col(f"a{i}") > 0, F.greatest(f"h{i}", F.lit(SHARE))).otherwise(F.least(f"h{i}", F.lit(SHARE / 2)))
    return held.select("doc_id", *[settle(i).alias(f"h{i}") for i in k])


def document_subjects(documents: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, subject, share) of every subject a document is about; null and empty texts have none.

    Without labels there are no subjects. Copies of a text are nodes of their own; only a trusted label tells them apart.
    """
    shares = propagate(documents.select("doc_id", "text"), labels, names)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("subject"), F.col(f"h{i}").alias("share")) for i, n in enumerate(names)])).alias("x")
    return shares.select("doc_id", each).select("doc_id", "x.subject", "x.share").where(F.col("share") >= SHARE)


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    names = [r[0] for r in table(spark, sf_dir, "subjects").orderBy("subject_id").select("subject").collect()]  # fixed small table
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), names


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, subject) of every subject of every document."""
    return document_subjects(*_inputs(spark, sf_dir)).select("doc_id", "subject").distinct()


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, n_docs, mean_share): the make-up of the corpus by subject."""
    return document_subjects(*_inputs(spark, sf_dir)).groupBy("subject").agg(F.count("*").alias("n_docs"), F.avg("share").alias("mean_share"))
