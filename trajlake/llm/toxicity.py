"""Problem 6: abusive, hateful or sexual content, by non-negative positive-unlabelled learning.

A record is a bag of sentences and is as toxic as its worst one. Confirmed toxic records name bags, not sentences, so
training alternates: the worst sentence of each confirmed bag is its witness, the witnesses are the positive sample,
and a linear model is fitted in numpy to the class-prior-corrected, non-negative risk against unlabelled sentences.
``FOLDS`` models, each without one fold of the labels, tell the scores of unseen toxic records; they and the model of all
labels are fitted in a task each. Scoring is one Arrow pass over all records and all their sentences, and the threshold
is counted over all scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajlake.runtime import table, written

#: Bounds of the fitting sample: labelled records, and records taken as unlabelled text by each source's share of all, both
#: in hash order of their id. The threshold is not taken from a sample.
MAX_LABELLED, MAX_UNLABELLED = 6000, 3000
#: Bound of the model: features kept, by weight.
MAX_FEATURES = 60_000
#: Share of toxic sentences in unlabelled text that the first round starts from, and the bounds of its estimate.
PRIOR, LEAST_PRIOR, MOST_PRIOR = 0.004, 0.0005, 0.03
#: Parts of the labels; each is held out of one model.
FOLDS = 4
#: Least recall at which the share of toxic records is estimated.
ENOUGH = 0.3

SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n+|\s\|\s")
NODE = re.compile(r"\[id: ?\d+\]")
ROLES = {"link", "button", "dropdown"}
TOKEN = re.compile(r"[^\W\d_]+(?:[*#@$]+[^\W\d_]*)+|[^\W\d_]+")
SPACED = re.compile(r"(?<![^\W_])[^\W\d_]([ ._\-])[^\W\d_](?:\1[^\W\d_])+(?![^\W_])")
REPEATED = re.compile(r"([^\W\d_])\1{2,}")
LEET = re.compile(r"(?<![^\W_])(?=\S*[^\W\d_])(?=\S*[0134578$@])[^\W_$@]*[0134578$@][\w$@]*")
LEET_MAP = str.maketrans("0134578$@", "oieastbsa")
LOOK = str.maketrans("аеорсухіј", "aeopcyxij")
MASK = "‹masked›"


def tokens(sentence: str) -> list[str]:
    """Lower-case words with disguises undone: spaced or dotted letters joined, repeated letters collapsed, signs for
    letters read as letters; a word with letters blotted out becomes one mark."""
    s = sentence.lower()
    if not s.isascii():
        s = s.translate(LOOK).replace("​", "").replace("\xad", "")
    if SPACED.search(s):
        s = SPACED.sub(lambda m: re.sub(r"[ ._\-]", "", m[0]), s)
    if REPEATED.search(s):
        s = REPEATED.sub(r"\1", s)
    if LEET.search(s):
        s = LEET.sub(lambda m: m[0].translate(LEET_MAP) if sum(c.isalpha() for c in m[0]) >= 2 else m[0], s)
    return [MASK if "*" in w or "#" in w else w for w in TOKEN.findall(s)]


def features(words: list[str]) -> list[str]:
    return words + [a + " " + b for a, b in zip(words, words[1:])]


def sentences(text: str) -> list[str]:
    """Every sentence of the text; a line of nodes falls into their labels, of any length, without number and role."""
    out = []
    for line in text.split("\n"):
        if not line.lstrip().startswith("[id:"):
            out.extend(SENTENCE.split(line))
            continue
        for label in map(str.strip, NODE.split(line)):
            title, _, last = label.rpartition(" ")
            out.extend(SENTENCE.split(title if title and last in ROLES else label))
    return [p for p in out if p]


def matrix(bags: list[list[str]], vocab: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids, the start of each sentence, and the bag of each sentence; one constant feature keeps none empty."""
    ids, starts, owner = [], [], []
    for b, parts in enumerate(bags):
        for p in parts:
            starts.append(len(ids))
            owner.append(b)
            ids.append(0)
            ids.extend({vocab[f] for f in features(tokens(p)) if f in vocab})
    return np.array(ids, np.int32), np.array(starts, np.int64), np.array(owner, np.int32)


def descend(p: tuple[np.ndarray, np.ndarray], u: tuple[np.ndarray, np.ndarray], share: np.ndarray, size: int, steps: int, prior: float) -> np.ndarray:
    """Weights of the least non-negative positive-unlabelled risk under logistic loss (Adam, full batches).

    ``share``: of all unlabelled sentences, that of each distinct one.
    """
    (qi, qs), (ui, us) = p, u
    qn, un = np.diff(np.append(qs, len(qi))), np.diff(np.append(us, len(ui)))
    w, m, v = np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        zp, zu = np.clip(np.add.reduceat(w[qi], qs), -30, 30), np.clip(np.add.reduceat(w[ui], us), -30, 30)
        sp, sn = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        g = 0.5 * np.bincount(qi, np.repeat(-(1 - sp) / len(qs), qn), size)
        if share @ np.logaddexp(0, zu) - prior * np.mean(np.logaddexp(0, zp)) >= 0:
            # the unlabelled risk less the positives' share in it, as long as that is a risk
            g += 0.5 / (1 - prior) * (np.bincount(ui, np.repeat(sn * share, un), size) - prior * np.bincount(qi, np.repeat(sp / len(qs), qn), size))
        g += 2e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
    return w


def rows_of(ids: np.ndarray, starts: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sentences of a matrix under ``mask``."""
    n = np.diff(np.append(starts, len(ids)))
    return ids[np.repeat(mask, n)], np.concatenate([[0], np.cumsum(n[mask])[:-1]]).astype(np.int64)


def fit(toxic: list[str], unlabelled: list[str], rounds: int = 2, steps: int = 30, prior: float = PRIOR) -> dict[str, float]:
    """Weights by feature of the sentence score; the constant is under the empty string.

    Witnesses of one half of the bags are chosen by the model of the other half, so that no sentence is a witness only
    because it was one before; a bag whose best sentence is not beyond nearly all unlabelled ones has no witness.
    """
    pos, unl = [sentences(t) for t in toxic], [sentences(t) for t in unlabelled]
    in_pos, in_unl = Counter(), Counter()
    for bags, count in ((pos, in_pos), (unl, in_unl)):
        for parts in bags:
            count.update({f for p in parts for f in features(tokens(p))})
    chosen = [f for f, n in in_pos.items() if n + in_unl[f] > 1] + [f for f, n in in_unl.items() if n > 3 and f not in in_pos]
    chosen = sorted(chosen, key=lambda f: (-in_pos[f], -in_unl[f], f))[:MAX_FEATURES]
    vocab = {f: i + 1 for i, f in enumerate(chosen)}
    pi, ps, po = matrix(pos, vocab)
    times = Counter(p for parts in unl for p in parts)
    share = np.array(list(times.values()), float) / max(1, sum(times.values()))
    ui, us, _ = matrix([list(times)], vocab)
    if not len(ps) or not len(us):
        return {"": -1.0}
    # first witnesses: the features of a sentence that its class has most beyond the unlabelled bags
    z = np.zeros(len(vocab) + 1)
    for f, i in vocab.items():
        e = in_unl[f] * len(pos) / max(len(unl), 1)
        z[i] = max(0.0, (in_pos[f] - e) / (e + 1.0) ** 0.5)

    def best(score: np.ndarray) -> np.ndarray:
        order = np.lexsort((-score, po))
        return order[np.unique(po[order], return_index=True)[1]]

    def beyond(score: np.ndarray) -> float:
        """The unlabelled sentence that all but a share of 5 priors score below."""
        order = np.argsort(score)
        return float(score[order][min(np.searchsorted(np.cumsum(share[order]), 1 - 5 * prior), len(order) - 1)])

    def strongest(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.array([np.sort(x)[-4:].sum() for x in np.split(z[ids], starts[1:])])

    sp, su = strongest(pi, ps), strongest(ui, us)
    wit = best(sp)
    wit = wit[sp[wit] > beyond(su)]
    fold = po % 2
    for _ in range(rounds):
        score, far, above = np.zeros(len(ps)), np.zeros(2), []
        for h in (0, 1):
            mask = np.zeros(len(ps), bool)
            mask[wit[fold[wit] != h]] = True
            if not mask.any():
                mask[wit] = True
            if not mask.any():
                return {"": -1.0}
            w = descend(rows_of(pi, ps, mask), (ui, us), share, len(vocab) + 1, steps, prior)
            score[fold == h] = np.add.reduceat(w[pi], ps)[fold == h]
            su = np.add.reduceat(w[ui], us)
            unseen = score[wit[fold[wit] == h]]
            if len(unseen):  # half of the unseen witnesses score above their median: so do half of the toxic sentences
                above.append(2 * float(share[su >= np.median(unseen)].sum()))
            far[h] = beyond(su)
        if above:
            prior = min(max(sum(above) / len(above), LEAST_PRIOR), MOST_PRIOR)
        new = best(score)
        new = new[score[new] > far[fold[new]]]
        wit = new if len(new) else wit
    mask = np.zeros(len(ps), bool)
    mask[wit] = True
    w = descend(rows_of(pi, ps, mask), (ui, us), share, len(vocab) + 1, 2 * steps, prior)
    out = {f: round(float(w[i]), 4) for f, i in vocab.items() if abs(w[i]) > 0.02}
    out[""] = float(w[0])
    return out


def score_text(text: str, model: dict[str, float], cache: dict[str, float]) -> float:
    """Highest sentence score of the text; the constant alone where it has no sentence."""
    best, base, get = -1e9, model[""], model.get
    for p in sentences(text):
        z = cache.get(p)
        if z is None:
            ws = tokens(p)
            z, prev = base, None
            for x in dict.fromkeys(ws):
                z += get(x, 0.0)
            for x in {a + " " + b for a, b in zip(ws, ws[1:])}:
                z += get(x, 0.0)
            if len(cache) > 100_000:
                cache.clear()
            cache[p] = z
        if z > best:
            best = z
    return best if best > -1e9 else base


def best_threshold(confirmed: list[float], loose: list[float], base: float = -np.inf) -> float:
    """Threshold of the highest F measure, as far as positive and unlabelled records tell it.

    ``confirmed``: held-out scores of confirmed toxic records, ``loose``: scores of unlabelled ones, ``base``: the score
    of a text without any evidence, which is never flagged. The recall at a threshold is that of the confirmed records.
    The share of toxic records is the least quotient of flagged share and recall where the recall is ``ENOUGH``, and
    the precision is that share times the recall over the flagged share.
    """
    pos = np.sort(np.asarray(confirmed, float))
    return counted_threshold(pos, tally(pos, np.asarray(loose, float)), base)


def tally(pos: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(bin, n, top): the scores between neighbours of ``pos``, sorted, by number and highest; the bin counts the ``pos`` not above."""
    at = np.searchsorted(pos, scores, "right")
    n, top = np.bincount(at, minlength=len(pos) + 1), np.full(len(pos) + 1, -np.inf)
    np.maximum.at(top, at, scores)
    return [(int(i), int(n[i]), float(top[i])) for i in np.flatnonzero(n)]


def counted_threshold(pos: np.ndarray, bins: list[tuple[int, int, float]], base: float = -np.inf) -> float:
    """``best_threshold`` from the tally of the unlabelled scores; exact, as only scores in ``pos`` are candidates."""
    n, tops = np.zeros(len(pos) + 1), np.full(len(pos) + 1, -np.inf)
    for i, k, t in bins:
        n[i] += k
        tops[i] = max(tops[i], t)
    above = n[::-1].cumsum()[::-1]
    can = np.flatnonzero(pos > base)
    if not len(can):
        return max([base, *map(float, tops)])  # no confirmed record shows evidence to a model that has not seen it
    recall, flagged = (len(pos) - can) / len(pos), (above[can + 1] + 1) / (above[0] + 1)
    enough = recall >= min(ENOUGH, recall.max())
    share = (flagged[enough] / recall[enough]).min()
    precision = np.minimum(1.0, share * recall / flagged)
    value = 2 * precision * recall / (precision + recall)
    cut = float(pos[can[np.flatnonzero(value >= value.max() - 1e-12)[-1]]])
    first = int(np.searchsorted(pos, cut, "left"))
    below = max([float(x) for x in pos[:first]] + [float(x) for x in tops[: first + 1]], default=-np.inf)
    below = max(below, base)
    return (cut + below) / 2 if below > -np.inf else cut - 1e-6


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_id, origin, text) of observations and proposals with a text; origin: identifier or source."""
    o = table(spark, sf_dir, "observations").selectExpr("'observation' AS src", "obs_id AS row_id", "identifier AS origin", "processed_text AS text")
    p = table(spark, sf_dir, "proposals").selectExpr("'proposal' AS src", "proposal_id AS row_id", "source AS origin", "proposed_task AS text")
    return o.unionByName(p).where("text is not null")


def unlabelled_sample(recs: DataFrame) -> DataFrame:
    """(src, row_id) of at most ``MAX_UNLABELLED`` records: of each source its share of all, first by hash of the id."""
    counts = {r.src: r.n for r in recs.groupBy("src").agg(F.count("*").alias("n")).collect()}
    total, parts = max(1, sum(counts.values())), []
    at = F.pmod(F.xxhash64("row_id", "src"), F.lit(1 << 20))
    for src, n in sorted(counts.items()):
        quota = min(n, max(1, MAX_UNLABELLED * n // total))
        low = min(1.0, (1.3 * quota + 200) / n)  # only the least hashes are sorted; more of them than the quota
        ids = recs.where((F.col("src") == src) & (at < int(low * (1 << 20)))).select("src", "row_id", at.alias("h"))
        parts.append(ids.orderBy("h", "row_id").limit(quota).drop("h"))
    out = parts[0] if parts else recs.select("src", "row_id").limit(0)
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def fold_models(sample: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """The model of all labels, and the held-out scores of the confirmed toxic records, sorted.

    ``sample``: src, row_id, text, toxic (null: unlabelled), fold (null: in every model); at most ``MAX_LABELLED`` +
    ``MAX_UNLABELLED`` rows a fold.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["src", "row_id"])
        part = int(rows.part.iloc[0])
        held = rows[(rows.fold == part) & (rows.toxic == 1)].text
        seen = rows[rows.fold != part]
        m = fit(list(seen[seen.toxic == 1].text), list(seen[seen.toxic != 1].text))
        out = [*m.items()] * (part == FOLDS) + [(None, score_text(t, m, {})) for t in held]
        return pd.DataFrame(out, columns=["feature", "value"])

    parts = sample.withColumn("part", F.explode(F.array(*map(F.lit, range(FOLDS + 1)))))  # no label is of part FOLDS
    got = parts.groupBy("part").applyInPandas(run, "feature string, value double").toPandas()  # MAX_FEATURES weights and MAX_LABELLED scores at most
    weights = got[got.feature.notna()]
    return {"": -1.0} | dict(zip(weights.feature, map(float, weights.value))), np.sort(got[got.feature.isna()].value.to_numpy(float))


def train(recs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray, DataFrame]:
    """Model, held-out scores of confirmed toxic records (category other than none), and the (src, row_id) of the labelled sample.

    Without labels nothing is toxic; a record with as many clean as toxic labels is clean.
    """
    votes = labels.where("category is not null").groupBy("src", "row_id").agg(F.sum(F.when(F.col("category") != "none", 1).otherwise(-1)).alias("v"))
    votes = votes.orderBy(F.xxhash64("src", "row_id"), "src", "row_id").limit(MAX_LABELLED)  # the documented bound of the fitting sample
    order = Window.orderBy(F.xxhash64("src", "row_id"), "src", "row_id")  # at most MAX_LABELLED rows
    votes = votes.select("src", "row_id", F.when(F.col("v") > 0, 1).otherwise(0).alias("toxic"), F.pmod(F.row_number().over(order), F.lit(FOLDS)).alias("fold"))
    rest = unlabelled_sample(recs).join(F.broadcast(votes), ["src", "row_id"], "left_anti").select("src", "row_id", F.lit(None).cast("int").alias("toxic"), F.lit(None).cast("int").alias("fold"))
    chosen = written(votes.unionByName(rest))  # at most MAX_LABELLED + MAX_UNLABELLED rows
    known = chosen.where("toxic is not null").select("src", "row_id")
    if chosen.where("toxic = 1").isEmpty():
        return {"": -1.0}, np.zeros(0), known
    sample = written(recs.select("src", "row_id", "text").join(F.broadcast(chosen), ["src", "row_id"]))
    return *fold_models(sample), known


def threshold(scores: DataFrame, pos: np.ndarray, known: DataFrame, base: float) -> float:
    """``best_threshold`` over the scores of all records that have no label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = tally(pos, b.column(0).to_numpy())
            yield pa.record_batch({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((("bin", pa.int32()), ("n", pa.int64()), ("top", pa.float64())))})

    if not len(pos):
        return np.inf
    loose = scores.join(F.broadcast(known), ["src", "row_id"], "left_anti").select("score")  # at most MAX_LABELLED rows
    bins = loose.mapInArrow(run, "bin int, n long, top double").groupBy("bin").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    return counted_threshold(pos, [(r.bin, r.n, r.top) for r in bins.collect()], base)  # one row per confirmed score at most


def score_records(recs: DataFrame, model: dict[str, float]) -> DataFrame:
    """``recs`` without text, with ``score``: the whole text of every record counts."""
    shared = recs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = shared.value, {}
        for b in batches:
            z = [score_text(t, m, cache) for t in b.column(3).to_pylist()]
            yield pa.record_batch({"src": b.column(0), "row_id": b.column(1), "origin": b.column(2), "score": pa.array(z, pa.float64())})

    return recs.select("src", "row_id", "origin", "text").mapInArrow(run, "src string, row_id long, origin string, score double")


def scored(recs: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, row_id, origin, score, flagged) of every record with a text; without a confirmed toxic label nothing is flagged."""
    model, pos, known = train(recs, labels)
    scores = written(score_records(recs, model))
    cut = threshold(scores, pos, known, model[""])
    return scores.withColumn("flagged", F.col("score") > cut)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_id) of every flagged record; null texts are no cases."""
    return scored(records(spark, sf_dir), table(spark, sf_dir, "content_labels")).where("flagged").select("src", "row_id").distinct()


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, origin, n_rows, n_flagged, rate) per identifier of observations or source of proposals."""
    g = scored(records(spark, sf_dir), table(spark, sf_dir, "content_labels")).groupBy("src", "origin").agg(F.count("*").alias("n_rows"), F.sum(F.col("flagged").cast("long")).alias("n_flagged"))
    return g.withColumn("rate", F.col("n_flagged") / F.col("n_rows"))
