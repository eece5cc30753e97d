"""Problem 2: broken prompt and response pairs.

Truncation is found by sorting: the last sentence of a response that ends without a sentence-final sign stands, in
sort order, right before its longer versions, so one pass over range-partitioned, sorted distinct sentences compares
each with its neighbour's prefix. Limits show as spikes in the lengths of a source. Copy, refusal and language rules
follow. Each reply is read once, in an Arrow pass that applies the rules a reply decides alone and keeps, for the rest,
a few numbers: its language, hashes of what it may copy, and its last sentence. No reply text is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajlake.llm.truncation import MIN_SPIKE, SPIKE_RATIO
from trajlake.runtime import checkpoint, table, written

SOURCES = (("action", "actions", "action_id"), ("judgment", "judgments", "judgment_id"))

#: Function words that tell the four languages apart.
FUNCTION_WORDS = {
    "en": "the of and is was that this with but not yet so will which it its on in to at for from what has have been did".split(),
    "fr": "le la les des du un une et est dans que qui ne pas je sur pour avec ce cette mais donc plus il elle au aux sont par".split(),
    "de": "der die das und ist ein eine nicht den dem des mit auf zu im ich es sich weil deshalb für von wie auch noch wurde wird".split(),
    "es": "el la los las del un una y es en que no por con para se su lo al como más pero así sobre este esta ha fue".split(),
}

#: What a refusal says, per language.
REFUSALS = (
    r"\b(?:i(?:'m| am)? (?:cannot|can't|can not|won't|will not|must|have to|am unable to|unable to|not able to|'d rather not|not allowed to)"
    r"(?: [a-z,]+){0,4}? (?:help|assist|comply|do (?:this|that|it)|decline|refuse|pass on this|take this on|carry (?:this|it) out|continue with this|go any further))\b",
    r"\bi'd rather not\b|\bmy (?:policy|rules|guidelines) (?:doesn't|don't|do not|does not|forbid)|\bagainst my (?:guidelines|policy|rules)\b",
    r"\bnot something i(?:'m| am| will|'ll)? ?(?:allowed to )?(?:do|will do)?\b|\bout of the question for me\b|\b(?:i|must|have to) (?:decline|refuse)\b|\bmust stop here and decline\b",
    r"\b(?:dois|devons) refuser\b|\bne (?:peux|puis|pouvons) pas (?:vous )?(?:aider|faire|accéder|répondre)|\bne me permettent pas\b|\bje refuse\b",
    r"\b(?:anfrage|aufgabe|bitte)\b.{0,30}\bablehnen\b|\bdabei kann ich nicht helfen\b|\bkann (?:ich )?(?:ihnen )?(?:dabei |damit )?nicht helfen\b|\bdarf ich .{0,40}nicht ausführen\b|\bich muss .{0,40}ablehnen\b",
    r"\bdebo negarme\b|\bno puedo ayudar|\bno me permiten\b|\bme niego a\b|\btengo que rechazar\b",
)

STAND_INS = r"^(?:none|null|nil|n/?a|nan|undefined|empty|no ?(?:response|answer|output)|-+|–|—|\.+|…|\?+|_+)$"


WORD = re.compile(r"[^\W_]+")
SOLID = re.compile(r"[^\W_]")
#: Five words or more; beyond twenty characters they hold more letters than any stand-in.
PLAIN_START = re.compile(r"(?:[^\W_]+ ){5,8}")
SHELL = re.compile(r"```(?:json)?|</?[a-z]+>")
EMPTY = re.compile(r"[{}\[\]\s]*|" + STAND_INS.strip("^$"))
MARKED = re.compile("(?:…|\\.\\.\\.|\ufffd|\\[(?:…|\\.\\.\\.|cut|truncated)\\])$")
FINAL = re.compile(r"[.!?…»”\"“)\]|*`]$")
OPEN_QUOTE = re.compile("[«„][^«„»“”]*$")
SENTENCE = re.compile(r"(?<=[.!?…»”\"“])\s+|\n+")
REFUSAL = [re.compile(r) for r in REFUSALS]
#: Every refusal has one of these.
REFUSAL_CUES = re.compile(r"rather|cannot|can't|can not|unable|not able|not allowed|won't|will not|policy|rules|guidelines|not something|out of the question|decline|refuse|pass on|refus|peux pas|puis pas|pouvons pas|permettent|ablehnen|nicht helfen|darf ich|negarme|no puedo|no me permiten|me niego|rechazar")
LANGUAGE_SETS = {k: frozenset(ws) for k, ws in FUNCTION_WORDS.items()}
#: A reply that copies has at most so many words round the instruction.
LEAD = 4
#: Buckets of the hashes of all instructions, one byte each: a table of one size however many tasks there are.
ASKED_BUCKETS = 1 << 21
#: Letters and digits of the longest stand-in.
LONGEST_STAND_IN = 10


def language(words: list[str]) -> str | None:
    """Language by distinct function words; None where none leads by two."""
    seen = set(words)
    hits = sorted(((len(seen & ws), k) for k, ws in LANGUAGE_SETS.items()), reverse=True)
    return hits[0][1] if hits[0][0] - hits[1][0] >= 2 else None


def digest(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)


def next_like(words: list[str], at: int) -> int:
    """Where the three words at ``at`` stand again; the end where they do not."""
    j, three = at, words[at : at + 3]
    try:
        while True:
            j = words.index(three[0], j + 1)
            if words[j : j + 3] == three:
                return j
    except ValueError:
        return len(words)


def copied_forms(words: list[str]) -> list[int]:
    """Hashes of the word runs of which the reply is a copy, if it is one: once between a few other words, or several times over."""
    n, out = len(words), []
    ends_alike = words.count(words[-1])  # every copy has the same last word
    joined = " ".join(words).encode()
    starts, ends = [0], [len(joined)]
    for k in range(min(LEAD, n - 1)):
        starts.append(starts[-1] + len(words[k].encode()) + 1)
        ends.append(ends[-1] - len(words[n - 1 - k].encode()) - 1)
    for lead in range(min(LEAD, n - 1) + 1):
        for tail in range(min(LEAD - lead, n - lead - 1) + 1):
            out.append(xxhash.xxh64_intdigest(joined[starts[lead] : ends[tail]]) - (1 << 63))
        if ends_alike < 2:
            continue
        m = n - lead
        again = next_like(words, lead) if ends_alike > 2 else n
        unit = again - lead
        if 2 * unit < m and m % unit == 0 and words[lead:] == words[lead:again] * (m // unit):
            out.append(digest(words[lead:again]))
        for again in range(min(LEAD - lead, m - 2) + 1):  # the lead may come again before the second copy
            size, odd = divmod(m - again, 2)
            if not odd and size and words[lead] == words[n - size] and words[lead : lead + size] == words[n - size :]:
                out.append(digest(words[n - size :]))
    return out


def sentences(prose: str) -> list[str]:
    return [p.lstrip() for p in SENTENCE.split(re.sub(r"[0-9]+", "0", prose)) if p.strip()]


def says_nothing(response: str) -> bool:
    """Nothing stands in the reply but blanks, an empty shell or a stand-in; read as far as the first longer word reaches."""
    plain = PLAIN_START.match(response)
    if plain and plain.end() > 2 * LONGEST_STAND_IN:
        return False
    start = response[:120]
    if start.rfind("<") > start.rfind(">"):
        start = start[: start.rfind("<")]
    if len(SOLID.findall(SHELL.sub(" ", start))) > LONGEST_STAND_IN + 4:  # four letters of a fence's label may be cut off it
        return False
    core, solid = [], 0
    for c in SHELL.sub(" ", response):
        if unicodedata.category(c)[0] not in "ZC":
            core.append(c)
            solid += c.isalnum()
            if solid > LONGEST_STAND_IN:
                return False
    return bool(EMPTY.fullmatch("".join(core).lower()))


def judged(response: str | None) -> tuple[str | None, str | None, list[int] | None, str | None, str | None]:
    """(defect, language, copied forms, last sentence of a loose end, last sentence of a sound one) of a reply by itself."""
    if response is None:
        return "empty", None, None, None, None
    if says_nothing(response):
        return "empty", None, None, None, None
    fences, prose = response.count("```"), response.split("```", 1)[0]
    low = prose.lower().replace("’", "'")
    if REFUSAL_CUES.search(low) and any(r.search(low) for r in REFUSAL):
        return "refusal", None, None, None, None
    end, tail = response.rstrip(), prose.rstrip()
    final = bool(FINAL.search(tail))
    if (
        fences % 2
        or MARKED.search(end)
        or (fences >= 2 and not end.endswith("```"))
        or (fences == 0 and (re.search(r"\n\s*`{1,2}$", prose) or (prose.lstrip().startswith("{") and not tail.endswith("}"))))
        or (fences == 0 and not final and (OPEN_QUOTE.search(prose) or prose.count('"') % 2))
    ):
        return "truncated", None, None, None, None
    words = WORD.findall(prose.lower())
    last = sentences(prose)[-1:] or [None]
    loose = last[0] if fences == 0 and not final else None
    return None, language(words), copied_forms(words) if words else None, loose, last[0] if fences else None


def neighbour_prefixes(sentences: DataFrame, partitions: int = 0) -> DataFrame:
    """The distinct texts of ``sentences`` (column ``s``) that are a proper prefix of another one.

    Range partitions keep the sort distributed whatever prefix is hot; the last text of each partition meets the first
    text of the next in a table of one row per partition.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev, first, out, pid = None, None, [], None
        for b in batches:
            pids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for p, t in zip(pids, texts):
                if prev is None:
                    first, pid = t, p
                elif t.startswith(prev):
                    out.append(prev)
                prev = t
            yield pa.record_batch({"s": pa.array(out, pa.string()), "pid": pa.nulls(len(out), pa.int32()), "first": pa.nulls(len(out), pa.string())})
            out = []
        if prev is not None:
            yield pa.record_batch({"s": pa.array([prev], pa.string()), "pid": pa.array([pid], pa.int32()), "first": pa.array([first], pa.string())})

    n = [partitions] if partitions else []
    in_order = sentences.select("s").repartitionByRange(*n, "s").sortWithinPartitions("s")
    hits = checkpoint(in_order.select(F.spark_partition_id().alias("pid"), "s").mapInArrow(walk, "s string, pid int, first string"))
    edges = hits.where("pid is not null").withColumn("next", F.lead("first").over(Window.orderBy("pid")))  # one row per partition
    return hits.where("pid is null").select("s").union(edges.where("startswith(next, s) and next <> s").select("s"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_id, task_id, source, response) of actions and judgments."""
    a, b = (table(spark, sf_dir, t).selectExpr(f"'{s}' AS src", f"{k} AS row_id", "task_id", "source", "response") for s, t, k in SOURCES)
    return a.unionByName(b)


RULED = "src string, row_id long, task_id long, source string, len int, defect string, lang string, forms array<long>, loose string, sound string"


def _rules(asked: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``asked``: one flag per bucket of instruction hashes; forms that fall in no flagged bucket are no copy of any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, low = asked.value, ASKED_BUCKETS - 1
        for b in batches:
            texts = b.column(4).to_pylist()
            got = [judged(t) for t in texts]
            kinds = (pa.string(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.string())
            cols = {n: b.column(i) for i, n in enumerate(("src", "row_id", "task_id", "source"))}
            cols["len"] = pa.array([len(t) if t is not None else 0 for t in texts], pa.int32())
            cols |= {n: pa.array([g[i] for g in got], kinds[i]) for i, n in enumerate(("defect", "lang", "forms", "loose", "sound")) if n != "forms"}
            cols["forms"] = pa.array([[f for f in g[2] or () if flags[f & low]] or None for g in got], kinds[2])
            cols["half"] = pa.array([t is not None and t.count("```") < 2 and g[0] != "empty" for t, g in zip(texts, got)])
            yield pa.record_batch({n: cols[n] for n in ("src", "row_id", "task_id", "source", "len", "defect", "lang", "forms", "loose", "sound", "half")})

    return run


def _distinct_sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sentences of replies, each once a task as far as memory is spared; what ends an unclosed reply is no evidence."""
    seen: set[str] = set()
    for b in batches:
        out = []
        for t in b.column(0).to_pylist():
            parts = sentences(t.split("```", 1)[0])
            for p in parts if "```" in t else parts[:-1]:
                if p not in seen:
                    seen.add(p)
                    out.append(p)
        if len(seen) > 200_000:
            seen.clear()
        yield pa.record_batch({"s": pa.array(out, pa.string())})


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [WORD.findall(t.lower()) for t in b.column(1).to_pylist()]
        yield pa.record_batch({"task_id": b.column(0), "asked": pa.array([digest(w) if w else None for w in words], pa.int64()), "asked_lang": pa.array([language(w) for w in words], pa.string())})


def broken_pairs(replies_df: DataFrame, tasks: DataFrame) -> DataFrame:
    """(src, row_id, defect) of each broken pair, at most one defect a row: empty, refusal, truncated, copied, wrong_language.

    A null or blank response is empty; a reply whose task is missing or null is judged without it; equal texts under
    several ids each count; an empty table gives an empty result.
    """
    # copies and languages need the task: only its hash and language are joined
    one_task = tasks.where("task_id is not null and instruction is not null").groupBy("task_id").agg(F.min("instruction").alias("instruction")).mapInArrow(_asked, "task_id long, asked long, asked_lang string")
    one_task = written(one_task)
    buckets = one_task.where("asked is not null").select(F.col("asked").bitwiseAND(ASKED_BUCKETS - 1).cast("int").alias("b")).distinct().toPandas().b.to_numpy()  # ASKED_BUCKETS rows at most
    flags = bytearray(ASKED_BUCKETS)
    for i in buckets:
        flags[i] = 1
    asked = replies_df.sparkSession.sparkContext.broadcast(bytes(flags))
    ruled = checkpoint(replies_df.select("src", "row_id", "task_id", "source", "response").mapInArrow(_rules(asked), RULED + ", half boolean"))
    # loose ends: shortened versions by neighbouring prefixes, and rare ends at a source's length limit
    loose = ruled.where("loose is not null").select("src", "row_id", "source", "len", F.col("loose").alias("s"))
    whole = replies_df.where("response is not null").select("response").mapInArrow(_distinct_sentences, "s string")
    ends = checkpoint(loose.select("s").distinct())
    prefix = neighbour_prefixes(whole.union(ends).distinct()).distinct()
    sound = ruled.where("sound is not null").select(F.col("sound").alias("s")).join(ends, "s", "left_semi").distinct()
    lengths = ruled.where("half").groupBy("src", "source", "len").agg(F.count("*").alias("n"))
    near = F.sum("n").over(Window.partitionBy("src", "source").orderBy("len").rangeBetween(-10, 10))
    spikes = lengths.withColumn("near", near).where((F.col("n") >= MIN_SPIKE) & (F.col("n") >= SPIKE_RATIO * F.greatest(F.col("near") - F.col("n"), F.lit(1)) / 20))
    by_text = loose.join(prefix, "s", "left_semi").join(sound, "s", "left_anti").select("src", "row_id")
    tail = F.regexp_extract("s", r"(\S+\s+\S+)\s*$", 1)
    shared = loose.groupBy(tail.alias("tail")).agg(F.count("*").alias("n")).where("n > 3").select("tail")
    l, k = loose.alias("l"), spikes.select("src", "source", "len").alias("k")
    spiked = l.join(k, F.expr("l.src = k.src and l.source <=> k.source and l.len = k.len"), "left_semi")
    # a sound reply may have a limit's length: at a spike the last words must not be an ending other replies share
    spiked = spiked.withColumn("tail", tail).join(shared, "tail", "left_anti").select("src", "row_id")
    cut = by_text.union(spiked).distinct().select("src", "row_id", F.lit("truncated").alias("defect"))
    open_rows = ruled.where("defect is null").select("src", "row_id", "task_id", "lang", "forms")
    paired = open_rows.join(one_task, "task_id")
    kind = F.when(F.coalesce(F.array_contains("forms", F.col("asked")), F.lit(False)), "copied").when(F.col("lang") != F.col("asked_lang"), "wrong_language")
    judged_pairs = paired.select("src", "row_id", kind.alias("defect")).where("defect is not null").join(cut, ["src", "row_id"], "left_anti")
    return ruled.where("defect is not null").select("src", "row_id", "defect").union(cut).union(judged_pairs).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_id, defect) of every broken pair of actions and judgments."""
    return broken_pairs(replies(spark, sf_dir), table(spark, sf_dir, "tasks"))
