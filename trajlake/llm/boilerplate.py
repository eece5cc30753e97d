"""Problems 1 and 5 on ``observations``: template residue and error pages, and the lines of each page's main body."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm.pages import WORDS, bare, body_lines, body_verdict
from trajlake.runtime import checkpoint, table

#: A body of up to this many words is of low information; it is no page's own when it recurs on this many hosts.
THIN_WORDS, MIN_HOSTS = 25, 4


def thin_key(url: str | None, body: list[str]) -> str | None:
    """Key of a body of few words whose heading shares no term with its text or the address; else null."""
    words = [w for x in body for w in WORDS.findall(x.lower())]
    if not words or len(words) > THIN_WORDS or len(body) < 2:
        return None
    slug = set(WORDS.findall((url or "").lower().split("?")[0].rpartition("/")[2]))
    title, rest = set(WORDS.findall(body[0].lower())), {w for x in body[1:] for w in WORDS.findall(x.lower())}
    long = {w for w in title if len(w) > 3}
    if long & (rest | slug):
        return None
    return " ".join(words)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds: dict[str, int] = {}
    for b in batches:
        ids, urls, texts, htmls = (b.column(i).to_pylist() for i in range(4))
        verdict, key, own, main = [], [], [], []
        for u, t, h in zip(urls, texts, htmls):
            lines = t.split("\n")
            keep = body_lines(t, h, kinds)
            body = [bare(lines[i]) for i in keep]
            v = body_verdict(body)
            verdict.append(v)
            key.append(thin_key(u, body) if v == "own" else None)
            own.append(keep if v == "own" else None)
            main.append("\n".join(body) if v == "own" else None)
        yield pa.record_batch({"obs_id": pa.array(ids, pa.int64()), "verdict": pa.array(verdict, pa.string()), "thin": pa.array(key, pa.string()), "host": b.column(4), "lines": pa.array(own, pa.list_(pa.int32())), "main_text": pa.array(main, pa.string())})


def judged_pages(observations: DataFrame, holds: str) -> DataFrame:
    """(obs_id, verdict, thin, host) of every page with a text, and the column ``holds`` if any, lines or main_text, of own
    bodies: the one judgement problems 1 and 5 share. Pages are parsed once; what follows reads the checkpoint.
    """
    host = F.lower(F.regexp_extract("current_url", r"^(?:[a-z+]+:)?//([^/:?#]+)", 1))
    pages = observations.where("processed_text is not null").select("obs_id", "current_url", "processed_text", "raw_html", host.alias("host"))
    judged = pages.mapInArrow(_judged, "obs_id long, verdict string, thin string, host string, lines array<int>, main_text string")
    return checkpoint(judged.select("obs_id", "verdict", "thin", "host", *([holds] if holds else [])))


def recurring(seen: DataFrame) -> DataFrame:
    """(thin) of the thin bodies that stand on several hosts."""
    return seen.where("thin is not null").groupBy("thin").agg(F.count_distinct("host").alias("hosts")).where(F.col("hosts") >= MIN_HOSTS).select("thin")


def residue_pages(observations: DataFrame) -> DataFrame:
    """(obs_id, kind) of the pages that hold unfilled fields or filler, or nothing but an error message.

    kind is field, error or duplicated: a body of few words under a heading that fits neither it nor the address, found
    word by word on several hosts. Null and empty texts are no cases; repeated rows count each.
    """
    seen = judged_pages(observations, "")
    direct = seen.where("verdict in ('field', 'error')").select("obs_id", F.col("verdict").alias("kind"))
    return direct.union(seen.where("thin is not null").join(recurring(seen), "thin", "left_semi").select("obs_id", F.lit("duplicated")))


def main_bodies(observations: DataFrame, holds: str) -> DataFrame:
    """(obs_id, ``holds``) of every page that problem 1 does not exclude; only thin bodies are shuffled."""
    seen = judged_pages(observations, holds)
    own = seen.where("verdict = 'own'")
    single = own.where("thin is not null").join(recurring(seen), "thin", "left_anti")
    return own.where("thin is null").select("obs_id", holds).union(single.select("obs_id", holds))


def main_lines(observations: DataFrame) -> DataFrame:
    """(obs_id, line_no) of the lines of each page's main body, counted from 0.

    Pages of null text, and pages that problem 1 excludes, have none; without HTML the rendered text alone decides.
    """
    return main_bodies(observations, "lines").select("obs_id", F.explode("lines").alias("line_no"))


def main_text(observations: DataFrame) -> DataFrame:
    """(obs_id, main_text): the main body of each page as one text; pages without one are left out."""
    return main_bodies(observations, "main_text")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id) of every observation to leave out."""
    return residue_pages(table(spark, sf_dir, "observations")).select("obs_id").distinct()


def p1_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(identifier, kind, n): residue by site and kind, over all observations."""
    o = table(spark, sf_dir, "observations")
    return residue_pages(o).distinct().join(o.select("obs_id", "identifier"), "obs_id").groupBy("identifier", "kind").agg(F.count("*").alias("n"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id, line_no) of the main body's lines of every page."""
    return main_lines(table(spark, sf_dir, "observations"))


def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id, main_text) of every page with a main body."""
    return main_text(table(spark, sf_dir, "observations"))
