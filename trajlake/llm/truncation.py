"""Problem 3: text cut off by field limits, in pure SQL.

Word trigrams are counted inside the prose of all responses and at its ends. A response without a closing JSON
block is cut when its last trigram is frequent inside texts and almost never ends a complete one. The last word may
itself be cut, so inner trigrams are counted under every prefix of their third word and the join stays an equi-join.
An open or broken JSON block and a mark at the break count as well; at a source's length limit one inner occurrence is enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trajlake.runtime import checkpoint, table

#: An inner trigram is frequent from this count on, and almost never terminal up to this share.
MIN_INSIDE, MAX_END_SHARE = 2, 0.02
#: The same for the last two words, where the trigram is new.
MIN_BACKOFF = 10
#: A length is a limit when a source has this many unfinished texts of it, and this many times the mean of its neighbours.
MIN_SPIKE, SPIKE_RATIO = 5, 8.0

SOURCES = (("action", "actions", "action_id"), ("judgment", "judgments", "judgment_id"), ("proposal", "proposals", "proposal_id"))

#: parsed: the prose before the first fence, how the text ends, and the state of its JSON block.
PARSED = r"""
SELECT src, row_id, source, response, length(response) AS len,
       (length(response) - length(replace(response, '```', ''))) div 3 AS fences,
       substring_index(response, '```', 1) AS prose,
       trim(TRAILING ' \n\r\t' FROM response) RLIKE '(…|\\.\\.\\.|�|\\[(…|\\.\\.\\.|cut|truncated)\\])$' AS marked,
       NOT response RLIKE '[^\\s\\p{{Z}}\\p{{Cf}}\\p{{Cc}}]' AS blank
FROM {responses} WHERE response IS NOT NULL
"""

#: words: prose in tokens, digits masked; two start marks before each text and each sentence keep the context within it.
WORDS = r"""
SELECT src, row_id, source, len, fences, prose, marked,
       concat(array('^', '^'), filter(split(regexp_replace(regexp_replace(prose, '[0-9]+', '0'), '(?<=[.!?…»”"“])\\s+', ' ^ ^ '), '\\s+'), w -> w <> '')) AS w
FROM {parsed} WHERE NOT blank
"""

INSIDE = """
SELECT a, b, c, sum(inside) AS inside, sum(ended) AS ended, sum(1 - inside) AS any_end FROM (
  SELECT g.a AS a, g.b AS b, g.c AS c, CASE WHEN g.e THEN 0 ELSE 1 END AS inside,
         CASE WHEN g.e AND fences >= 2 THEN 1 ELSE 0 END AS ended
  FROM (SELECT fences, explode(transform(sequence(3, size(w)), i -> struct(w[i - 3] AS a, w[i - 2] AS b, w[i - 1] AS c, i = size(w) AS e))) AS g
        FROM {words} WHERE size(w) >= 3)
  WHERE g.c <> '^'
) GROUP BY a, b, c
"""

#: The word pairs that some loose text ends in.
ENDS = "SELECT DISTINCT a, b FROM {loose}"

#: Inner trigrams under each prefix of their third word, only for the word pairs some text ends in.
EVIDENCE = """
SELECT a, b, p AS c, sum(inside) AS inside, sum(CASE WHEN p = c THEN ended ELSE 0 END) AS ended FROM (
  SELECT i.a, i.b, i.c, i.inside, i.ended, explode(transform(sequence(1, length(i.c)), n -> left(i.c, n))) AS p
  FROM {inside} i LEFT SEMI JOIN {ends} e ON i.a = e.a AND i.b = e.b
) GROUP BY a, b, p
"""

#: The same under the last two words alone, for word pairs no other text has.
BACKOFF = """
SELECT b, p AS c, sum(inside) AS inside, sum(CASE WHEN p = c THEN any_end ELSE 0 END) AS ended FROM (
  SELECT i.b, i.c, i.inside, i.any_end, explode(transform(sequence(1, length(i.c)), n -> left(i.c, n))) AS p
  FROM (SELECT b, c, sum(inside) AS inside, sum(any_end) AS any_end FROM {inside} GROUP BY b, c) i
  LEFT SEMI JOIN {ends} e ON i.b = e.b
) GROUP BY b, p
"""

SPIKES = """
SELECT h.src, h.source, h.len FROM (
  SELECT src, source, len, n, sum(n) OVER (PARTITION BY src, source ORDER BY len RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS near
  FROM (SELECT src, source, len, count(*) AS n FROM {parsed} WHERE fences < 2 AND NOT blank GROUP BY src, source, len)
) h WHERE n >= {min_spike} AND n >= {ratio} * greatest(near - n, 1) / 20
"""

#: Texts whose own form shows the cut; no join.
BROKEN = r"""
SELECT src, row_id, source FROM {parsed} WHERE NOT blank AND (
  fences % 2 = 1 OR marked
  OR (fences >= 2 AND NOT rtrim(response) LIKE '%```')
  OR (fences = 0 AND (prose RLIKE '^\\s*\\{{' AND NOT rtrim(prose) LIKE '%}}' OR right(prose, 3) RLIKE '\\n\\s*`{{1,2}}$')))
"""

#: Texts without a block or a sentence-final sign at their end, with their last three words; few, so the joins are small.
LOOSE = r"""
SELECT src, row_id, source, len, get(w, size(w) - 3) AS a, get(w, size(w) - 2) AS b, get(w, size(w) - 1) AS c,
       prose RLIKE '[«„][^«„»“”]*$' OR (length(prose) - length(replace(prose, '"', ''))) % 2 = 1 AS open_quote
FROM {words} WHERE fences = 0 AND NOT marked AND NOT rtrim(prose) RLIKE '[.!?…»”"“)\\]|*`]$'
"""

CUT = """
SELECT t.src, t.row_id, t.source FROM {loose} t
LEFT JOIN {evidence} e ON t.a = e.a AND t.b = e.b AND t.c = e.c
LEFT JOIN {backoff} f ON t.b = f.b AND t.c = f.c
LEFT JOIN {spikes} s ON t.src = s.src AND t.source <=> s.source AND t.len = s.len
WHERE t.open_quote
   OR (e.inside >= CASE WHEN s.len IS NULL THEN {min_inside} ELSE 1 END AND e.ended <= {max_share} * e.inside)
   OR (coalesce(e.inside, 0) = 0 AND f.inside >= {min_backoff} AND f.ended <= 5 * {max_share} * f.inside)
"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_id, source, response) of actions, judgments and proposals."""
    parts = [table(spark, sf_dir, t).selectExpr(f"'{s}' AS src", f"{k} AS row_id", "source", "response") for s, t, k in SOURCES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def cut_records(responses_df: DataFrame) -> DataFrame:
    """(src, row_id, source) of the responses that were cut on their way into storage.

    Input: src, row_id, source, response. Null and blank responses are no cases, a null source is a source of its own,
    repeated rows count each, an empty table gives an empty result.
    """
    spark = responses_df.sparkSession
    names = dict(responses=responses_df)
    names["parsed"] = spark.sql(PARSED, **names)
    names["words"] = spark.sql(WORDS, parsed=names["parsed"])
    names["inside"] = spark.sql(INSIDE, words=names["words"])
    names["inside"] = checkpoint(names["inside"])
    names["loose"] = checkpoint(spark.sql(LOOSE, words=names["words"]))
    names["ends"] = spark.sql(ENDS, loose=names["loose"])
    evidence = spark.sql(EVIDENCE, inside=names["inside"], ends=names["ends"])
    backoff = spark.sql(BACKOFF, inside=names["inside"], ends=names["ends"])
    spikes = spark.sql(SPIKES.replace("{min_spike}", str(MIN_SPIKE)).replace("{ratio}", str(SPIKE_RATIO)), parsed=names["parsed"])
    cut = CUT.replace("{min_inside}", str(MIN_INSIDE)).replace("{max_share}", str(MAX_END_SHARE)).replace("{min_backoff}", str(MIN_BACKOFF))
    found = spark.sql(cut, loose=names["loose"], evidence=evidence, backoff=backoff, spikes=spikes)
    return found.union(spark.sql(BROKEN, parsed=names["parsed"])).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_id) of every truncated response."""
    return cut_records(responses(spark, sf_dir)).select("src", "row_id").distinct()


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, source, n_rows, n_cut, cut_share): how often each source truncates, over all its rows with a response."""
    from pyspark.sql import functions as F

    r = responses(spark, sf_dir).where("response IS NOT NULL")
    cut = cut_records(r).groupBy("src", "source").agg(F.count("*").alias("n_cut"))
    total = r.groupBy("src", "source").agg(F.count("*").alias("n_rows"))
    joined = total.alias("t").join(cut.alias("c"), F.expr("t.src = c.src AND t.source <=> c.source"), "left")
    n = F.coalesce(F.col("c.n_cut"), F.lit(0).cast("long"))
    return joined.select("t.src", "t.source", "n_rows", n.alias("n_cut"), (n / F.col("n_rows")).alias("cut_share"))
