"""Sources and sinks: task tables, one-JSON-file-per-entity directories, and the tables that replace them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entity schemas; fixed values.
SCHEMAS = {
    "judgment": "success double, efficiency double, self_correction double, response string, matched_response string",
    "proposal": "proposed_task string, steps array<string>, criteria array<string>, response string, matched_response string",
    "action": "function_calls array<struct<dotpath:string,args:string>>, response string, matched_response string",
    "observation": "current_url string, processed_text string, raw_html string, screenshot_path string, metadata map<string,struct<backend_node_id:string,bounding_client_rect:struct<x:double,y:double,width:double,height:double>,computed_style:map<string,string>,scroll_left:double,scroll_top:double,editable_value:string,is_visible:boolean,is_frontmost:boolean>>",
    "task": "website string, domain string, instruction string, task string, identifier string, steps array<string>, criteria array<string>",
}


def read_entities(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """Rows of the JSON files below ``path`` (a folder or a glob over run folders).

    The file name without .json is the key; a run number comes from a ``run_N`` folder; unreadable files are dropped.
    """
    raw = spark.read.schema(SCHEMAS[entity] + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    out = raw.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.json$", 1).alias("identifier"),
        F.nullif(F.regexp_extract(F.col("_metadata.file_path"), r"run_?=?(\d+)/", 1), F.lit("")).cast("int").alias("run_id"),
        "*",
    )
    return out.where("_corrupt_record is null").drop("_corrupt_record")


def write_entities(df: DataFrame, path: str, required: list[str] | None = None, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Table of an entity, in place of one file each, partitioned by the columns ``by`` (few values: stage, run, split).

    Rows whose ``required`` columns are null, or arrays or texts without content, are left out; no ``path`` writes nothing.
    """
    if not path:
        return
    for c in required or []:
        kind = dict(df.dtypes)[c]
        df = df.where(F.col(c).isNotNull() & ((F.size(c) > 0) if kind.startswith(("array", "map")) else (F.col(c) != "") if kind == "string" else F.lit(True)))
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def literal_tasks(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A task table from dictionaries, absent keys null."""
    fields = [f.split(" ")[0] for f in SCHEMAS["task"].split(", ")]
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], SCHEMAS["task"])


def read_tasks(spark: SparkSession, path: str, default_website: str = "duckduckgo.com", split: str | None = None) -> DataFrame:
    """Task table with its aliases resolved at plan time: an absent column falls through, a null one stays null.

    ``split``: rows of that value of a partition column ``split``, which prunes the others.
    """
    fmt = "parquet" if path.rstrip("/").endswith(".parquet") else "json"
    t = spark.read.format(fmt).load(path)
    if split is not None:
        t = t.where(F.col("split") == split)
    return resolve_tasks(t, default_website)


def resolve_tasks(t: DataFrame, default_website: str = "duckduckgo.com") -> DataFrame:
    """A task table under its canonical names: of several names for a field the first that is a column counts."""

    def pick(*names: str, default: str | None = None):
        for n in names:
            if n in t.columns:
                return F.col(n)
        return F.lit(default)

    empty = F.array().cast("array<string>")
    return t.select(
        pick("website", "domain", default=default_website).alias("website"),
        pick("instruction", "task").alias("instruction"),
        pick("identifier", "domain").alias("identifier"),
        (F.col("steps") if "steps" in t.columns else empty).alias("steps"),
        (F.col("criteria") if "criteria" in t.columns else empty).alias("criteria"),
    )


def exploration(tasks: DataFrame) -> DataFrame:
    """Tasks without what an explorer must not know."""
    return tasks.drop("instruction", "task", "steps", "criteria")
