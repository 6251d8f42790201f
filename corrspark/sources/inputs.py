"""Request, ground-truth and lexicon inputs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corrspark import lexicon, schemas
from corrspark.functions.records import is_cve_id
from corrspark.functions.text import strip

GENERIC_HOST = "Generic"


def ids_from_text(df: DataFrame, col: str) -> DataFrame:
    """Distinct well-formed ids out of comma-separated text."""
    parts = F.transform(F.split(F.col(col), ","), strip)
    return df.select(F.explode(parts).alias("cve_id")).filter(is_cve_id(F.col("cve_id"))).distinct()


def ids_from_cells(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Distinct well-formed ids out of every cell of every row, cells unstripped."""
    cells = F.explode(F.array(*[F.col(c).cast("string") for c in df.columns if c not in keep]))
    return df.select(*keep, cells.alias("cve_id")).filter(is_cve_id(F.col("cve_id"))).distinct()


def read_id_csv(spark: SparkSession, path: str) -> DataFrame:
    return ids_from_cells(spark.read.csv(path, header=False))


def read_host_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(host, cve_id) from a folder with one CSV per host; each first row is a header.

    Sheets are read line by line by the CSV reader, with its quotes; the widest line
    gives the number of columns. A folder with a single sheet belongs to the generic
    host.
    """
    lines = spark.read.text(path, pathGlobFilter="*.csv")
    facts = lines.agg(F.coalesce(F.max(F.size(F.split("value", ","))), F.lit(1)).alias("width"), F.count_distinct("_metadata.file_path").alias("sheets")).first()
    columns = [f"c{i}" for i in range(facts["width"])]
    cells = spark.read.schema(", ".join(f"{c} string" for c in columns)).csv(path, header=True, pathGlobFilter="*.csv")
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    host = name if facts["sheets"] > 1 else F.lit(GENERIC_HOST)
    return ids_from_cells(cells.select(host.alias("host"), *columns), ("host",))


def requests(ids: DataFrame, task_id: str, host: str = GENERIC_HOST) -> DataFrame:
    """Request rows; ids without a host column belong to the generic host."""
    named = F.col("host") if "host" in ids.columns else F.lit(host)
    return ids.select(F.lit(task_id).alias("task_id"), "cve_id", named.alias("host")).distinct()


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(cve_id, capec_id) from a JSON array of entries, see truth_pairs."""
    entries = spark.read.schema(schemas.TRUTH).option("multiLine", True).json(path)
    # the position of an entry decides which duplicate wins
    return truth_pairs(entries.withColumn("pos", F.monotonically_increasing_id()))


def truth_pairs(entries: DataFrame) -> DataFrame:
    """Explode entries; rows without id or list are skipped, the last duplicate wins."""
    usable = entries.filter((F.col("CVE_ID") != "") & F.col("Assigned_CAPEC_ID").isNotNull())
    last = usable.groupBy("CVE_ID").agg(F.max_by("Assigned_CAPEC_ID", "pos").alias("ids"))
    return last.select(F.col("CVE_ID").alias("cve_id"), F.explode("ids").alias("capec_id"))


def truth_from_lists(df: DataFrame, ids: Column, sets: Column) -> DataFrame:
    """(cve_id, capec_id) from parallel arrays of ids and comma lists."""
    pairs = F.explode(F.arrays_zip(ids.alias("cve_id"), sets.alias("capecs")))
    listed = F.explode(F.transform(F.split(F.col("p.capecs"), ","), strip))
    return (
        df.select(pairs.alias("p"))
        .select(F.col("p.cve_id").alias("cve_id"), listed.alias("capec_id"))
        .filter((F.col("cve_id").isNotNull()) & (F.col("capec_id") != ""))
    )


def acronym_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(pos, acronym, expansions): the built-in list, or a JSON file of the same shape."""
    if path is None:
        entries = lexicon.ACRONYMS
    else:
        text = spark.read.text(path, wholetext=True).first()["value"]
        entries = json.loads(text)["acronyms"]
    rows = [(i, a, list(e)) for i, (a, e) in enumerate(entries.items())]
    return spark.createDataFrame(rows, "pos int, acronym string, expansions array<string>")


def acronym_map(table: DataFrame) -> dict[str, list[str]]:
    """The acronym list as the keyword operators take it; a list of this kind is short."""
    return {r["acronym"]: list(r["expansions"]) for r in table.orderBy("pos").collect()}
