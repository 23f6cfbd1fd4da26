"""Corpora as JSON lines, and the normalisation of API pages into works."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.arrays import let
from lacuna.sources.files import Folder
from lacuna.sources.schema import ID_PREFIX, PAGE, REQUIRED, WORKS

WORKS_FILE = "works.jsonl"
_BODY = T.StructType([f for f in WORKS.fields if f.name != "ord"])


class CorpusError(Exception):
    """A corpus file that can't be used; the message has its path and line."""


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, path, line, value): lines in the order of files by name and of their place in the file, from 0 on.

    Spark deals files in splits by size, so the order of rows is not that of the files. Within a split rows keep their
    order; splits are numbered by file and start, a row each, and the lines before each are added up.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    splits = rows.groupBy("path", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    so_far = lambda by: F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("path", "start", "first", so_far(Window.orderBy("path", "start")).alias("before"), so_far(Window.partitionBy("path").orderBy("start")).alias("before_in_file"))
    placed = rows.join(F.broadcast(splits), ["path", "start"])  # as many rows as splits
    within = F.col("at") - F.col("first")
    return placed.select((F.col("before") + within).alias("ord"), "path", (F.col("before_in_file") + within).alias("line"), "value")


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """Works of a JSON-lines file or folder, in the order of their lines.

    Blank lines are skipped. A line that isn't a work makes the action that reads it fail with its path and number.
    """
    work = F.from_json("value", _BODY, {"mode": "PERMISSIVE"})
    parsed = _numbered_lines(spark, path).where(F.trim("value") != "").select("ord", "path", "line", work.alias("w"))
    bad = F.col("w").isNull()
    for name in REQUIRED:
        bad = bad | F.col(f"w.{name}").isNull()
    said = F.concat(F.col("path"), F.lit(":"), (F.col("line") + 1).cast("string"), F.lit(": not a work"))
    checked = parsed.withColumn("w", F.when(bad, F.raise_error(said).cast(_BODY)).otherwise(F.col("w")))
    out = checked.select("ord", "w.*")
    return out.withColumn("topics", F.coalesce("topics", F.array().cast(WORKS["topics"].dataType))).select(*WORKS.fieldNames())


def load_corpus(spark: SparkSession, data_dir: str) -> DataFrame:
    """Works of a data folder; says what to do if there are none yet."""
    path = f"{data_dir}/{WORKS_FILE}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"{path} does not exist; run fetch first")
    return read_works(spark, path)


def write_works(works: DataFrame, path: str) -> None:
    """Works as JSON lines, distributed and committed as a whole; in a few files the lines keep their order."""
    works.orderBy("ord").drop("ord").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_works_file(rows, folder: Folder, name: str) -> int:
    """Works (dicts) as one file of a folder, line by line from the driver, replaced as a whole; how many they are."""
    n = 0

    def lines():
        nonlocal n
        for row in rows:
            n += 1
            yield json.dumps(row, ensure_ascii=False) + "\n"

    folder.replace(name, lines())
    return n


def bare_id(c: Column) -> Column:
    """An id without the address before it."""
    return F.when(c.startswith(ID_PREFIX), F.substring(c, len(ID_PREFIX) + 1, 1 << 30)).otherwise(c)


def abstract_of(index: Column) -> Column:
    """The text of an inverted index {word: [positions]}.

    The lexicographically last word wins a position, holes are skipped, and null stands for no text and for an
    index whose positions are negative or spread far beyond its words.
    """
    entries = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(F.coalesce(e["value"], F.array().cast("array<bigint>")), lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))

    def text(o: Column) -> Column:
        words = F.transform(F.filter(o, lambda e, i: (i == F.size(o) - 1) | (F.get(o, i + 1)["p"] != e["p"])), lambda e: e["w"])
        # The last position is compared without adding one, so that the largest does not overflow.
        last, least = F.get(o, F.size(o) - 1)["p"], F.get(o, F.lit(0))["p"]
        return F.when((F.size(o) > 0) & (least >= 0) & (last < F.greatest(4 * F.size(o), F.lit(1024))), F.array_join(words, " "))

    return F.when(index.isNotNull(), let(F.array_sort(entries), text))


def normalise_pages(pages: DataFrame) -> DataFrame:
    """Works of API pages (``PAGE`` with ``page``, their order), before limit and de-duplication.

    Results without an id are left out; tags that lack a field are left out; other fields may be missing.
    """
    r = F.col("r")
    empty = lambda name: F.array().cast(WORKS[name].dataType)
    concepts = F.transform(
        F.filter(F.coalesce(r["concepts"], F.array().cast(PAGE["results"].dataType.elementType["concepts"].dataType)), lambda c: c["id"].isNotNull() & c["display_name"].isNotNull() & c["level"].isNotNull() & c["score"].isNotNull()),
        lambda c: F.struct(bare_id(c["id"]).alias("id"), c["display_name"].alias("name"), c["level"].alias("level"), c["score"].alias("score")),
    )
    topics = F.transform(
        F.filter(F.coalesce(r["topics"], F.array().cast(PAGE["results"].dataType.elementType["topics"].dataType)), lambda t: t["id"].isNotNull() & t["display_name"].isNotNull() & t["score"].isNotNull()),
        lambda t: F.struct(bare_id(t["id"]).alias("id"), t["display_name"].alias("name"), t["score"].alias("score"), t["subfield"]["display_name"].alias("subfield"), t["field"]["display_name"].alias("field"), t["domain"]["display_name"].alias("domain")),
    )
    rows = pages.select("page", F.posexplode(F.coalesce("results", F.array().cast(PAGE["results"].dataType))).alias("pos", "r")).where(r["id"].isNotNull())
    return rows.select(
        F.struct("page", "pos").alias("at"), bare_id(r["id"]).alias("id"), r["display_name"].alias("title"), r["publication_year"].alias("year"), F.coalesce(r["cited_by_count"], F.lit(0)).cast("bigint").alias("cited_by_count"),
        F.transform(F.coalesce(r["referenced_works"], F.array().cast("array<string>")), bare_id).alias("referenced_works"),
        F.coalesce(concepts, empty("concepts")).alias("concepts"), F.coalesce(topics, empty("topics")).alias("topics"), abstract_of(r["abstract_inverted_index"]).alias("abstract"),
    )


def number_rows(works: DataFrame) -> DataFrame:
    """``at`` (page, pos) turned into ``ord``: rows before the page plus the position among its kept rows.

    Only pages are numbered in one place, a row each; rows are numbered within their page.
    """
    within = F.row_number().over(Window.partitionBy("at.page").orderBy("at.pos")) - 1
    sizes = works.groupBy(F.col("at.page").alias("page")).count()
    before = sizes.select("page", F.coalesce(F.sum("count").over(Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = works.withColumn("within", within).withColumn("page", F.col("at.page")).join(before, "page")
    return rows.withColumn("ord", (F.col("before") + F.col("within")).cast("bigint")).select(*WORKS.fieldNames())


def truncate_dedup(works: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` works, all if it is None, and of those the first of each id."""
    cut = works if limit is None else works.where(F.col("ord") < limit)
    row = F.struct(*[F.col(c) for c in WORKS.fieldNames()])
    return cut.groupBy("id").agg(F.min_by(row, "ord").alias("w")).select("w.*")


def parse_pages(spark: SparkSession, path: str) -> DataFrame:
    """``PAGE`` rows with ``page`` (from the file's number) of cached pages; a file without ``results`` fails the read."""
    raw = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), "value")
    page = F.regexp_extract("path", r"page-(\d+)\.json$", 1).cast("int")
    keyed = F.array_contains(F.json_object_keys("value"), "results")
    body = F.from_json("value", PAGE)
    bad = ~F.coalesce(keyed, F.lit(False)) | body.isNull()
    said = F.concat(F.col("path"), F.lit(": not a page of works; delete it and fetch again"))
    return raw.select(page.alias("page"), F.when(bad, F.raise_error(said).cast(PAGE)).otherwise(body).alias("b")).select("page", "b.*")
