"""Other tables as corpora: orders as works with the brands, types and names of their parts as labels; documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.functions.arrays import let
from lacuna.sources.schema import WORKS


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def basket_works(spark: SparkSession, sf_dir: str, references: bool = False) -> DataFrame:
    """Orders as works. Concepts are brand and type of the parts (level: a tenth of the size; score: a fiftieth of the
    quantity), topics the part names; references are the customer's up to five orders before, if asked for."""
    orders, lines, parts = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    rows = lines.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity").join(parts.select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    score = F.col("l_quantity") / 50.0
    label = F.concat_ws("/", "p_brand", "p_type")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", label.alias("c"), F.floor(F.col("p_size") / 10).cast("int").alias("level"), F.col("p_name").alias("t"), score.alias("score"))
    lists = rows.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))  # the lines of one order
    concepts = F.transform("lines", lambda x: F.struct(x["c"].alias("id"), x["c"].alias("name"), x["level"].alias("level"), x["score"].alias("score")))
    none = F.lit(None).cast("string")
    topics = F.transform("lines", lambda x: F.struct(x["t"].alias("id"), x["t"].alias("name"), x["score"].alias("score"), none.alias("subfield"), none.alias("field"), none.alias("domain")))
    before = F.array().cast("array<string>")
    own = ["o_orderkey", "o_orderdate", "o_totalprice"] + ["o_custkey"] * references
    base = orders.select(*own)
    if references:
        by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        base = base.withColumn("refs", F.array_compact(F.array(*[F.concat(F.lit("W"), F.lag("o_orderkey", i).over(by).cast("string")) for i in range(1, 6)])))
        before = F.col("refs")
    out = base.join(lists, "o_orderkey", "left")
    return out.select(
        F.col("o_orderkey").cast("bigint").alias("ord"), F.concat(F.lit("W"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.year("o_orderdate").cast("int").alias("year"), F.floor("o_totalprice").cast("bigint").alias("cited_by_count"),
        before.alias("referenced_works"), F.coalesce(concepts, F.array().cast(WORKS["concepts"].dataType)).alias("concepts"), F.coalesce(topics, F.array().cast(WORKS["topics"].dataType)).alias("topics"), F.lit(None).cast("string").alias("abstract"),
    )


def document_works(spark: SparkSession, sf_dir: str, least: int = 4) -> DataFrame:
    """Documents as works: the first line is the title, the rest the abstract (null if empty). Concepts are the words of
    four letters or more that stand at least ``least`` times in the whole text; the year is made from the id."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿß]{4,}"), F.lit(0))
    # Sorted, a word that stands often enough is also ``least`` - 1 places on; no word leaves its document.
    often = let(F.sort_array(words), lambda o: F.array_distinct(F.filter(o, lambda w, i: F.get(o, i + (least - 1)) == w)))
    at = F.instr("text", "\n")
    title = F.when(at > 0, F.expr("substring(text, 1, instr(text, '\n') - 1)")).otherwise(F.col("text"))
    rest = F.when(at > 0, F.expr("substring(text, instr(text, '\n') + 1)"))
    concepts = F.transform(often, lambda w: F.struct(w.alias("id"), w.alias("name"), F.lit(2).alias("level"), F.lit(1.0).alias("score")))
    return docs.select(
        F.col("doc_id").alias("ord"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"), title.alias("title"), (2018 + F.col("doc_id") % 7).cast("int").alias("year"), F.lit(0).cast("bigint").alias("cited_by_count"),
        F.array().cast("array<string>").alias("referenced_works"), F.coalesce(concepts, F.array().cast(WORKS["concepts"].dataType)).alias("concepts"), F.array().cast(WORKS["topics"].dataType).alias("topics"), F.when(rest != "", rest).alias("abstract"),
    )


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) between parts that follow each other in an order: a graph with cycles."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    nxt = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return lines.withColumnRenamed("l_partkey", "src").join(nxt, ["l_orderkey", "l_linenumber"]).where("src <> dst").select("src", "dst").distinct()
