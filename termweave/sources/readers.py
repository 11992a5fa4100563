"""Scans: tables, delimited files and the linker's own text formats, all as declared DataFrames."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas


def read_table(spark: SparkSession, source: str, columns: list[str] | None = None, where: Column | str | None = None, limit: int | None = None, order: list[str] | None = None, **jdbc) -> DataFrame:
    """A table, from Parquet or, with JDBC options, from a database; pruned, filtered and limited before it is read on.

    A limit comes with an order, so that the same rows come back each time.
    """
    df = spark.read.format("jdbc").options(dbtable=source, **jdbc).load() if jdbc else spark.read.parquet(source)
    if where is not None:
        df = df.filter(where)
    if limit is not None:
        df = df.orderBy(*(order or df.columns)).limit(limit)
    return df.select(*columns) if columns else df


def query(spark: SparkSession, sql: str, **views: DataFrame) -> DataFrame:
    """Run SQL over named frames."""
    return spark.sql(sql, **views)


def entities(df: DataFrame) -> DataFrame:
    """``code, name, l3, l4``: rows without a code go, a name that comes twice keeps its greatest code."""
    kept = df.where(F.col("code").isNotNull()).groupBy("name").agg(F.max("code").alias("code"))
    return kept.select("code", "name", F.substring("code", 1, 3).alias("l3"), F.substring("code", 1, 5).alias("l4"))


def labels(df: DataFrame) -> DataFrame:
    """``mention, entity``, trimmed, one row per mention (the greatest entity)."""
    return df.select(F.trim("mention").alias("mention"), F.trim("entity").alias("entity")).groupBy("mention").agg(F.max("entity").alias("entity"))


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", header: bool = False, schema: T.StructType = schemas.ENTITY, encoding: str = "UTF-8") -> DataFrame:
    """A delimited file; fields beyond the schema are dropped."""
    return spark.read.csv(path, sep=sep, header=header, schema=schema, encoding=encoding, mode="PERMISSIVE", enforceSchema=True)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, line``: the number orders lines within a file and is unique."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """One name per line."""
    return _lines(spark, path).select(F.trim("line").alias("name")).where("name != ''")


def read_mentions(spark: SparkSession, path: str, encoding: str = "GB2312", columns: str = "mention string, entity string, code string") -> DataFrame:
    """``columns`` of a CSV file in an encoding whose wide characters hold no comma, up to its first blank line."""
    rows = _in_order(spark, path) if encoding == "UTF-8" else _in_order_bytes(spark, path, encoding)
    schema = T._parse_datatype_string(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, over = None, False
        for b in batches:
            found = []
            for name, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name != file:
                    file, over = name, False
                over = over or not line.strip()
                if not over:
                    fields = [x.strip() or None for x in next(csv.reader([line]))]
                    found.append(dict(zip(names, [*fields, *[None] * len(names)], strict=False)))
            yield pa.RecordBatch.from_pylist(found, pa.schema([(c, pa.string()) for c in names]))

    names = schema.names
    return rows.mapInArrow(run, schema).where(F.col(names[0]).isNotNull())


def _in_order_bytes(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """``_in_order`` of files in another encoding. Spark's text reader takes UTF-8 alone, so each file is read as bytes, whole in one task."""
    blobs = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines = content.decode(encoding, "replace").splitlines()
                for k in range(0, len(lines), 10_000):
                    some = lines[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some, pa.string())], ["file", "line"])

    return blobs.mapInArrow(run, "file string, line string")


def split_records(lines: DataFrame, sep: str = "\t", mark: str = "##") -> DataFrame:
    """``record_id, slot, role, code, name`` from lines of ``code##name`` items; item 0 is main, the rest are other."""
    item = lines.select(F.col("line_no").alias("record_id"), F.posexplode(F.split("line", sep)).alias("slot", "item")).where(F.instr("item", mark) > 0)
    return item.select("record_id", "slot", F.when(F.col("slot") == 0, "main").otherwise("other").alias("role"), F.substring_index("item", mark, 1).alias("code"), F.expr(f"substring(item, instr(item, '{mark}') + {len(mark)})").alias("name"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return split_records(_lines(spark, path))


def read_labelled_records(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, slot, role, mention, entity`` from lines of ``mention##entity`` items; ``NONE`` is null."""
    return split_records(_lines(spark, path)).select("record_id", "slot", "role", F.col("code").alias("mention"), F.when(F.col("name") != "NONE", F.col("name")).alias("entity"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Synonym pairs in both directions."""
    return pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def read_pairs(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """A file of two words a line, in both directions."""
    return both_ways(read_delimited(spark, path, sep, schema=schemas.ALIAS).where("b is not null"))


def canonical(lines: DataFrame, sep: str = " ") -> DataFrame:
    """``name, canon`` from lines whose first name is the canonical one, which maps to itself."""
    words = F.filter(F.split(F.trim("line"), sep), lambda x: x != "")
    return lines.select(words.alias("w")).where(F.size("w") > 0).select(F.explode("w").alias("name"), F.element_at("w", 1).alias("canon")).groupBy("name").agg(F.min("canon").alias("canon"))


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    return canonical(_lines(spark, path))


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """``code, token, weight`` from lines of ``code-token:weight,token:weight``."""
    item = _lines(spark, path).select(F.substring_index("line", "-", 1).alias("code"), F.explode(F.split(F.expr("substring(line, instr(line, '-') + 1)"), ",")).alias("item"))
    return item.where(F.instr("item", ":") > 0).select("code", F.regexp_extract("item", "^(.*):", 1).alias("token"), F.substring_index("item", ":", -1).cast("double").alias("weight"))


def read_entity_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``code, tokens, name`` from lines of ``code:token token:name``."""
    p = F.split("line", ":")
    return _lines(spark, path).where(F.size(p) >= 3).select(p[0].alias("code"), F.filter(F.split(p[1], " "), lambda x: x != "").alias("tokens"), p[2].alias("name"))


def _in_order(spark: SparkSession, path: str) -> DataFrame:
    """``file, line`` of text files whose lines tell by their order what they are: each file's in order, in one partition.

    Such a format is a sequence, so a file is one task's, which streams through it.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    return lines.repartition("file").sortWithinPartitions("file", "block", "n").select("file", "line")


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst, weight`` from the text form: a count of nodes, then for each ``node degree`` and as many lines ``neighbour weight``.

    Names hold no white space. Lines that tell of no degree where a node is due are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, src, left = None, None, 0
        for b in batches:
            rows = []
            for name, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name != file:
                    file, left = name, 0
                words = line.split()
                if left and len(words) >= 2:
                    rows.append((src, words[0], float(words[1])))
                    left -= 1
                elif not left and len(words) == 2 and words[1].isdigit():
                    src, left = words[0], int(words[1])
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    schema = pa.schema([("src", pa.string()), ("dst", pa.string()), ("weight", pa.float64())])
    return _in_order(spark, path).mapInArrow(run, "src string, dst string, weight double")


def read_name_sets(spark: SparkSession, path: str) -> DataFrame:
    """``mention, entity`` from blocks of a ``name | count`` line, as many names and a blank line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, mention, left = None, None, 0
        for b in batches:
            rows = []
            for name, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name != file:
                    file, left = name, 0
                head, mark, count = line.rpartition(" | ")
                if left:
                    rows.append({"mention": mention, "entity": line})
                    left -= 1
                elif mark and count.strip().isdigit():
                    mention, left = head, int(count)
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("mention", pa.string()), ("entity", pa.string())])
    return _in_order(spark, path).mapInArrow(run, "mention string, entity string")


def unpivot_records(wide: DataFrame, record_id: str, main: str, others: list[str], procedures: list[str]) -> DataFrame:
    """The long form ``record_id, slot, role, name`` of records with one column per slot.

    Names are trimmed with inner white space as one space; empty ones and ``NA`` are missing.
    """
    slots = [(main, "main"), *((c, "vice") for c in others), *((c, "surg") for c in procedures)]
    clean = lambda c: F.nullif(F.nullif(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")), F.lit("")), F.lit("NA"))
    cells = F.array(*(F.struct(F.lit(k).alias("slot"), F.lit(role).alias("role"), clean(c).alias("name")) for k, (c, role) in enumerate(slots)))
    return wide.select(F.col(record_id).alias("record_id"), F.inline(cells)).where("name is not null")


def union_years(*tables: DataFrame) -> DataFrame:
    """Tables of several years, one after the other."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """``mention, answer, main, other``: labelled cases with their neighbours by role, as JSON lines."""
    return spark.read.schema(schemas.CASE).json(path)
