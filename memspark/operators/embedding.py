"""Vectors from bytes and from words, names of projects, signatures with a signal (SRC2, T9, T28, T29)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.library import Library


def unpacked(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the little-endian 32-bit floats of a binary ``column`` as an array; null stays null.

    Fails for bytes that are empty or no multiple of four: a vector that was
    written wrong must not pass for a short one.
    """
    size = F.octet_length(column)
    checked = F.when(F.col(column).isNotNull() & ((size == 0) | (size % 4 != 0)), F.raise_error(F.concat(F.lit("no packed vector: bytes "), size.cast("string")))).otherwise(F.col(column))
    x = rows.withColumn(column, checked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            vectors = [None if v is None else np.frombuffer(v, "<f4") for v in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(vectors, pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    shape = ", ".join(f"`{f.name}` {'array<float>' if f.name == column else f.dataType.simpleString()}" for f in rows.schema.fields)
    return x.mapInArrow(run, shape)


def bag_vectors(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``key`` and embedding: counts of each text's words under a hash of the word (the first eight hex digits of its sha256, modulo ``size``), at length 1.

    Words are lower-cased runs of letters and digits.  A text without a word has
    zeros; rows that repeat a key are one text.  Built-in functions only: words
    are counted as rows.
    """
    word = F.explode(F.filter(F.split(F.col(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    place = (F.conv(F.substring(F.sha2(F.lower("w"), 256), 1, 8), 16, 10).cast("long") % size).cast("int")
    counts = rows.select(key, word.alias("w")).groupBy(key, place.alias("at")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    held = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    x = rows.select(key).distinct().join(held, key, "left")
    value = lambda i: F.coalesce(F.try_element_at("m", i) / F.col("norm"), F.lit(0.0))
    return x.select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), value).alias("embedding"))


def has_signal(signature: Column) -> Column:
    """Whether a part of a coarse signature (``name=value`` between bars) has a value."""
    return F.exists(F.split(signature, r"\|"), lambda p: F.substring_index(p, "=", -1) != "")


def asked_text(query: Column, signature: Column) -> Column:
    """What is embedded for a query: the signature before it where that says something, else the query."""
    return F.when(has_signal(signature), F.concat(signature, F.lit("\n"), query)).otherwise(query)


def projects(rows: DataFrame, roots: DataFrame, home: str | None = None) -> DataFrame:
    """``rows`` (id, cwd) with the project: the name of the nearest known repository (``roots``: path) at or above cwd, else that of cwd.

    The home directory and the root are no projects.  Every ancestor of a cwd is
    looked up, so roots are met by equality.
    """
    path = F.regexp_replace("cwd", "(?<=.)/+$", "")
    depth = F.size(F.split(path, "/"))
    above = F.transform(F.sequence(depth, F.lit(1), F.lit(-1)), lambda n: F.call_function("substring_index", path, F.lit("/"), n))
    x = rows.select("id", "cwd", F.posexplode(above).alias("steps", "path")).join(roots.select("path").distinct(), "path")
    near = x.groupBy("id", "cwd").agg(F.min_by("path", "steps").alias("root"))
    y = rows.join(near, ["id", "cwd"], "left").withColumn("root", F.coalesce("root", path))
    name = F.trim(F.substring_index("root", "/", -1))
    outside = (F.col("root") == "/") | (name == "") | (F.lit(home is not None) & (F.col("root") == F.lit(home or "")))
    return y.select("id", "cwd", F.when(~outside, name).alias("project"))


def chunk_bags(lib: Library, size: int = 256) -> DataFrame:
    """id, words, and the sum of places and the largest value of the hashed vector of each chunk's trigger."""
    v = bag_vectors(lib.chunks, "id", "trigger_desc", size)
    top = F.array_max("embedding")
    return v.select("id", F.size(F.filter("embedding", lambda x: x > 0)).alias("filled"), F.round(top, 6).alias("largest"), (F.array_position("embedding", top) - 1).alias("place"))


def session_projects(lib: Library) -> DataFrame:
    """id and project of each conversation, whose working directory is /w/p<n>/app/<conversation>; every second /w/p<n> is a repository."""
    rows = lib.messages.select(F.concat(F.lit("s"), "conv_id").alias("id"), F.concat(F.lit("/w/p"), F.col("conv_id") % 7, F.lit("/app/c"), "conv_id", F.lit("/")).alias("cwd")).distinct()
    roots = rows.select(F.regexp_extract("cwd", "^(/w/p[0-9])", 1).alias("path"), "cwd").filter(F.col("path").isin("/w/p0", "/w/p2", "/w/p4", "/w/p6")).select("path").distinct()
    return projects(rows, roots, "/w").select("id", "project")
