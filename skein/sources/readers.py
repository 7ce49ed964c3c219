"""Sources: strict JSON lines, file inventories, transcripts, chat logs, recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.text import words


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank lines are skipped, an unreadable line or an unknown field is an error that quotes it."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    known = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    keys = F.json_object_keys("value")
    unknown = F.array_except(keys, F.array(*[F.lit(f.name) for f in known]))
    broken = F.try_parse_json("value").isNull() | keys.isNull()
    fault = F.when(broken, F.concat(F.lit("not a JSON object: "), "value")).when(F.size(unknown) > 0, F.concat(F.lit("unknown fields "), F.array_join(unknown, ","), F.lit(" in: "), "value"))
    checked = F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.col("value"))
    return lines.select(F.from_json(checked, known, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def file_inventory(spark: SparkSession, path: str, pattern: str = "*.jsonl", exclude_parts: list[str] | None = None) -> DataFrame:
    """Each file's path, size, time, hash and word count, the first and last ISO day in it, and whether it takes part."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    text = F.decode("content", "UTF-8")
    days = F.transform(F.regexp_extract_all(text, F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0)), lambda d: F.try_to_date(d))
    parts = F.split("path", "/")
    out = F.exists(parts, lambda p: p.isin(list(exclude_parts or [])))
    return files.select("path", F.col("length").alias("byte_size"), "modificationTime", F.sha2("content", 256).alias("sha256"), F.size(words(text)).cast("long").alias("word_count"), F.array_min(days).alias("date_start"), F.array_max(days).alias("date_end"), (~out).alias("included"))


def included_once(inventory: DataFrame) -> DataFrame:
    """Of files with the same content the first path takes part; the others say why not."""
    first = F.row_number().over(Window.partitionBy("sha256").orderBy("path")) == 1
    reason = F.when(~F.col("included"), F.lit("excluded_path")).when(~first, F.lit("duplicate_content"))
    return inventory.withColumn("exclude_reason", reason).withColumn("included", reason.isNull())


def unchanged(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """The manifest's files, or an error if one has changed or gone since."""
    now = current.select("path", F.col("sha256").alias("now"))
    same = F.col("now").eqNullSafe(F.col("sha256"))
    return manifest.join(now, "path", "left").where(F.assert_true(same, F.concat(F.lit("source changed: "), "path")).isNull()).drop("now")


def chat_log(lines: DataFrame) -> DataFrame:
    """User queries of a chat log (path, at, value); the tagged query if there is one, else the text without automatic blocks."""
    record = F.try_parse_json("value")
    role, body = F.try_variant_get(record, "$.role", "string"), F.try_variant_get(record, "$.text", "string")
    tagged = F.regexp_extract(body, r"(?is)<query>(.*?)</query>", 1)
    plain = F.regexp_replace(body, r"(?is)<(context|system|attachments)>.*?</\1>", " ")
    query = F.trim(F.when(tagged != "", tagged).otherwise(plain))
    return lines.select("path", "at", role.alias("role"), query.alias("text"), record.isNull().alias("malformed")).where("malformed or (role = 'user' and text <> '' and not startswith(lower(text), 'summary'))")


def transcript_paragraphs(lines: DataFrame, most_words: int = 350) -> DataFrame:
    """Paragraphs of transcripts (path, at, value) under day headers ``# yyyy-mm-dd``, cut at most_words.

    A header sets the day from there on; headers and blank lines end a paragraph.
    """
    w = Window.partitionBy("path").orderBy("at")
    day = F.try_to_date(F.nullif(F.regexp_extract("value", r"^#\s*(\d{4}-\d{2}-\d{2})", 1), F.lit("")))
    marked = lines.withColumn("own", day).withColumn("ends", F.col("own").isNotNull() | (F.trim("value") == ""))
    placed = marked.withColumn("day", F.last("own", ignorenulls=True).over(w)).withColumn("paragraph", F.sum(F.col("ends").cast("int")).over(w)).where("not ends")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x.value), " ")
    whole = placed.groupBy("path", "day", "paragraph").agg(said.alias("text")).withColumn("w", words(F.col("text")))
    starts = F.sequence(F.lit(1), F.size("w"), F.lit(most_words))
    return whole.where(F.size("w") > 0).select("path", "day", "paragraph", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, most_words), " "))).alias("part", "text"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, value): each line of text files, numbered within its file."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("whole"))
    return files.select("path", F.posexplode(F.split("whole", "\r?\n")).alias("at", "value"))


def named_recordings(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Recordings named device_direction_yyyymmddThhmmss.wav that begin at ``start`` or later and before ``end``, with what the name says.

    Times are taken from the names while files are listed, so none out of the range is opened. A name of
    another form is no recording. place orders inputs before outputs, each by a hash of day and name: order by
    it, and limit, before content is selected, so that no sound is sorted or read in vain.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)
    name = F.col("_metadata.file_name")
    part = lambda i: F.regexp_extract(name, r"([^/_]+)_(input|output)_(\d{8}T\d{6})\.wav$", i)
    began = F.try_to_timestamp(part(3), F.lit("yyyyMMdd'T'HHmmss"))
    files = files.where(began.isNotNull())
    if start is not None:
        files = files.where(began >= F.lit(start).cast("timestamp"))
    if end is not None:
        files = files.where(began < F.lit(end).cast("timestamp"))
    place = F.concat(F.when(part(2) == "input", "0").otherwise("1"), F.sha2(F.concat(F.to_date(began).cast("string"), F.lit(":"), name), 256))
    return files.select("path", part(1).alias("device"), part(2).alias("direction"), began.alias("started_at"), place.alias("place"), "content")


def transcript_envelope(payload: Column) -> Column:
    """First channel and alternative of a nested API answer: text, words, mean and least confidence, speakers; null without words."""
    word = "struct<word: string, start: double, end: double, confidence: double, speaker: int>"
    parsed = F.from_json(payload, f"channels array<struct<alternatives: array<struct<transcript: string, words: array<{word}>>>>>")
    best = F.get(F.get(parsed["channels"], 0)["alternatives"], 0)
    sure = F.transform(best["words"], lambda x: x.confidence)
    mean = F.try_divide(F.aggregate(sure, F.lit(0.0), lambda s, x: s + x), F.size(sure))
    return F.when(F.size(best["words"]) > 0, F.struct(best["transcript"].alias("text"), best["words"].alias("words"), mean.alias("confidence_mean"), F.array_min(sure).alias("confidence_min"), F.array_sort(F.array_distinct(F.filter(F.transform(best["words"], lambda x: x.speaker), lambda x: x.isNotNull()))).alias("speaker_ids")))


def recent(rows: DataFrame, order: list[str], n: int, most: int = 10_000) -> DataFrame:
    """The newest n rows, clamped to 1 ... most, oldest first. order must tell rows apart."""
    n = max(1, min(n, most))
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def newest(rows: DataFrame, updated: str, key: str, n: int, source: str | None = None, most: int = 10_000) -> DataFrame:
    """The candidates of a search: the n rows last updated, newest first, clamped to 1 ... most, of one source or of all; ties by key."""
    if source is not None:
        rows = rows.where(F.col("source") == source)
    return rows.orderBy(F.desc_nulls_last(updated), key).limit(max(1, min(n, most)))


def tail_of_jsonl(spark: SparkSession, path: str, schema: str, n: int) -> DataFrame:
    """The records in the last n lines, in their order, files in the order of their paths.

    A line that is no JSON object, or whose fields don't convert, is left out, but counts as a line; so does a blank one.
    Every task keeps its own last n lines, so no file goes through one task.
    """
    lines = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"), "value")
    order = ["file_path", "file_block_start", "at"]  # within one part of a file numbers rise with lines
    last = lines.orderBy(*[F.desc(c) for c in order]).limit(max(0, n))
    known = T.StructType.fromDDL(schema).add("_broken", "string")
    told = F.from_json("value", known, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    # json_object_keys tells objects from other values, and fails on none.
    good = last.where(F.json_object_keys("value").isNotNull()).withColumn("r", told).where("r is not null and r._broken is null")
    return good.orderBy(*order).select("r.*").drop("_broken")


def table_or_empty(spark: SparkSession, name: str, schema: str, order: list[str]) -> DataFrame:
    """A table of the catalog in the given order; no rows if there is no such table."""
    if not spark.catalog.tableExists(name):
        return spark.createDataFrame([], schema)
    return spark.table(name).select(*T.StructType.fromDDL(schema).names).orderBy(*order)


def read_observations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Observations by the path's suffix: strict JSON lines (.jsonl), or Parquet (.parquet) of just these fields; anything else is an error."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    if not path.endswith(".parquet"):
        raise ValueError(f"neither .jsonl nor .parquet: {path}")
    found, known = spark.read.parquet(path), T.StructType.fromDDL(schema)
    if sorted((f.name, f.dataType.simpleString()) for f in found.schema) != sorted((f.name, f.dataType.simpleString()) for f in known):
        raise ValueError(f"{path} has {found.schema.simpleString()}, not {known.simpleString()}")
    return found.select(*known.names)
