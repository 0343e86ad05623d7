"""File sources: diarization turns, JSON with key aliases, JSON inside ZIP archives, transcripts beside audio."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import checkpointed


def rttm_turns(spark: SparkSession, path: str) -> DataFrame:
    """SPEAKER lines as turns; end is start plus duration; turn_idx follows the start within a file."""
    from pyspark.sql import Window

    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.col("value").startswith("SPEAKER ")).select(parts.alias("p"))
    turns = lines.select(F.col("p")[1].alias("session"), F.col("p")[7].alias("speaker"), F.col("p")[3].cast("double").alias("start_sec"), (F.col("p")[3].cast("double") + F.col("p")[4].cast("double")).alias("end_sec"))
    return turns.withColumn("turn_idx", F.row_number().over(Window.partitionBy("session").orderBy("start_sec", "end_sec", "speaker")) - 1)


ALIASES = ("text", "sentence", "script", "utterance", "content", "transcription", "발화", "원문")  # fixed values, in their order


def found_texts(rows: DataFrame, aliases=ALIASES) -> DataFrame:
    """rows(file, value), JSON of any shape -> (file, text): an object gives the first of its aliases that is a filled string, and nothing below it is looked at;
    else all its values are looked through, as are lists; a bare string of more than one character is a text. What is no JSON gives no row.

    One step down all documents is one pass; there are as many as the deepest document has levels. Each level is checkpointed.
    """
    kind = lambda v: F.schema_of_variant(v)

    def alias(v: Column, name: str) -> Column:
        inner = F.try_variant_get(v, f"$['{name}']", "variant")
        text = F.trim(F.regexp_replace(F.try_variant_get(v, f"$['{name}']", "string"), r"(?U)^\s+|\s+$", ""))
        return F.when((kind(inner) == "STRING") & (text != ""), text)

    level = rows.select("file", F.try_parse_json("value").alias("v")).where("v is not null")
    out = None
    while True:
        is_object = F.startswith(kind(F.col("v")), F.lit("OBJECT"))
        bare = F.when(kind(F.col("v")) == "STRING", F.try_variant_get("v", "$", "string"))
        named = F.when(is_object, F.coalesce(*(alias(F.col("v"), a) for a in aliases)))
        level = checkpointed(level.select("file", "v", F.coalesce(F.when(F.length(bare) > 1, bare), named).alias("text"), (is_object | F.startswith(kind(F.col("v")), F.lit("ARRAY"))).alias("deeper")))
        told = level.where("text is not null").select("file", "text")
        out = told if out is None else out.unionByName(told)
        down = level.where("text is null and deeper")
        if down.isEmpty():
            return out
        level = down.lateralJoin(down.sparkSession.tvf.variant_explode(F.col("v").outer())).select("file", F.col("value").alias("v")).where("v is not null")


def json_texts(spark: SparkSession, path: str, aliases=ALIASES) -> DataFrame:
    """Texts in JSON files of any shape, as found_texts()."""
    return found_texts(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"), aliases)


LABEL_FOLDERS = ("label", "labels", "txt", "json", "transcript")  # fixed values, in their order


def transcripts_beside(audio: DataFrame, files: DataFrame) -> DataFrame:
    """audio(path), files(path, value): each audio file's transcript: the first filled one of the JSON and the text file of its name in its folder, then
    of those in the label folders beside it. JSON: the first text in it. (path, text), an empty text where there is none."""
    folder, stem = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_extract("path", r"([^/]*?)\.[^./]*$", 1)
    top = F.regexp_replace(folder, r"/[^/]*$", "")
    places = F.array(folder, *(F.concat(top, F.lit(f"/{name}")) for name in LABEL_FOLDERS))
    wanted = audio.select("path", stem.alias("stem"), F.posexplode(places).alias("rank", "folder"))
    kind = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    given = files.select(folder.alias("folder"), stem.alias("stem"), F.col("path").alias("file"), kind.alias("kind"), "value").where(F.col("kind").isin("json", "txt"))
    met = checkpointed(wanted.join(given, ["folder", "stem"]))
    read = found_texts(met.where("kind = 'json'").select("file", "value").distinct()).groupBy("file").agg(F.min("text").alias("read"))
    text = F.trim(F.regexp_replace(F.when(F.col("kind") == "json", F.col("read")).otherwise(F.col("value")), r"(?U)^\s+|\s+$", ""))
    first = met.join(read, "file", "left").withColumn("text", text).where("text <> ''").groupBy("path").agg(F.min(F.struct("rank", "kind", "text")).alias("f"))
    return audio.select("path").join(first, "path", "left").select("path", F.coalesce("f.text", F.lit("")).alias("text"))


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, content in zip(b["path"], b["content"]):
            try:
                archive = zipfile.ZipFile(io.BytesIO(content))
            except zipfile.BadZipFile:
                continue
            for name in archive.namelist():
                if name.endswith(".json"):
                    try:
                        text = archive.read(name).decode("utf-8-sig")
                        json.loads(text)
                    except (ValueError, UnicodeDecodeError, zipfile.BadZipFile, RuntimeError):
                        continue  # bad members are left out
                    rows.append((path, name, text))
        yield pd.DataFrame(rows, columns=["path", "member", "value"])


def zipped_json(spark: SparkSession, path: str) -> DataFrame:
    """Valid JSON members of ZIP archives, as text."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_members, "path string, member string, value string")


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """Audio files with their extension and the speaker that the first folder names."""
    files = spark.read.format("binaryFile").load(path)
    parts = F.split(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "/")
    return files.select("path", "length", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"), F.element_at(parts, -2).alias("speaker"), "content")


def audio_statistics(lines: DataFrame) -> DataFrame:
    """lines(file, line_no, value) of an audio tool's report -> rms_db, peak_db (-60 without), silence_sec (1.0 without)."""
    number = lambda p: F.regexp_extract("value", p, 1).try_cast("double")
    rows = lines.select("file", "line_no", number(r"RMS level dB:\s*(-?[0-9.]+)").alias("rms"), number(r"Peak level dB:\s*(-?[0-9.]+)").alias("peak"), number(r"silence_duration:\s*([0-9.]+)").alias("silence"))
    return rows.groupBy("file").agg(F.coalesce(F.max_by("rms", F.when(F.col("rms").isNotNull(), F.col("line_no"))), F.lit(-60.0)).alias("rms_db"), F.coalesce(F.max_by("peak", F.when(F.col("peak").isNotNull(), F.col("line_no"))), F.lit(-60.0)).alias("peak_db"), F.coalesce(F.sum("silence"), F.lit(1.0)).alias("silence_sec"))
