"""Metadata of videos and playlists from JSON, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTS = "title string, duration double, chapters array<struct<title: string, start_time: double, end_time: double>>"
LIST = "title string, entries array<struct<id: string, title: string, duration: double>>"
#: Titles of entries that cannot be watched.
HIDDEN = ("", "[private video]", "[deleted video]")


def video_facts(df: DataFrame, json: str) -> DataFrame:
    """Title (default "Untitled video"), whole seconds, and chapters by start: those that end after they begin, with default titles."""
    f = F.from_json(json, FACTS)
    chapters = F.filter(F.coalesce(f["chapters"], F.expr(f"cast(array() as {FACTS.split('chapters ')[1]})")), lambda c: c["end_time"] > c["start_time"])
    parts = F.array_sort(F.transform(chapters, lambda c: F.struct(F.floor(c["start_time"]).alias("start"), F.floor(c["end_time"]).alias("end"), F.trim(F.coalesce(c["title"], F.lit(""))).alias("title"))))
    titled = F.transform(parts, lambda c, i: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.when(c["title"] == "", F.concat(F.lit("Part "), (i + 1).cast("string"))).otherwise(c["title"]).alias("title")))
    return df.withColumns({"title": F.coalesce(F.nullif(F.trim(f["title"]), F.lit("")), F.lit("Untitled video")), "duration": F.floor(f["duration"]), "chapters": titled})


def playlist_entries(df: DataFrame, json: str) -> DataFrame:
    """One row per entry with a valid id and a visible title, in order."""
    f = F.from_json(json, LIST)
    e = df.withColumn("_f", f).select(*df.columns, F.col("_f.title").alias("playlist"), F.posexplode(F.col("_f.entries")).alias("pos", "e"))
    return e.where(F.col("e.id").rlike("^[A-Za-z0-9_-]{11}$") & ~F.lower(F.coalesce("e.title", F.lit(""))).isin(*HIDDEN)).select(*df.columns, "playlist", "pos", F.col("e.id").alias("id"), F.col("e.title").alias("title"), F.floor("e.duration").alias("duration"))
