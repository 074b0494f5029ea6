"""Incident and runbook text to chunks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_TAGS, RUNBOOK_KEYWORDS
from ..functions.columns import stable_id, strip

SECTION_DELIMITER = "\n### "
CONTENT_CHARS = 1200


def section_chunks(
    docs: DataFrame,
    delimiter: str = SECTION_DELIMITER,
    prefix_chars: int = CONTENT_CHARS,
    title: str = "preamble",
) -> DataFrame:
    """One row per section of (runbook_id, content).

    The text before the first delimiter is the section ``overview``; the others are named by
    their first line and carry the title in front. The title is the whole text before the first
    delimiter, or with ``title="first_line"`` its first line. ``content`` is whole; a store that
    keeps the beginning only takes ``content_prefix``.
    """
    kept = [c for c in docs.columns if c != "content"]
    preamble = strip(F.col("sections")[0])
    if title == "first_line":
        preamble = strip(F.substring_index(preamble, "\n", 1))
    pattern = re.escape(delimiter).replace("\\\n", "\\n")
    # The title is worked out per document, before the sections become rows.
    titled = docs.select(*kept, F.split("content", pattern, -1).alias("sections")).withColumn(
        "title", F.regexp_replace(preamble, "^[# ]+", "")
    )
    # The outer form adds no filter on the split, which would split every text again.
    exploded = titled.select(*kept, "title", F.posexplode_outer("sections").alias("section_no", "text"))
    parts = exploded.filter("section_no is not null")
    later = F.col("section_no") > 0
    body = F.when(later, F.concat(F.col("title"), F.lit(delimiter), F.col("text"))).otherwise(F.col("text"))
    name = F.when(later, strip(F.substring_index("text", "\n", 1))).otherwise("overview")
    return parts.select(
        *kept,
        stable_id(F.concat_ws("_", "runbook_id", F.col("section_no").cast("string"))).alias("id"),
        "section_no",
        "title",
        name.alias("section"),
        body.alias("content"),
        F.substring(body, 1, prefix_chars).alias("content_prefix"),
    )


def keyword_tags(
    docs: DataFrame,
    keywords: Sequence[str] = RUNBOOK_KEYWORDS,
    default: Sequence[str] = DEFAULT_TAGS,
) -> DataFrame:
    """Add ``lag_classifications``: the keywords that occur in each document, as they are or in
    lower case with spaces; the default where none does. Each text is lowered once."""
    lowered = docs.withColumn("_lower", F.lower("content"))
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col("_lower").contains(k.lower().replace("_", " ")) | F.col("content").contains(k), k
                )
                for k in keywords
            ]
        )
    )
    tagged = lowered.select(*docs.columns, found.alias("lag_classifications"))
    return tagged.withColumn(
        "lag_classifications",
        F.when(F.size("lag_classifications") > 0, F.col("lag_classifications")).otherwise(
            F.array(*[F.lit(d) for d in default])
        ),
    )


def runbook_chunks(docs: DataFrame, prefix_chars: int = CONTENT_CHARS) -> DataFrame:
    """Sections of tagged runbooks, ready for embedding."""
    return section_chunks(keyword_tags(docs), prefix_chars=prefix_chars)


def incident_chunks(incidents: DataFrame, prefix_chars: int = CONTENT_CHARS) -> DataFrame:
    """Up to three chunks per incident: cluster state, symptoms, resolution; blank ones are
    left out. The cluster state is JSON text. An incident without an id is named by its hash."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    state = F.coalesce("cluster_state_at_onset", F.lit("{}"))
    chunk = F.explode(
        F.array(
            F.struct(
                F.lit("cluster_state").alias("type"),
                F.concat(F.lit("Cluster state: "), state).alias("text"),
            ),
            F.struct(F.lit("symptoms").alias("type"), text("symptoms_description").alias("text")),
            F.struct(
                F.lit("resolution").alias("type"),
                F.concat(
                    F.lit("Resolution: "), text("resolution_type"), F.lit(". "), text("resolution_notes")
                ).alias("text"),
            ),
        )
    )
    named = incidents.withColumn(
        "incident_id", F.coalesce("incident_id", F.md5(F.to_json(F.struct(*incidents.columns))))
    )
    return (
        named.withColumn("chunk", chunk)
        .filter(strip(F.col("chunk.text")) != "")
        .select(
            stable_id(F.concat_ws("_", "incident_id", "chunk.type")).alias("id"),
            "incident_id",
            F.col("chunk.type").alias("chunk_type"),
            *[
                text(c).alias(c)
                for c in ("consumer_group", "topic", "lag_classification", "resolution_type")
            ],
            F.coalesce("time_to_resolution_minutes", F.lit(0)).alias("time_to_resolution_minutes"),
            text("severity").alias("severity"),
            text("summary").alias("summary"),
            F.col("chunk.text").alias("content"),
            F.substring("chunk.text", 1, prefix_chars).alias("content_prefix"),
        )
    )


def incident_coverage(incidents: DataFrame) -> DataFrame:
    """What the incident collection covers, per lag class."""
    return incidents.groupBy("lag_classification").agg(
        F.countDistinct("incident_id").alias("incidents"),
        F.array_join(F.sort_array(F.collect_set("resolution_type")), ",").alias("resolution_types"),
        F.min("time_to_resolution_minutes").alias("fastest_minutes"),
        F.max("time_to_resolution_minutes").alias("slowest_minutes"),
    )
