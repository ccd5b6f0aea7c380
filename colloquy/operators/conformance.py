"""Checks of canonical conversations; a report holds verdicts, never text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.common import python_partitions
from colloquy.functions import text as T
from colloquy.operators import canonical, probes
from colloquy.sources import formats

KIND = r"^[a-z][a-z0-9_-]{0,63}\z"
KIND_TEXT = re.compile(r"[a-z][a-z0-9_-]{0,63}")
# Names of the checks, in order (fixed values).
STRUCTURAL = ["message_stream_nonempty", "source_kind_present", "source_kind_identifier", "canonical_roles", "contiguous_indices", "nonempty_text"]


def newest_headers(headers: DataFrame) -> DataFrame:
    """One header per conversation: the latest imported; ties go by the largest kind."""
    return headers.where("conv_id is not null").groupBy("conv_id").agg(F.max(F.struct("imported_at", "source_kind")).alias("h")).select("conv_id", F.coalesce("h.source_kind", F.lit("")).alias("source_kind"))


def structural(messages: DataFrame, headers: DataFrame) -> DataFrame:
    """The structural checks of each conversation that has a header, on its messages as delivered.

    Texts are judged where they are read and never moved; indices are contiguous if each occurs once and they end at their number.
    """
    ok = F.coalesce(F.col("role").isin(*T.ROLES), F.lit(False)).alias("role_ok")
    filled = (T.normalized(F.coalesce("text", F.lit(""))) != "").alias("filled")
    rows = messages.where("conv_id is not null").select("conv_id", "msg_id", "idx", ok, filled).distinct()
    places = rows.groupBy("conv_id", "idx").agg(F.count("*").alias("n"), F.bool_and("role_ok").alias("role_ok"), F.bool_and("filled").alias("filled"))
    whole = (F.count("idx") == F.count("*")) & (F.max("n") == 1) & (F.min("idx") == 0) & (F.max("idx") == F.count("*") - 1)
    found = places.groupBy("conv_id").agg(F.bool_and("role_ok").alias("canonical_roles"), F.coalesce(whole, F.lit(False)).alias("contiguous_indices"), F.bool_and("filled").alias("nonempty_text"), F.lit(True).alias("some"))
    kind = F.regexp_replace("source_kind", rf"^{T.WS}+|{T.WS}+\z", "")
    joined = newest_headers(headers).join(found, "conv_id", "left")
    checks = {
        "message_stream_nonempty": F.coalesce("some", F.lit(False)), "source_kind_present": kind != "", "source_kind_identifier": F.col("source_kind").rlike(KIND),
        "canonical_roles": F.coalesce("canonical_roles", F.lit(True)), "contiguous_indices": F.coalesce("contiguous_indices", F.lit(True)), "nonempty_text": F.coalesce("nonempty_text", F.lit(True)),
    }
    out = joined.select("conv_id", F.when(kind == "", "").when(F.col("source_kind").rlike(KIND), F.col("source_kind")).otherwise("<invalid>").alias("source_kind"), *[checks[n].alias(n) for n in STRUCTURAL])
    ok = F.col(STRUCTURAL[0])
    for n in STRUCTURAL[1:]:
        ok = ok & F.col(n)
    return out.withColumn("conforms", ok).withColumn("violations", F.array_compact(F.array(*[F.when(~F.col(n), F.lit(n)) for n in STRUCTURAL])))


STRUCTURAL_SQL = f"""
WITH heads AS (
  SELECT conv_id, coalesce(source_kind, '') AS source_kind FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY imported_at DESC NULLS LAST, source_kind DESC NULLS LAST) AS n FROM conversation_header WHERE conv_id IS NOT NULL) WHERE n = 1
), msgs AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY idx, msg_id) - 1 AS place FROM (SELECT DISTINCT conv_id, msg_id, idx, role, text FROM canonical_messages WHERE conv_id IS NOT NULL)),
found AS (
  SELECT conv_id, bool_and(coalesce(role IN ('user', 'assistant'), false)) AS canonical_roles, bool_and(coalesce(idx = place, false)) AS contiguous_indices,
         bool_and({T.normalized_sql("coalesce(text, '')")} <> '') AS nonempty_text FROM msgs GROUP BY conv_id
), checked AS (
  SELECT h.conv_id, CASE WHEN regexp_replace(source_kind, '^{T.WS_RE2}+|{T.WS_RE2}+\\z', '', 'g') = '' THEN '' WHEN regexp_matches(source_kind, '{KIND}') THEN source_kind ELSE '<invalid>' END AS source_kind,
         f.conv_id IS NOT NULL AS message_stream_nonempty, regexp_replace(source_kind, '^{T.WS_RE2}+|{T.WS_RE2}+\\z', '', 'g') <> '' AS source_kind_present, regexp_matches(source_kind, '{KIND}') AS source_kind_identifier,
         coalesce(canonical_roles, true) AS canonical_roles, coalesce(contiguous_indices, true) AS contiguous_indices, coalesce(nonempty_text, true) AS nonempty_text
  FROM heads h LEFT JOIN found f USING (conv_id)
)
SELECT *, message_stream_nonempty AND source_kind_present AND source_kind_identifier AND canonical_roles AND contiguous_indices AND nonempty_text AS conforms,
  list_filter([{", ".join(f"CASE WHEN NOT {n} THEN '{n}' END" for n in STRUCTURAL)}], lambda x: x IS NOT NULL) AS violations FROM checked
"""


# The round trips that a conversation must survive, in order (fixed names).
ROUND_TRIPS = {"roundtrip_clean_html": "clean_html", "roundtrip_compact_txt": "compact", "roundtrip_jsonl": "jsonl"}


def survives(form: str, role: str | None, text: str | None, title: str | None) -> bool:
    """Whether a message, alone in a conversation, is the same after it has been written and read in a format."""
    try:
        written = getattr(formats, f"to_{form}")([(role, text)], title)
        (back,) = getattr(formats, form)(formats.LINE_ENDS.sub("\n", written)).messages
    except Exception:  # whatever a writer or reader objects to; reports hold no content
        return False
    return back[0] == role and T.normalized_text(back[1]) == T.normalized_text(text)


def round_trips(rows: DataFrame) -> DataFrame:
    """conv_id and one boolean per round trip of each row; rows: conv_id, role, text, title.

    Formats write messages one behind the other, and reading splits them where they were joined, so a conversation survives if each of its messages does. No
    conversation is gathered.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, roles, texts, titles = (c.to_pylist() for c in batch.columns)
            checks = [pa.array([survives(form, *m) for m in zip(roles, texts, titles)], pa.bool_()) for form in ROUND_TRIPS.values()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *checks], ["conv_id", *ROUND_TRIPS])

    return python_partitions(rows.select("conv_id", "role", "text", "title")).mapInArrow(run, "conv_id long, " + ", ".join(f"{n} boolean" for n in ROUND_TRIPS))


def report(messages: DataFrame, headers: DataFrame, expected: DataFrame | None = None, forbidden: list[str] | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """All checks of each conversation that has a header, in order, and the violated ones.

    expected: conv_id, idx, role, text as a conversation should be; forbidden: values that must occur neither in a text, nor in a header's columns, nor in the
    nested keys and values of its metadata (conv_id, metadata as JSON). Both checks are there only if asked for.
    """
    base = structural(messages, headers).drop("conforms", "violations")
    own = messages.where("conv_id is not null")
    heads = headers.where("conv_id is not null")
    sides = own.select("conv_id", "msg_id", "role").distinct().groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"))
    base = base.join(sides, "conv_id", "left").withColumn("integrity_consistent", ~F.col("canonical_roles") | (F.coalesce("n", F.lit(0)) == F.coalesce(F.col("users") + F.col("assistants"), F.lit(0)))).drop("n", "users", "assistants")
    checks = [*STRUCTURAL, "integrity_consistent"]
    if expected is not None:
        want = expected.select("conv_id", "idx", T.message_hash("role", T.normalized("text")).alias("want"))
        got = own.select("conv_id", "idx", T.message_hash(F.coalesce("role", F.lit("")), T.normalized(F.coalesce("text", F.lit("")))).alias("got")).distinct()
        same = got.join(want, ["conv_id", "idx"], "full").groupBy("conv_id").agg(F.bool_and(F.col("got").eqNullSafe(F.col("want"))).alias("expected_messages"))
        base = base.join(same, "conv_id", "left").fillna(True, ["expected_messages"])
        checks.append("expected_messages")
    if wanted := [v for v in forbidden or [] if v]:
        hit = lambda c: F.coalesce(reduce(or_, (F.contains(F.col(c), F.lit(v)) for v in wanted)), F.lit(False))
        found = [own.select("conv_id", hit("text").alias("found"))]
        found += [heads.select("conv_id", hit(c).alias("found")) for c in ("title", "source_kind", "locator", "fingerprint") if c in headers.columns]
        if metadata is not None:
            found.append(probes.deep_contains(metadata.where("conv_id is not null"), "conv_id", "metadata", wanted))
        any_ = reduce(DataFrame.unionByName, found).groupBy("conv_id").agg((~F.bool_or("found")).alias("forbidden_values_absent"))
        base = base.join(any_, "conv_id", "left").fillna(True, ["forbidden_values_absent"])
        checks.append("forbidden_values_absent")
    trips = round_trips(own.select("conv_id", "role", "text", F.lit(None).cast("string").alias("title")))
    if "title" in headers.columns:  # a title stands before the messages and must not be read as one
        trips = trips.unionByName(round_trips(heads.select("conv_id", F.lit("user").alias("role"), F.lit("x").alias("text"), "title").distinct()))
    trips = trips.groupBy("conv_id").agg(*[F.bool_and(n).alias(n) for n in ROUND_TRIPS])
    base = base.join(trips, "conv_id", "left").fillna(True, list(ROUND_TRIPS))
    checks += ROUND_TRIPS
    broken = F.array_compact(F.array(*[F.when(~F.col(n), F.lit(n)) for n in checks]))
    return base.select("conv_id", "source_kind", *checks, broken.alias("violations")).withColumn("conforms", F.size("violations") == 0)


def containing(messages: DataFrame, forbidden: list[str]) -> DataFrame:
    """Per conversation, whether any of the forbidden values occurs in a text."""
    hit = F.lit(False)
    for value in forbidden:
        hit = hit | F.contains(F.coalesce("text", F.lit("")), F.lit(value))
    return canonical.delivered_once(messages).groupBy("conv_id").agg((~F.bool_or(hit)).alias("forbidden_values_absent"))
