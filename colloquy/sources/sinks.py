"""Conversations written as JSON Lines, compact text, clean HTML and bundles.

A document of a conversation is one value, so its messages meet in one row; everything else stays spread.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import checkpoint, integrity, privacy
from colloquy.sources import formats


def json_string(c: Column) -> Column:
    """A text as a JSON string, non-ASCII kept."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def jsonl_rows(canon: DataFrame) -> DataFrame:
    """The line of each message; with conv_id as partition column this is the natural sink, as nothing is gathered."""
    return canon.select("conv_id", "idx", F.concat(F.lit('{"role": '), json_string(F.col("role")), F.lit(', "text": '), json_string(F.col("text")), F.lit("}")).alias("line"))


def in_order(canon: DataFrame, piece: Column, separator: str, name: str) -> DataFrame:
    """The pieces of each conversation joined in order."""
    parts = F.array_sort(F.collect_list(F.struct("idx", piece.alias("piece"))))
    return canon.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), separator).alias(name), F.count("*").alias("message_count"))


def jsonl(canon: DataFrame) -> DataFrame:
    return in_order(jsonl_rows(canon), F.col("line"), "\n", "jsonl")


def compact(canon: DataFrame, titles: DataFrame) -> DataFrame:
    """conv_id and the compact text; titles: conv_id, title."""
    body = in_order(canon, F.concat(F.lit("<<<"), F.upper("role"), F.lit(">>>\n"), T.escaped("norm"), F.lit("\n")), "\n", "body")
    title = F.when(F.coalesce("title", F.lit("")) == "", "(untitled)").otherwise(F.col("title"))
    head = F.concat(F.lit(f"{formats.COMPACT}\nTITLE: "), title, F.lit("\nMESSAGES: "), F.col("message_count").cast("string"), F.lit("\nPOLICY: user and assistant text in order\n\n"))
    return body.join(titles, "conv_id", "left").select("conv_id", F.concat(head, F.col("body")).alias("document"))


def clean_html(canon: DataFrame) -> DataFrame:
    """conv_id and a page with an article per message and the messages as embedded JSON, in which markup can't occur."""
    entity = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    safe = F.concat(F.lit('{"role": '), json_string(F.col("role")), F.lit(', "text": '), json_string(F.col("text")), F.lit("}"))
    for sign, escape in formats.MARKUP_ESCAPES.items():
        safe = F.replace(safe, F.lit(sign), F.lit(escape))
    article = F.concat(F.lit('<article data-role="'), F.col("role"), F.lit('"><pre>'), entity(F.col("text")), F.lit("</pre></article>"))
    parts = F.array_sort(F.collect_list(F.struct("idx", article.alias("article"), safe.alias("row"))))
    pages = canon.groupBy("conv_id").agg(parts.alias("parts")).select(
        "conv_id", F.array_join(F.transform("parts", lambda p: p["article"]), "\n").alias("articles"), F.array_join(F.transform("parts", lambda p: p["row"]), ", ").alias("payload")
    )
    page = F.concat(F.lit('<!doctype html>\n<html><head><meta charset="utf-8"></head><body>\n'), F.col("articles"), F.lit(f'\n<script type="application/json" id="{formats.CLEAN_ID}">{{"format": "{formats.CLEAN_FORMAT}", "title": null, "messages": ['), F.col("payload"), F.lit("]}</script>\n</body></html>\n"))
    return pages.select("conv_id", page.alias("document"))


def documents(canon: DataFrame, titles: DataFrame, created_at: str = "1970-01-01T00:00:00+00:00") -> DataFrame:
    """conv_id, path and content (binary) of the four artifacts of each conversation, for a writer of files."""
    gathered = canon.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("idx", "role", "text"))).alias("messages")).join(titles, "conv_id", "left").select("conv_id", "title", "messages")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, title, messages in zip(*(c.to_pylist() for c in batch.columns)):
                pairs = [(m["role"], m["text"]) for m in messages]
                out += [
                    (conv, f"{conv}.jsonl", formats.to_jsonl(pairs).encode()), (conv, f"{conv}.txt", formats.to_compact(pairs, title).encode()),
                    (conv, f"{conv}.html", formats.to_clean_html(pairs, title).encode()), (conv, f"{conv}.aicb", formats.to_bundle(pairs, title, "table", created_at)),
                ]
                if len(out) >= 400:
                    yield arrow(out)
                    out = []
            yield arrow(out)

    def arrow(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary()))], ["conv_id", "path", "content"])

    return gathered.mapInArrow(run, "conv_id long, path string, content binary")


def report_file(rows: DataFrame, suffix: str) -> DataFrame:
    """conv_id, path and content of one JSON object per row, its keys sorted and nulls kept."""
    fields = sorted(c for c in rows.columns if c != "conv_id")
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return rows.select("conv_id", F.concat(F.col("conv_id").cast("string"), F.lit(suffix)).alias("path"), F.concat(body, F.lit("\n")).cast("binary").alias("content"))


def text_file(rows: DataFrame, column: str, suffix: str) -> DataFrame:
    return rows.select("conv_id", F.concat(F.col("conv_id").cast("string"), F.lit(suffix)).alias("path"), F.col(column).cast("binary").alias("content"))


def standard_files(canon: DataFrame, titles: DataFrame) -> DataFrame:
    """The standard set of each conversation: clean HTML, compact text, JSON Lines and the two reports, with its bundle."""
    integrity_file = report_file(integrity.report(canon), ".integrity.json")
    return documents(canon, titles).unionByName(integrity_file).unionByName(report_file(privacy.counts(canon), ".privacy.json"))


def redaction_files(canon: DataFrame) -> DataFrame:
    """The redacted conversation of each conversation in three formats, under a title that says nothing, and the review."""
    rows = privacy.redacted(canon).select("conv_id", "idx", "role", F.col("redacted").alias("text"))
    title = rows.select("conv_id", F.lit("Redacted conversation").alias("title")).distinct()
    files = documents(rows, title).where("path not like '%.aicb'").withColumn("path", F.regexp_replace("path", r"\.(\w+)$", ".redacted.$1"))
    return files.unionByName(report_file(privacy.review(canon), ".redaction-report.json"))


def checkpoint_files(canon: DataFrame, picked: DataFrame) -> DataFrame:
    """The rendered checkpoint and its report; picked: the result of ``checkpoint.selected``."""
    return text_file(checkpoint.documents(canon, picked), "document", ".checkpoint.md").unionByName(report_file(picked.drop("selected"), ".checkpoint.json"))


def compile_files(final: DataFrame, notes: DataFrame) -> DataFrame:
    """The final text, the notes in their order and the report of each conversation."""
    parts = F.array_sort(F.collect_list(F.struct("part", "text")))
    note = lambda p, i: F.concat(F.lit("# Note "), (i + 1).cast("string"), F.lit("\n\n"), p["text"])
    listed = notes.groupBy("conv_id").agg(F.concat(F.array_join(F.transform(parts, note), "\n\n"), F.lit("\n")).alias("notes"))
    return text_file(final, "text", ".prompt.md").unionByName(text_file(listed, "notes", ".notes.md")).unionByName(report_file(final.drop("text"), ".compile-report.json"))


def write_files(files: DataFrame, folder: str) -> None:
    """Each row's content as a file of its own below a folder that all executors share and mount; safe to run again."""
    import os

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                place = os.path.join(folder, path)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(f"{place}.part", "wb") as f:
                    f.write(content)
                os.replace(f"{place}.part", place)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.select("path", "content").mapInArrow(put, "n long").agg(F.sum("n")).collect()
