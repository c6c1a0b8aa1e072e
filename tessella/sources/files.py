"""Readers of files and texts: kinds by leading bytes, visible HTML, Word documents, recognised words, event frames."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_SPACE = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
UNSEEN = {"script", "style", "noscript", "nav", "header", "footer", "title", "head"}
PLACEHOLDER_CHARS = 200


def mime_type(content: Column) -> Column:
    """The kind of a file by its first bytes."""
    starts = lambda *codes: F.substring(content, 1, len(codes)) == F.lit(bytes(codes))
    head = F.lower(F.regexp_replace(F.decode(F.substring(content, 1, 512), "ISO-8859-1"), r"^\s+", ""))
    return (
        F.when(starts(*b"%PDF-"), "application/pdf")
        .when(starts(*b"PK\x03\x04"), F.when(F.contains(content, F.lit(b"word/document.xml")), "application/vnd.openxmlformats-officedocument.wordprocessingml.document").otherwise("application/zip"))
        .when(starts(*b"{\\rtf"), "application/rtf")
        .when(starts(0xD0, 0xCF, 0x11, 0xE0, 0xA1, 0xB1, 0x1A, 0xE1), "application/msword")
        .when(head.startswith("<!doctype html") | head.startswith("<html"), "text/html")
        .otherwise("application/octet-stream")
    )


class VisibleText(HTMLParser):
    """Gathers text outside elements that aren't shown."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in UNSEEN

    def handle_endtag(self, tag: str) -> None:
        self.depth -= tag in UNSEEN and self.depth > 0

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.parts.append(data)


def visible_text(html: str | None) -> str:
    parser = VisibleText()
    parser.feed(html or "")
    parser.close()
    return " ".join(" ".join(parser.parts).split())


def docx_text(content: bytes | None) -> str | None:
    """Paragraphs, those in tables too, a blank line apart; None if the file isn't a readable Word document."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
            root = ElementTree.fromstring(archive.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    marks = {f"{WORD_SPACE}tab": "\t", f"{WORD_SPACE}br": "\n", f"{WORD_SPACE}cr": "\n"}
    lines = ("".join(x.text or "" if x.tag == f"{WORD_SPACE}t" else marks.get(x.tag, "") for x in p.iter()) for p in root.iter(f"{WORD_SPACE}p"))
    return "\n\n".join(x.strip() for x in lines if x.strip())


def mapped(function: Callable, column: str, name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([function(x) for x in batch.column(column).to_pylist()], pa.string())], [*batch.schema.names, name])

    return run


def with_text(rows: DataFrame, function: Callable, column: str, name: str) -> DataFrame:
    """Adds a string column that a reader makes from one column, in the tasks that hold the rows."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(mapped(function, column, name), f"{fields}, `{name}` string")


def recognised_text(rows: DataFrame, key: str, tsv: str) -> DataFrame:
    """(key, text, confidence) from a column of recognised words as tab-separated lines with a header.

    Words of level 5 make lines, lines paragraphs, paragraphs blocks; the mean confidence has two decimals.
    """
    lines = rows.select(key, F.explode(F.split(tsv, "\n")).alias("line")).select(key, F.split("line", "\t").alias("c")).where((F.size("c") >= 12) & (F.get("c", 0) == "5"))
    part = lambda i: F.col("c")[i].cast("int")
    words = lines.select(key, part(2).alias("block"), part(3).alias("par"), part(4).alias("line"), part(5).alias("word"), F.col("c")[10].cast("double").alias("conf"), F.trim(F.col("c")[11]).alias("text")).where("text <> ''")
    ordered = lambda order, value, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), sep)
    by_line = words.groupBy(key, "block", "par", "line").agg(ordered("word", "text", " ").alias("text"), F.sum("conf").alias("conf"), F.count("*").alias("n"))
    by_par = by_line.groupBy(key, "block", "par").agg(ordered("line", "text", "\n").alias("text"), F.sum("conf").alias("conf"), F.sum("n").alias("n"))
    by_block = by_par.groupBy(key, "block").agg(ordered("par", "text", "\n\n").alias("text"), F.sum("conf").alias("conf"), F.sum("n").alias("n"))
    return by_block.groupBy(key).agg(ordered("block", "text", "\n\n").alias("text"), F.round(F.sum("conf") / F.sum("n"), 2).alias("confidence"))


def event_frames(stream: Column) -> Column:
    """array<struct<event, data>> from text in the server-sent form; comments go, data lines are joined."""
    frames = F.filter(F.split(F.regexp_replace(stream, "\r\n?", "\n"), "\n\n+"), lambda f: F.trim(f) != "")

    def one(frame: Column) -> Column:
        lines = F.filter(F.split(frame, "\n"), lambda x: ~x.startswith(":"))
        value = lambda field: F.transform(F.filter(lines, lambda x: x.startswith(f"{field}:")), lambda x: F.regexp_replace(x, f"^{field}: ?", ""))
        return F.struct(F.coalesce(F.element_at(F.concat(F.array(F.lit("message")), value("event")), -1), F.lit("message")).alias("event"), F.array_join(value("data"), "\n").alias("data"))

    return F.filter(F.transform(frames, one), lambda f: f["data"] != "")


def json_lines(rows: DataFrame, key: str) -> DataFrame:
    """(key, line, reads_back): each row as a line of JSON without its nulls, and whether that line gives the row again."""
    row = F.struct(*rows.columns)
    line = F.to_json(row, {"ignoreNullFields": "true"})
    again = F.from_json(line, rows.schema, {"mode": "FAILFAST", "maxStringLen": str(2**31 - 1)})
    return rows.select(key, line.alias("line"), F.coalesce(again == row, F.lit(False)).alias("reads_back"))


def write_lines(rows: DataFrame, key: str, path: str) -> None:
    """Writes json_lines as text, only if all of them read back; the folder appears as a whole or not at all."""
    spark, draft = rows.sparkSession, f"{path}.draft"
    made = json_lines(rows, key)
    if not made.where("not reads_back").isEmpty():
        raise ValueError("some rows don't read back from their lines")
    made.select("line").write.mode("overwrite").text(draft)
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (draft, path))
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(new, True)
    if not files.rename(old, new):
        raise OSError(f"{draft} can't become {path}")
