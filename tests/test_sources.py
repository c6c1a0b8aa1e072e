"""Readers on files made here."""

import io
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.sources import files, sqlite


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"


def test_docx():
    body = P.format("One") + "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p>" + "<w:tbl><w:tr><w:tc>" + P.format("cell") + "</w:tc></w:tr></w:tbl>" + "<w:p/>"
    assert files.docx_text(docx(body)) == "One\n\na\tb\n\ncell"
    assert files.docx_text(b"no") is None and files.docx_text(None) is None


@pytest.mark.parametrize("content, kind", [(b"%PDF-1.7", "application/pdf"), (b"{\\rtf1", "application/rtf"), (b"\n <!DOCTYPE HTML>", "text/html"), (b"x", "application/octet-stream"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "application/msword")])
def test_mime(spark, content, kind):
    assert spark.createDataFrame([(bytearray(content),)], "c binary").select(files.mime_type(F.col("c")).alias("m")).first()["m"] == kind


def test_docx_mime(spark):
    assert "wordprocessingml" in spark.createDataFrame([(bytearray(docx(P.format("x"))),)], "c binary").select(files.mime_type(F.col("c")).alias("m")).first()["m"]


def test_visible_text():
    assert files.visible_text("<head><title>t</title></head><nav>menu</nav><p>A &amp;  b</p><script>x</script>") == "A & b"
    assert files.visible_text(None) == ""


def test_recognised_words(spark):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    rows = [(1, 1, 1, 2, 90, "b"), (1, 1, 1, 1, 80, "a"), (1, 1, 2, 1, 70, "c"), (1, 2, 1, 1, 60, "d"), (2, 1, 1, 1, 51, "e"), (2, 1, 1, 2, 50, " ")]
    tsv = "\n".join([head, "4\t1\t1\t1\t1\t0\t0\t0\t0\t0\t-1\t", *(f"5\t1\t{b}\t{p}\t{n}\t{w}\t0\t0\t0\t0\t{c}\t{t}" for b, p, n, w, c, t in rows)])
    got = files.recognised_text(spark.createDataFrame([(1, tsv)], "k long, tsv string"), "k", "tsv").first()
    assert (got["text"], got["confidence"]) == ("a b\nc\n\nd\n\ne", 70.2)


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("create table judgments (url text, citation text, n integer)")
        db.executemany("insert into judgments values (?, ?, ?)", [(f"u{i}", None if i == 3 else f"c{i}", i) for i in range(25)])
    sqlite.register(spark)
    read = lambda **o: spark.read.format("sqlite").options(path=path, table="judgments", required="url,citation", **o).load()
    rows = read(rows_per_partition="10").orderBy("row_number").collect()
    assert [r.row_number for r in rows] == list(range(1, 26)) and rows[3].citation is None and rows[4].n == "4"
    assert read(limit="7").count() == 7
    with pytest.raises(Exception, match="missing"):
        spark.read.format("sqlite").options(path=path, table="judgments", required="other").load().count()


def test_event_frames(spark):
    text = ":c\r\nevent: stage\r\ndata: 1\r\n\r\ndata: a\ndata: b\n\nevent: empty\n\n"
    got = spark.createDataFrame([(text,)], "s string").select(files.event_frames(F.col("s")).alias("f")).first()["f"]
    assert [tuple(x) for x in got] == [("stage", "1"), ("message", "a\nb")]


def test_lines_are_written_whole_or_not_at_all(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\nb", None), (2, None, 2.5)], "id long, text string, score double")
    files.write_lines(rows, "id", str(tmp_path / "out"))
    files.write_lines(rows, "id", str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"id":1,"text":"a\\nb"}', '{"id":2,"score":2.5}']
    assert sorted(spark.read.schema(rows.schema).json(str(tmp_path / "out")).collect()) == sorted(rows.collect()) and not (tmp_path / "out.draft").exists()


def test_rows_of_a_table_with_gaps_in_its_ids(spark, tmp_path):
    import sqlite3

    path = tmp_path / "gaps.db"
    with sqlite3.connect(path) as db:
        db.execute("create table t (a integer, b text)")
        db.executemany("insert into t values (?, ?)", [(i, f"b{i}") for i in range(50)])
        db.execute("delete from t where a % 7 = 3 or a between 20 and 29")
    held = [i for i in range(50) if i % 7 != 3 and not 20 <= i <= 29]
    sqlite.register(spark)
    for limit in (-1, 11):
        read = spark.read.format("sqlite").options(path=str(path), table="t", rows_per_partition=4, limit=limit).load()
        want = held if limit < 0 else held[:limit]
        assert [(r.row_number, r.a) for r in read.orderBy("row_number").collect()] == [(k + 1, str(i)) for k, i in enumerate(want)]


def numbers(path, rows, name="t"):
    with sqlite3_(path) as db:
        db.execute(f'create table if not exists "{name}" (a, b)')
        db.executemany(f'insert into "{name}" values (?, ?)', rows)


def sqlite3_(path):
    import sqlite3

    return sqlite3.connect(path)


def test_sqlite_filters_reach_the_file(spark, tmp_path):
    from pyspark.sql import datasource as D

    path = str(tmp_path / "f.sqlite")
    numbers(path, [(i, f"k{i % 5}") for i in range(100)] + [(1.5, None), (b"x", "k1")])
    sqlite.register(spark)
    read = lambda: spark.read.format("sqlite").options(path=path, table="t", rows_per_partition=10).load()
    whole = [tuple(r) for r in read().orderBy("row_number").collect()]
    for condition, keep in [("b = 'k1'", lambda r: r[2] == "k1"), ("a = '7'", lambda r: r[1] == "7"), ("a = '1.5'", lambda r: r[1] == "1.5"), ("b in ('k1', 'k2') and row_number between 20 and 60", lambda r: r[2] in ("k1", "k2") and 20 <= r[0] <= 60), ("b like 'k%' and a is not null", lambda r: (r[2] or "").startswith("k")), ("b is null", lambda r: r[2] is None), ("row_number = 3", lambda r: r[0] == 3), ("row_number < 0", lambda r: False)]:
        assert [tuple(r) for r in read().where(condition).orderBy("row_number").collect()] == [r for r in whole if keep(r)], condition
    # Fewer rows leave the reader, and fewer partitions are read.
    reader = sqlite.SqliteReader({"path": path, "table": "t", "rows_per_partition": "10"}, ["a", "b"])
    assert len(list(reader.pushFilters([D.EqualTo(("b",), "k1"), D.GreaterThan(("row_number",), 80)]))) == 2
    parts = reader.partitions()
    assert len(parts) == 3 and sum(len(list(reader.read(p))) for p in parts) == 5


def test_sqlite_stream_reads_what_is_new(spark, tmp_path):
    path = str(tmp_path / "s.sqlite")
    numbers(path, [(i, "old") for i in range(25)])
    sqlite.register(spark)

    def run():
        source = spark.readStream.format("sqlite").options(path=path, table="t", rows_per_partition=10).load()
        source.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.row_number, r.a, r.b) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [(i + 1, str(i), "old") for i in range(25)]
    numbers(path, [(i, "new") for i in range(25, 30)])
    assert run() == [(i + 1, str(i), "old" if i < 25 else "new") for i in range(30)] == run()


def test_sqlite_files_round_trip_and_have_a_version(spark, tmp_path):
    folder = str(tmp_path / "many")
    rows = spark.range(50).selectExpr("id as a", "if(id % 7 = 0, null, concat('ü', id)) as b")
    assert sqlite.write_files(rows.repartitionByRange(3, "a").sortWithinPartitions("a"), "t", folder) == 50
    sqlite.register(spark)
    back = spark.read.format("sqlite").options(path=folder, table="t").load()
    assert [(r.row_number, r.a, r.b) for r in back.orderBy("row_number").collect()] == [(i + 1, str(i), None if i % 7 == 0 else f"ü{i}") for i in range(50)]
    assert spark.read.format("sqlite").options(path=folder, table="t", limit=20).load().count() == 20
    before = sqlite.source_version(folder)
    assert before == sqlite.source_version(folder) and before.startswith("many-") and len(before) == 17
    numbers(sqlite.files_of(folder)[0], [(99, "x")])
    assert sqlite.source_version(folder) != before
