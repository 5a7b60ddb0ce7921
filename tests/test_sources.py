import io
import zipfile

import pytest

from lodestone.plans import files
from lodestone.sources import docx, pages
from lodestone.sources import io as S

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def make_docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def p(t):
    return f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"


def table(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def test_docx():
    body = p("One") + table(["a", "b"], ["c"], ["", ""]) + table(["layout"], ["more"]) + table(["", ""]) + p(" ")
    assert docx.docx_text(make_docx(body)) == "One\n\n[TABLE_START]\n\n|a|b|\n|---|---|\n|c||\n\n[TABLE_END]\n\nlayout\n\nmore"


def test_extract_isolates_errors(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.docx").write_bytes(make_docx(p("hello")))
    (tmp_path / "sub" / "b.DOCX").write_bytes(b"broken")
    (tmp_path / "empty.docx").write_bytes(make_docx(""))
    rows = S.extract(S.discover(spark, str(tmp_path), ".docx"), docx.docx_text)
    assert rows.filter("error is not null").count() == 1
    assert [r["source_file"] for r in S.extracted_texts(rows).collect()] == ["a.txt"]


def test_json(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "1", "question": "Что?"}\n\n{"id": "2", "question": null}\n')
    df = S.read_jsonl(spark, str(tmp_path / "q.jsonl"), "id string, question string")
    assert df.count() == 2
    S.write_jsonl(df, str(tmp_path / "out"))
    assert '"question":null' in "".join(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\n{oops\n')
    with pytest.raises(Exception):
        S.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id string").collect()
    with pytest.raises(Exception, match=r"bad\.jsonl, line 2: \{oops"):
        S.read_jsonl_traced(spark, str(tmp_path / "bad.jsonl"), "id string").collect()
    assert S.read_json_array(spark, str(tmp_path / "no.json"), "id string", optional=True).count() == 0
    (tmp_path / "a.json").write_text('[{"id": "1"}, {"id": "2"}]')
    assert S.read_json_array(spark, str(tmp_path / "a.json"), "id string").count() == 2


@pytest.mark.parametrize("size", ["40", "700", "128m"])
def test_numbered_lines(spark, tmp_path, size):
    """The same numbers however files are split; blank and long lines, an empty file and one without a last line end count."""
    files = {f"f{k}": ["", f"{k} " * 400, "x", "x", ""] * k + [f"line {i} of {k}" for i in range(60)] for k in range(5)}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines))
    (tmp_path / "empty").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = [(r["_file"].rsplit("/", 1)[1], r["_line"], r["_raw"]) for r in S.numbered_lines(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == sorted((name, i + 1, t) for name, lines in files.items() for i, t in enumerate(lines))


def test_append_new(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    S.append_new(df.limit(1), str(tmp_path / "t"), "k")
    S.append_new(df, str(tmp_path / "t"), "k")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_pages(spark):
    b = lambda y, x, t: (x, y, x + 10.0, y + 10.0, t)
    rows = [("f", 1, [b(50.0, 0.0, "low"), b(0.0, 0.0, "top"), b(22.0, 5.0, "inside")], [b(20.0, 0.0, "|t|")])]
    df = spark.createDataFrame(rows, pages.PAGE)
    assert pages.page_text(df).first()["page_text"] == "top\n\n[TABLE_START]\n\n|t|\n\n[TABLE_END]\n\nlow"
    assert pages.file_text(df).first()["full_text"].startswith("--- PAGE 1 ---\n\ntop")


def test_html():
    assert pages.html_text("<p>a <b>b</b></p><script>x</script><table><tr><td>1</td><td>2</td></tr></table><p>c") == "a b\n\n[TABLE_START]\n\n|1|2|\n|---|---|\n\n[TABLE_END]\n\nc"


def test_stream(spark, tmp_path):
    from lodestone.streaming.ingest import chunk_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello world")
    for _ in range(2):
        chunk_stream(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(60)
    assert [r["chunk_id"] for r in spark.read.parquet(str(tmp_path / "t")).collect()] == ["a_p1_c1"]


def test_tables_that_are_folders_have_their_own_names(spark, sf, tmp_path):
    """At larger sizes a table is a folder of files."""
    spark.read.parquet(f"{sf}/labels.parquet").repartition(3).write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{sf}/pages.parquet").coalesce(1).write.parquet(str(tmp_path / "Pages.PARQUET"))
    for path in (tmp_path, f"file://{tmp_path}/"):
        assert sorted(r["name"] for r in files.discovered_files(spark, str(path)).collect()) == ["Pages.PARQUET", "labels.parquet"]


def test_traced_folders_have_files_of_bounded_size(spark, sf, monkeypatch):
    """A folder's rows are dealt out among tasks; the lines go on from file to file."""
    paths, read = [], S.read_jsonl_traced
    monkeypatch.setattr(S, "read_jsonl_traced", lambda spark, path, schema: paths.append(path) or read(spark, path, schema))
    given = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "11"}
    before = {k: spark.conf.get(k) for k in given}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        got = sorted((r["part"], r["doc_id"], r["line"]) for r in files.jsonl_traced(spark, sf).collect())
        of = spark.read.text(paths[0]).selectExpr("_metadata.file_path as f").groupBy("f").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(of) > 8 and max(r["count"] for r in of) < len(got) / 4
    ids = sorted(r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    assert got == sorted((k, x, i + 1) for k in range(4) for i, x in enumerate(y for y in ids if y % 4 == k))
