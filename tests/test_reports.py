"""The data source for folders of mixed files."""

import json

import pytest

from tabulora.sources import reports


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# 标题\n正文")
    (tmp_path / "sub/b.HTML").write_text("<p>tags stay</p>")
    (tmp_path / "bad.txt").write_bytes(b"ok \xff\xfe")
    (tmp_path / "data.bin").write_bytes(b"ok \xff kept")
    (tmp_path / "noname").write_text("no suffix")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "broken.pdf").write_bytes(b"%PDF not json")
    pdf = [{"kind": "line", "page": 1, "idx": k, "y0": 10.0 * k, "text": t} for k, t in enumerate(["一、主要会计数据", " 收入构成 情况 ", "  "])]
    pdf += [{"kind": "block", "page": 1, "idx": 1, "x0": 0.0, "y0": 0.0, "x1": 9.0, "y1": 9.0, "text": "正文"}, {"kind": "table", "page": 2, "idx": 1, "x0": 0.0, "y0": 200.0, "x1": 9.0, "y1": 300.0, "rows": [["项目", None], ["收入", "1"]]}, {"kind": "image", "page": 2, "idx": 1}]
    (tmp_path / "r.pdf").write_text(json.dumps(pdf))
    (tmp_path / "_hidden.txt").write_text("left out")
    return tmp_path


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_mixed_folder(spark, folder, scheme):
    documents, elements, errors = reports.parsed(spark, f"{scheme}{folder}", "tests.pdf_backend:rows")
    name = lambda s: s.rsplit("/", 1)[-1]
    docs = {name(r.source): (r.title, r.doc_type, r.text) for r in documents.collect()}
    assert docs == {"a.md": ("a", "md", "# 标题\n正文"), "b.HTML": ("b", "html", "<p>tags stay</p>"), "data.bin": ("data", "bin", "ok  kept"), "noname": ("noname", "unknown", "no suffix"), "empty.txt": ("empty", "txt", ""), "r.pdf": ("r", "pdf", "正文")}
    assert {name(r.source): r.error.split(":")[0] for r in errors.collect()} == {"bad.txt": "UnicodeDecodeError", "broken.pdf": "JSONDecodeError"}
    rows = [tuple(r)[1:] for r in elements.orderBy("element_seq").collect() if name(r.source) == "r.pdf"]
    assert rows == [(0, "text", "正文", 1, "一、主要会计数据", None, None), (1, "table", "项目 | \n收入 | 1", 2, "一、主要会计数据", "一、主要会计数据 第2页表1", None), (2, "image", "Image block detected on page 2.", 2, "一、主要会计数据", None, "Figure 1 on page 2")]


def test_partitions_follow_bytes(spark, folder):
    reader = reports.ReportReader({"path": str(folder), "partitionbytes": "20"})
    parts = reader.partitions()
    assert len(parts) > 4 and sorted(p for x in parts for p in x.paths) == sorted(str(p) for p in folder.rglob("*") if p.is_file() and p.name != "_hidden.txt")
    assert reports.read_reports(spark, str(folder), partition_bytes=20).rdd.getNumPartitions() == len(parts)


def test_single_file_missing_path_and_no_backend(spark, folder, tmp_path):
    one = reports.read_reports(spark, f"{folder}/a.md").collect()
    assert [(r.title, r.kind, r.text) for r in one] == [("a", "text", "# 标题\n正文")]
    with pytest.raises(Exception, match="file not found"):
        reports.read_reports(spark, f"{folder}/none.txt").collect()
    assert reports.read_reports(spark, f"{folder}/r.pdf").first().error == "ValueError: no backend for PDF files"
    (tmp_path / "void").mkdir()
    assert reports.read_reports(spark, f"{tmp_path}/void").count() == 0
