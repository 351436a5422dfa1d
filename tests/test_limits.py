"""Limits of file scans as options."""

import io
import zipfile

import pytest

from textguard.operators import resolve
from textguard.sources import files


@pytest.mark.parametrize(
    "given, used", [(None, 9), (0, 9), (-3, 9), (float("nan"), 9), (float("inf"), 9), ("7", 9), (True, 9), (2.9, 2), (5, 5), (0.5, 0)],
)
def test_positive_limits(given, used):
    assert files.positive_limit(given, 9) == used


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def test_a_scan_keeps_to_its_limits(spark):
    rows = [("a.txt", "", b"mail jo@firm.io"), ("b.txt", "", b"x" * 600), ("c.txt", "", b"y" * 60), ("d.docx", "", docx("mail ann@firm.io")), ("e.docx", "", docx("z" * 60))]
    df = spark.createDataFrame(rows, "name string, mime string, content binary")
    found = {r["name"]: (r["reason"], len(r["findings"]), r["message"]) for r in files.scanned_files(df, resolve.resolved, files.Limits(bytes=512.7, chars=40)).collect()}
    assert found["a.txt"] == (None, 1, None) and found["d.docx"] == (None, 1, None)
    assert found["b.txt"][:2] == ("file-too-large", 0) and "512" in found["b.txt"][2]
    assert found["c.txt"][0] == found["e.docx"][0] == "extraction-limit-exceeded"
    usual = {r["name"]: r["reason"] for r in files.scanned_files(df, resolve.resolved).collect()}
    assert set(usual.values()) == {None}
