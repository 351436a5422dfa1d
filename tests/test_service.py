"""Files, records and the semantic stage against plain loops and golden cases."""

import hashlib
import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F
from tests.oracle import DATA
from textguard.operators import records, resolve, semantic
from textguard.plans.service import QUERIES
from textguard.sources import files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()


MAIN = f"<w:document {W}><w:body><w:p><w:r><w:t>Mail</w:t><w:tab/><w:t>jo@firm.io</w:t><w:br/><w:t>end</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>c1</w:t></w:p></w:tc><w:tc><w:p><w:t>c2</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
CASES = [
    ("a.docx", docx({"word/document.xml": MAIN, "word/footer1.xml": f"<w:ftr {W}><w:p><w:t>foot</w:t></w:p></w:ftr>", "word/styles.xml": "<x/>"}), None, "Mail\tjo@firm.io\nend\nc1\n\tc2\n\t\n\nfoot"),
    ("b.docx", docx({"word/header1.xml": "<a/>"}), "extraction-failed", None),
    ("c.docx", docx({"word/document.xml": "<broken"}), "extraction-failed", None),
    ("d.docx", docx({"word/document.xml": f"<w:document {W}/>"}), "no-extractable-text", None),
    ("e.docx", bytes.fromhex("D0CF11E0A1B11AE1") + b"x", "encrypted-document", None),
    ("f.docx", b"plain", "extraction-failed", None),
    ("g.txt", b"\xff\xfe" + "né 😀".encode("utf-16-le"), None, "né 😀"),
    ("h.txt", b"\xfe\xff" + "né".encode("utf-16-be"), None, "né"),
    ("i.txt", b"\xff\xfe\x00\xd8", "unknown-binary", None),
    ("j.txt", b"\xef\xbb\xbfplain", None, "plain"),
    ("k.txt", b"xx %PDF-1.4", "unknown-binary", None),
    ("l.txt", b"", None, ""),
    ("m.exe", b"x", "unsupported-type", None),
    ("n.pdf", b"%PDF-1.4", "extraction-failed", None),
    ("o.txt", b"a\x01b\x02", "unknown-binary", None),
    ("p.txt", None, "unknown-binary", None),
]


def test_files_of_all_kinds(spark):
    df = spark.createDataFrame([(n, "", c) for n, c, _, _ in CASES], "name string, mime string, content binary")
    rows = {r["name"]: r for r in files.extracted(df).collect()}
    assert {n: (rows[n]["reason"], rows[n]["text"]) for n, *_ in CASES} == {n: (reason, text) for n, _, reason, text in CASES}
    scanned = {r["name"]: r for r in files.scanned_files(df, resolve.resolved).collect()}
    assert [f["detector"] for f in scanned["a.docx"]["findings"]] == ["email"] and not scanned["a.docx"]["can_sanitize"]
    assert scanned["m.exe"]["message"] == "This file type is not supported. File contents could not be scanned."
    copies = {r["name"]: r for r in files.sanitized_files(df, resolve.resolved, lambda t, f: resolve.rewritten(t, f, "replacement_value")).collect()}
    assert copies["a.docx"]["copy_reason"] == "sanitization-unavailable" and copies["j.txt"]["copy_text"] == "plain" and copies["j.txt"]["copy_name"] == "j.sanitized.txt"


def test_payload_ids_against_json(spark):
    rows = spark.createDataFrame([("né", {"b": 0.5, "a": 1e-7}, ["x"])], "text string, scores map<string,double>, labels array<string>")
    found = rows.select(records.payload_id(F.struct("text", "scores", "labels")).alias("id")).first()["id"]
    assert found == hashlib.sha256(json.dumps({"text": "né", "scores": {"b": 0.5, "a": 1e-7}, "labels": ["x"]}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    ids = [r["id"] for r in QUERIES["payload_ids"](spark, DATA).collect()]
    assert len(ids) == len(set(ids)) and all(re.fullmatch("[0-9a-f]{64}", x) for x in ids)


#: text, category, start and end given, what stays of it (null: the finding as given)
PASSAGES = [
    ("We met. The customer named Blue Harbor Ltd signed the renewal! Fine.", "Customer-specific information", 0, 68, "Blue Harbor Ltd"),
    ("Our revenue forecast is $4.5 million; keep quiet.", "Non-public financial information", 0, 49, "$4.5 million"),
    ("A budget of 3,000 K applies", "Non-public financial information", 0, 27, "3,000 K"),
    ("Project Falcon launch: feature Night Mode soon.\nOther line", "Unreleased product information", 0, 58, "Falcon"),
    ("The settlement of March 3, 2024 stands", "Legal-sensitive information", 0, 38, "March 3, 2024"),
    ("on 2024-05-06 we deal", "Business-sensitive information", 0, 21, "2024-05-06"),
    ("employee Ann O'Neil on leave; salary talk", "Employee-sensitive information", 0, 41, "Ann O'Neil"),
    ("Sunny day. the plan of the board is set. Bye.", "Business-sensitive information", 0, 45, "the plan of the board is set"),
    ("one segment only...", "Unknown", 0, 19, "one segment only"),
    ("Nothing here. Nothing there.", "Legal-sensitive information", 0, 28, None),
    ("Nothing here. Nothing there.", "Legal-sensitive information", -4, 90, None),
    ("two segments. Here.", "Unknown", 0, 40, None),
    ("   \n ", "Legal-sensitive information", -1, 5, None),
    ("", "Unknown", 0, 5, None),
    ("short", "Unknown", 9, 12, None),
    ("xx the terms, 1999-1-2, hold", "Legal-sensitive information", 3, 400, "1999-1-2"),
]


def test_narrowing(spark):
    df = spark.createDataFrame(PASSAGES, "text string, c string, s int, e int, kept string")
    for r in df.select("*", semantic.narrowed(F.col("text"), F.col("s"), F.col("e"), F.col("c")).alias("n")).collect():
        if r["kept"] is None:
            assert tuple(r["n"]) == (r["s"], r["e"]), r
        else:
            assert r["text"][r["n"]["start"] : r["n"]["end"]] == r["kept"], r


def test_narrowed_findings_stand_in_their_passage(spark):
    """Of whole texts: inside the finding, without white space or end marks at the ends; the same again."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["semantic_narrow"](spark, DATA).collect()
    changed = [r for r in rows if (r["start"], r["end"]) != (r["narrow_start"], r["narrow_end"])]
    assert changed and max(r["end"] for r in rows) > 5_000
    for r in changed:
        value = texts[r["doc_id"]][r["narrow_start"] : r["narrow_end"]]
        assert r["start"] <= r["narrow_start"] < r["narrow_end"] <= r["end"] and value == value.lstrip().rstrip(" \t\r\n.!?;")


def test_word_pieces(spark):
    VOCABULARY = {p: i for i, p in enumerate(["[UNK]", *"abcdefghijklmnopqrstuvwxyz.,", *(f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz"), "the", "er", "##er", "an"])}
    df = spark.createDataFrame([("The Ünique er, 日本 x" + "y" * 101,), (None,), ("a\x00b é",)], "text string")
    rows = semantic.word_pieces(df, VOCABULARY).collect()
    names = {i: p for p, i in VOCABULARY.items()}
    first = [(names[i], s, e) for i, s, e in zip(rows[0]["ids"], rows[0]["starts"], rows[0]["ends"], strict=True)]
    assert first == [("the", 0, 3), ("u", 4, 10), ("##n", 4, 10), ("##i", 4, 10), ("##q", 4, 10), ("##u", 4, 10), ("##e", 4, 10), ("er", 11, 13), (",", 13, 14), ("[UNK]", 15, 16), ("[UNK]", 16, 17), ("[UNK]", 18, 120)]
    assert rows[1]["ids"] == [] and [names[i] for i in rows[2]["ids"]] == ["a", "b", "e"]


def test_semantic_scan_that_fails_leaves_the_detectors_findings(spark):
    docs = spark.createDataFrame([(1, "mail jo@firm.io")], "doc_id long, text string")
    found = resolve.exploded(resolve.resolved(docs))

    def broken(d):
        raise RuntimeError("no model")

    with pytest.warns(UserWarning, match="RuntimeError"):
        assert semantic.with_semantic(found, docs, broken).count() == 1
    assert semantic.with_semantic(found, docs, broken, enabled=False).count() == 1


def test_a_head_that_does_not_fit_is_refused():
    labels, ok = list(semantic.SEMANTIC_LABELS), [0.0] * 8
    semantic.checked_head(labels, [[0.0] * 384] * 8, ok, ok)
    for bad in ((labels[::-1], [[0.0] * 384] * 8, ok, ok), (labels, [[0.0] * 383] * 8, ok, ok), (labels, [[0.0] * 384] * 8, ok[:7], ok)):
        with pytest.raises(ValueError):
            semantic.checked_head(*bad)


def test_a_long_text_of_addresses_is_linear(spark):
    import time

    text = "\n".join(f"user{i}@host{i}.org" for i in range(4000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    assert resolve.exploded(resolve.resolved(df)).count() == 4000
    assert time.time() - began < 30


def test_safe_replacement_of_given_findings(spark):
    text = "We met. The customer named Blue Harbor signed the renewal! Mail jo@firm.io now."
    kind = "array<struct<detector:string, category:string, start:int, end:int, original_value:string, replacement_safe:boolean>>"
    at = text.index("jo@firm.io")
    found = [("semantic", "Customer-specific information", 0, text.index(" Mail"), text[: text.index(" Mail")], None), ("email", "Email address", at, at + 10, "jo@firm.io", True), ("email", "Email address", 3, 6, "met", False), ("email", "Email address", -1, 4, "x", True), ("email", "Email address", at + 2, 10**6, "x", True)]
    df = spark.createDataFrame([(1, text, found), (None, "plain", []), (1, None, None)], f"doc_id long, text string, findings {kind}")
    out = [r["text"] for r in resolve.safe_replaced(df, lambda d: df).collect()]
    assert out == ["We met. The customer named Example_Customer signed the renewal! Mail example@example.com now.", "plain", None]


def test_usable_spots_against_a_loop(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    cases = [[(int(a), int(a + rng.integers(-1, 9)), bool(rng.random() < 0.8)) for a in rng.integers(-2, 60, 25)] for _ in range(50)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<struct<start:int, end:int, safe:boolean>>")
    for r in df.select("i", resolve.usable(F.col("s"), F.lit(60)).alias("u")).collect():
        kept, at = [], 60
        for a, b, safe in sorted(cases[r["i"]], key=lambda x: -x[0]):
            if safe and 0 <= a < b <= 60 and b <= at:
                kept.append((a, b, safe))
                at = a
        assert [tuple(x) for x in r["u"]] == kept[::-1]
