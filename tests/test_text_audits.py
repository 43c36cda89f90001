"""Rule tables in one pass, sections, citations, whole audits, and text of word-processor files."""

import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import contentaudit, textqa
from cohortlens.sources import wordfiles

TEXTS = [(1, "We do NOT claim state-of-the-art; state-of-the-art it is. aaa aaaa"), (2, None), (3, ""), (4, "Über state-of-the-art [1] and [2, 7]\n# Methods \none two\nthree [x] 1[5]\n## Results"), (5, "no " * 20_000 + "aa the end")]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "id int, text string").withColumn("phrase", F.lit("clash"))


def test_one_pass_equals_rule_by_rule(spark):
    phrases = ["state-of-the-art", "aa", "Über", "the", "no", "end"]
    rules = spark.createDataFrame([(p,) for p in [*phrases, "AA", "", None]], "phrase string")
    key = lambda df: sorted((r["id"], r["phrase"], r["position"], r["context"], r["negated"]) for r in df.collect())
    got = key(contentaudit.rule_hits(frame(spark), "id", rules))
    assert got == key(textqa.phrase_hits(frame(spark).drop("phrase"), "id", phrases)) and len(got) > 20_000
    assert contentaudit.rule_hits(frame(spark), "id", rules.limit(0)).count() == 0
    both = contentaudit.rule_hits(frame(spark), "id", spark.createDataFrame([("the end",)], "phrase string"), both_sides=True, cues=("end",))
    assert [r["negated"] for r in both.collect()] == [True]


def test_sections_and_citations(spark):
    got = sorted(map(tuple, contentaudit.sections(frame(spark), "id").where("id in (3, 4)").collect()))
    assert got == [(3, 0, "", 1, 0), (4, 0, "", 1, 6), (4, 1, "Methods", 2, 5), (4, 2, "Results", 0, 0)]
    held = spark.createDataFrame([(4, 1), (4, 2), (4, 3), (1, 9)], "id int, number int")
    assert sorted(map(tuple, contentaudit.citation_problems(frame(spark), held, "id").collect())) == [(1, 9, "never cited"), (4, 3, "never cited"), (4, 7, "no reference")]


def test_an_audit_of_texts(spark):
    df = frame(spark, [(1, "# Abstract\none two a@b.org\n# Main\nstate-of-the-art [1]"), (2, "# Abstract\nnot state-of-the-art required c@d.org")])
    rules, held = spark.createDataFrame([("state-of-the-art",)], "phrase string"), spark.createDataFrame([(1, 1), (2, 5)], "id int, number int")
    out = contentaudit.content_audit(df, "id", rules, ["Required"], {"Abstract": (1, 3), "": (1, 7)}, held, ("a@b.org",), window=10)
    got = {(r["id"], r["name"]): r["status"] for r in out.collect()}
    failed = {k for k, v in got.items() if v == "fail"}
    assert len(got) == 14
    assert failed == {(1, "phrases:forbidden"), (1, "phrases:required"), (1, "words:all"), (2, "citations:never-cited"), (2, "emails:known"), (2, "words:Abstract")}


def test_word_files(spark, tmp_path):
    rows = [("a", ["Head & <tail>"], ["c1", "c 2"], ["one\ttwo", "", "  spaces  "]), ("b", [], [], []), ("c", None, None, ["long " * 100_000])]
    df = spark.createDataFrame(rows, "name string, headers array<string>, cells array<string>, paragraphs array<string>")
    assert wordfiles.write_documents(df, f"{tmp_path}/x").count() == 3
    (tmp_path / "x" / "bad.docx").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "x" / "other.docx", "w") as z:
        z.writestr("hello.txt", "x")
    with zipfile.ZipFile(tmp_path / "x" / "torn.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:p>")
    with zipfile.ZipFile(tmp_path / "x" / "styled.docx", "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/><w:tabs><w:tab w:pos="9"/></w:tabs></w:pPr><w:r><w:t>A</w:t><w:br/><w:t>B</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("word/footer2.xml", f"<w:ftr {w}><w:p><w:r><w:t>page</w:t></w:r></w:p></w:ftr>")
    got = {}
    for r in wordfiles.read_documents(spark, f"file://{tmp_path}/x", files=2).collect():
        got.setdefault(r["path"].rpartition("/")[2], []).append((r["kind"], r["position"], r["style"], r["text"], r["error"] is None))
    assert sorted(got.pop("a.docx")) == [("cell", 0, "", "c1", True), ("cell", 1, "", "c 2", True), ("header", 0, "", "Head & <tail>", True), ("paragraph", 0, "", "one\ttwo", True), ("paragraph", 1, "", "", True), ("paragraph", 2, "", "  spaces  ", True)]
    assert got.pop("c.docx")[0][3] == "long " * 100_000 and "b.docx" not in got
    assert got.pop("styled.docx") == [("paragraph", 0, "Heading1", "A\nB", True), ("footer", 0, "", "page", True)]
    assert set(got) == {"bad.docx", "other.docx", "torn.docx"} and all(v[-1][4] is False for v in got.values())
    with pytest.raises(Exception, match="nowhere"):
        wordfiles.read_documents(spark, f"{tmp_path}/nowhere").count()


def test_hits_are_sent_in_bounded_pieces(spark, monkeypatch):
    texts, kept = frame(spark), []
    rules = spark.createDataFrame([("ab",)], "phrase string")
    monkeypatch.setattr(type(texts), "mapInArrow", lambda self, run, schema: kept.append(run) or self)
    contentaudit.rule_hits(texts, "id", rules)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int32()), pa.array(["ab " * 50_000, "no ab"])], names=["id", "_t"])
    sent = list(kept[0](iter([batch])))
    assert max(b.num_rows for b in sent) <= 20_000
    rows = [tuple(r.values()) for b in sent for r in b.to_pylist()]
    assert [r[2] for r in rows] == [*range(1, 150_000, 3), 4] and rows[-1] == (2, "ab", 4, "no ab", True) and not rows[0][4]
