import io
import zipfile

import pytest

from veilwork.functions.textops import fold, fold_text, key_text, name_key
from veilwork.operators.sessions import anonymize_sessions, session_codes
from veilwork.sources.delimited import ListError, cells, parse_names
from veilwork.sources.files import filename_lines, read_files
from veilwork.sources.office import Failure, Limits, extract, iso_serial
from veilwork.streaming.stream import redact_folder

REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def rel(i, kind, target, mode=""):
    return f'<Relationship Id="{i}" Type="http://x/{kind}" Target="{target}" {mode}/>'


def docx(body="<w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>Anna</w:t></w:r></w:p><w:p><w:t>Two</w:t></w:p>", **more):
    return package(**{"word/document.xml": f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>', **more})


def changed(at, skip, new, cut=0):
    """A package with some bytes overwritten (or `cut` of them replaced) behind the first place of a mark."""
    raw = docx()
    place = raw.index(at) + skip
    return raw[:place] + new + raw[place + (cut or len(new)) :]


def extra(field):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        info = zipfile.ZipInfo("word/document.xml")
        info.extra = field
        z.writestr(info, '<w:document xmlns:w="w"><w:t>Hello</w:t></w:document>')
    return out.getvalue()


class OneWay(io.RawIOBase):
    """A stream that cannot seek: sizes then follow the data."""

    def __init__(self):
        self.parts = []

    def writable(self):
        return True

    def write(self, b):
        self.parts.append(bytes(b))
        return len(b)


def streamed(error=0):
    out = OneWay()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:t>Hello</w:t></w:p></w:document>')
    raw = bytearray(b"".join(out.parts))
    raw[raw.index(b"PK\x07\x08") + 4] ^= error
    return bytes(raw)


def test_names():
    assert parse_names("﻿Class 4\nVoornaam;Tussenvoegsel;Achternaam\n\"An;na\";de;Vries\nAn\u0301a;;X\nAn\u0301a;;X\n;;\n") == [("An;na", "de Vries"), ("A\u0144a", "X")]
    assert parse_names("Jo,Smit\n\"A \"\"B\"\"\",C") == [("Jo", "Smit"), ('A "B"', "C")]
    assert parse_names("Full name\nJo Smit") == [("Jo Smit", "")] and parse_names(None) == [] and parse_names("  ") == []
    assert [c.value for c in cells('"a,b", c ,"d""e"', ",")] == ["a,b", "c", 'd"e']
    with pytest.raises(ListError):
        parse_names("\n".join(f"a{i},b" for i in range(2001)))
    with pytest.raises(ListError):
        parse_names("x" * 257 + ",b")


def test_folding(spark):
    words = ["Straße", "ÆØŁ", "Yılmaz", "İzmir", "e\u0301tude", "Þór", "王小明", "Ünï-cøde 9"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select("w", fold(df.w).alias("f"), name_key(df.w).alias("k")).collect()
    assert all((r.f, r.k) == (fold_text(r.w), key_text(r.w)) for r in got)
    assert {r.w: r.k for r in got}["Þór"] == "thor" and {r.w: r.k for r in got}["Yılmaz"] == "yilmaz"


def test_packages():
    text, warnings, counts = extract(docx(**{"word/_rels/document.xml.rels": REL.format(rel("a", "comments", "comments.xml") + rel("b", "hyperlink", "http://x", 'TargetMode="External"')), "word/comments.xml": '<c xmlns:w="w"><w:comment w:author="Jo"><w:p><w:t>Note</w:t></w:p></w:comment></c>', "word/media/a.png": "x"}), "docx")
    assert text.index("Hello\tAnna") < text.index("Two") < text.index("Jo") < text.index("Note")
    assert warnings == ["import_document", "import_external", "import_media"] and counts["comments"] == 1
    sheet = '<s xmlns="x"><row><c t="s"><v>0</v></c><c s="1"><v>40251</v></c><c t="inlineStr"><is><t>in</t></is></c><c><f>A1+1</f><v>3</v></c></row></s>'
    text, _, counts = extract(package(**{"xl/workbook.xml": '<w xmlns:r="r"><sheets><sheet name="S" state="hidden" r:id="q"/></sheets></w>', "xl/_rels/workbook.xml.rels": REL.format(rel("q", "worksheet", "/xl/s1.xml")), "xl/s1.xml": sheet, "xl/sharedStrings.xml": "<sst><si><t>shared</t></si></sst>", "xl/styles.xml": '<st><numFmts/><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></st>'}), "xlsx")
    assert "shared\t2010-03-14\tin\t3 [Formula: A1+1]" in text and (counts["sheets"], counts["hidden"]) == (1, 1)
    slide = lambda t, more="": f'<p:sld xmlns:p="p" xmlns:a="a" {more}><a:p><a:t>{t}</a:t></a:p></p:sld>'
    text, _, counts = extract(package(**{"ppt/presentation.xml": '<p xmlns:r="r"><sldId r:id="2"/><sldId r:id="1"/></p>', "ppt/_rels/presentation.xml.rels": REL.format(rel("1", "slide", "slides/a.xml") + rel("2", "slide", "slides/b.xml")), "ppt/slides/a.xml": slide("first", 'show="0"'), "ppt/slides/b.xml": slide("second")}), "pptx")
    assert text.index("second") < text.index("first") and (counts["slides"], counts["hidden"]) == (2, 1)
    text, warnings, counts = extract(package(**{"content.xml": '<o xmlns:t="t" xmlns:x="x"><t:body><t:spreadsheet><t:table t:name="T"><t:table-row x:number-rows-repeated="9"><t:table-cell><t:p>a<t:s t:c="3"/>b</t:p></t:table-cell></t:table-row></t:table></t:spreadsheet></t:body></o>'}), "ods")
    assert text.count("a   b") == 1 and "import_repeated" in warnings and counts["sheets"] == 1


@pytest.mark.parametrize("raw,code", [
    (b"no zip", "file_archive"),
    (docx() + b"tail", "file_archive"),
    (package(**{"a/../b": "x"}), "file_archive"),
    (docx("<!DOCTYPE x>"), "file_xml"),
    (docx("<open>"), "file_xml"),
    (package(other="x"), "file_archive"),
    (docx("<w:t>" + "x" * 200_000 + "</w:t>"), "text_large"),
    (docx("<a/>" * 300_001), "file_complex"),
    (docx("<w:t>" + "x" * (9 << 20) + "</w:t>"), "file_expanded_large"),
    (docx(**{"word/_rels/document.xml.rels": REL.format(rel("a", "header", "../../x.xml"))}), "file_archive"),
    (docx(**{"word/_rels/document.xml.rels": REL.format(rel("a", "header", "x.xml") + rel("a", "footer", "y.xml"))}), "file_archive"),
    (docx(**{"word/_rels/document.xml.rels": REL.format(rel("", "header", "x.xml"))}), "file_archive"),
    (changed(b"PK\x01\x02", 8, b"\x40\x00"), "file_encrypted"),
    (changed(b"PK\x01\x02", 8, b"\x00\x20"), "file_encrypted"),
    (changed(b"PK\x03\x04", 14, b"\0\0\0\0"), "file_archive"),  # the local header's checksum
    (changed(b"PK\x03\x04", 22, b"\1\0\0\0"), "file_archive"),  # and its size
    (changed(b"word/document.xml", 0, b"\xff"), "file_archive"),
    (changed(b"PK\x05\x06", 0, b"gap!PK\x05\x06", 4), "file_archive"),  # the directory does not end at the end record
    (extra(b"\x01\x00\x04\x00abcd"), "file_archive"),
    (extra(b"\x01\x99\x04\x00abcd"), "file_archive"),
    (extra(b"\x99\x99\x09\x00abcd"), "file_archive"),  # longer than its place
    (streamed(1), "file_archive"),
])
def test_hostile_packages(raw, code):
    with pytest.raises(Failure) as found:
        extract(raw, "docx")
    assert found.value.code == code


def test_packages_written_as_streams_and_harmless_extras():
    for raw in (streamed(), extra(b"\x99\x99\x04\x00abcd")):
        assert "Hello" in extract(raw, "docx")[0]


def test_a_file_has_a_deadline():
    with pytest.raises(Failure) as found:
        extract(docx(), "docx", Limits(seconds=-1))
    assert found.value.code == "file_timeout"


def test_damaged_checksum():
    raw = bytearray(docx())
    raw[raw.index(b"PK\x01\x02") + 16] ^= 1
    with pytest.raises(Failure):
        extract(bytes(raw), "docx")


def test_serials():
    assert [iso_serial(x, False) for x in (0, 1, 59, 60, 61, 40251.5, 2_958_465, 2_958_466)] == ["1899-12-31", "1900-01-01", "1900-02-28", "1900-02-29", "1900-03-01", "2010-03-14T12:00:00", "9999-12-31", None]
    assert iso_serial(0, True) == "1904-01-01"


def test_files(spark, tmp_path):
    for name, body in {"a.txt": "héllo".encode(), "b.md": b"\xff\xfeh\x00i\x00", "c.csv": b"\xff\x00bad", "d.exe": b"x", "e.docx": docx(), "f.docx": b"broken", "g.txt": b"x" * 2000, "big.txt": b"x" * 9000}.items():
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[-1]: r for r in read_files(spark, str(tmp_path), Limits(file_bytes=8000, text_chars=1000)).collect()}
    assert got["a.txt"].text == 'File name: "a.txt"\n\nhéllo' and got["b.md"].text.endswith("\n\nhi")
    assert "Hello" in got["e.docx"].text and got["e.docx"].counts.slides == 0 and got["e.docx"].warnings == ["import_document"]
    assert {n: r.error_code for n, r in got.items() if r.error_code} == {"c.csv": "file_encoding", "d.exe": "file_unsupported", "f.docx": "file_archive", "g.txt": "text_large", "big.txt": "file_large"}
    assert all(r.error_category == "validation" and r.is_retryable is False for r in got.values() if r.error_code)


def test_filename_lists(spark):
    df = spark.createDataFrame([('a "b".pdf\r\n\n  c\\d ',), ("x" * 256,)], "t string")
    assert [r[0] for r in df.select(filename_lines(df.t)).collect()] == ['File name: "a \\"b\\".pdf"\nFile name: "c\\\\d"', None]


def test_long_filename_lists(spark):
    from veilwork.sources.files import filename_error

    names = [f"n{k}.pdf" for k in range(2500)]
    df = spark.createDataFrame([("\n".join(names),), ("x" * 256,), (None,)], "t string")
    got = df.select(filename_lines(df.t), filename_lines(df.t, 2499), filename_error(df.t, 2499), filename_error(df.t)).collect()
    assert tuple(got[0]) == ("\n".join(f'File name: "{n}"' for n in names), None, "filename_list_limit", None)
    assert tuple(got[1]) == (None, None, "filename_long", "filename_long") and got[2][0] is None


def test_sessions(spark):
    rows = [(1, "s", "a@b.de x", [(0, 6, "email")]), (2, "s", "[[EMAIL_002]] c@d.de a@b.de", [(14, 20, "email"), (21, 27, "email")]), (3, "t", "c@d.de", [(0, 6, "email")]), (4, "t", None, [])]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, spans array<struct<start:int,end:int,type:string>>")
    codes = session_codes(df, "source", "doc_id")
    got = {r.doc_id: r.anonymized for r in anonymize_sessions(df, codes, "source").collect()}
    assert got == {1: "[[EMAIL_001]] x", 2: "[[EMAIL_002]] [[EMAIL_003]] [[EMAIL_001]]", 3: "[[EMAIL_001]]", 4: ""}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "to a@b.de"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    q = redact_folder(spark, "doc_id long, text string", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {r.doc_id: r.redacted for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "to [REMOVED]", 2: ""}
