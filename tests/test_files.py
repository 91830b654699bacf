"""Files as input and output."""

import io
import zipfile
import zlib

import pytest

from tallyloom.operators.distinct import distinct_tokens
from tallyloom.operators.frequency import token_frequency
from tallyloom.plans.config import ConfigError
from tallyloom.sources.epub import epub_text
from tallyloom.sources.files import expand_path, file_corpus
from tallyloom.sources.pdf import pdf_text
from tallyloom.sources.sink import check_output, write_joined, write_parts


def make_pdf(pages, packed=False):
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{4 + 2 * i} 0 R' for i in range(len(pages)))}] /Count {len(pages)} >>",
               "<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>"]
    for i, text in enumerate(pages):
        body = f"BT /F1 12 Tf 50 700 Td ({text}) Tj ET".encode("latin-1")
        body = zlib.compress(body) if packed else body
        objects.append(f"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>")
        objects.append(f"<< /Length {len(body)}{' /Filter /FlateDecode' * packed} >>\nstream\n".encode() + body + b"\nendstream")
    out = b"%PDF-1.4\n"
    for i, o in enumerate(objects, 1):
        out += f"{i} 0 obj\n".encode() + (o if isinstance(o, bytes) else o.encode()) + b"\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


def make_epub(chapters):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="c%20{i}.xhtml"/>' for i in range(len(chapters)))
        refs = "".join(f'<itemref idref="c{i}"/>' for i in reversed(range(len(chapters)))) + '<itemref idref="none"/>'
        z.writestr("OEBPS/content.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine>{refs}</spine></package>')
        for i, c in enumerate(chapters):
            z.writestr(f"OEBPS/c {i}.xhtml", c)
    return out.getvalue()


def listed(df):
    return [r[0] for r in df.collect()]


def test_order_over_files_and_blocks(spark, tmp_path):
    names = ["z.txt", "a b.txt", "ü.txt", "[x]*.txt"]
    for i, n in enumerate(names):
        (tmp_path / n).write_text("\n".join(f"t{i}x{k} same" for k in range(50 * (i + 1))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = listed(distinct_tokens(file_corpus(spark, [str(tmp_path / n) for n in names]).lines))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [t for i in range(len(names)) for k in range(50 * (i + 1)) for t in (f"t{i}x{k}", "same")]
    assert got == list(dict.fromkeys(want))


def test_bytes_marks_and_repeats(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"a,\xff,a\n\xfe,b")
    assert listed(distinct_tokens(file_corpus(spark, [str(tmp_path / "a.txt")]).lines)) == ["a", "�", "b"]
    for name in ("b.txt", "_b.txt", ".b.txt"):
        (tmp_path / name).write_bytes(b"\xef\xbb\xbfhello world hello\rx\n")
        got = [tuple(r) for r in token_frequency(file_corpus(spark, [str(tmp_path / name)]).lines).collect()]
        assert got == [("hello", 2), ("world", 1), ("x", 1)]
    twice = [tuple(r) for r in token_frequency(file_corpus(spark, [str(tmp_path / "a.txt")] * 2).lines).collect()]
    assert twice == [("a", 4), ("�", 4), ("b", 2)]
    (tmp_path / "empty.txt").write_bytes(b"")
    assert listed(distinct_tokens(file_corpus(spark, [str(tmp_path / "empty.txt")]).lines)) == []


def test_expansion(tmp_path):
    for n in ("a/b.txt", "a.txt", "c.PDF", "d.md", "a/deep/e.log"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("x")
    (tmp_path / "link.txt").symlink_to(tmp_path / "a.txt")
    assert [p.removeprefix(str(tmp_path) + "/") for p in expand_path(str(tmp_path))] == ["a/b.txt", "a/deep/e.log", "a.txt", "c.PDF"]
    assert expand_path(str(tmp_path / "d.md")) == [str(tmp_path / "d.md")]
    (tmp_path / "none").mkdir()
    with pytest.raises(ConfigError):
        expand_path(str(tmp_path / "none"))


def test_pdf_and_epub():
    for packed in (False, True):
        assert pdf_text(make_pdf(["alpha", "be\\(t\\)a"], packed)) == "alpha\nbe(t)a\n"
    for broken in (b"not a pdf", b"%PDF-1.4\nnothing", make_pdf(["x"])[:120]):
        with pytest.raises(ValueError):
            pdf_text(broken)
    assert epub_text(make_epub(["<p>one &amp; two</p>", "<b>three</b>"])) == " three \n one & two \n"
    with pytest.raises(ValueError):
        epub_text(b"no zip")


def test_rich_files_stand_in_their_place(spark, tmp_path):
    files = {"a.txt": b"alpha", "b.pdf": make_pdf(["bravo"]), "bad.pdf": b"text only", "c.epub": make_epub(["<p>charlie</p>"]), "d.txt": b"delta"}
    for n, data in files.items():
        (tmp_path / n).write_bytes(data)
    corpus = file_corpus(spark, [str(tmp_path / n) for n in files])
    assert listed(distinct_tokens(corpus.lines)) == ["alpha", "bravo", "charlie", "delta"]
    assert [p for p, _ in corpus.failures] == [str(tmp_path / "bad.pdf")]
    raw = file_corpus(spark, [str(tmp_path / "bad.pdf")], extract_rich=False)
    assert listed(distinct_tokens(raw.lines)) == ["text", "only"] and not raw.failures


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(t,) for t in "abc"], "token string").coalesce(1)
    out = tmp_path / "sub" / "o.txt"
    assert write_joined(df, str(out), ",\n") == 3 and out.read_text() == "a,\nb,\nc"
    assert write_joined(df.limit(0), str(out)) == 0 and out.read_text() == ""
    write_parts(df, str(tmp_path / "parts"), "|")
    assert "".join(p.read_text() for p in sorted((tmp_path / "parts").glob("part-*"))) == "a|b|c|"
    with pytest.raises(ConfigError):
        check_output(str(out), [], False)
    with pytest.raises(ConfigError):
        check_output(str(out), [str(out)], True)
