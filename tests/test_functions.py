"""Functions and sources on small cases written down by hand."""

from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from quillspark.functions import form_latex, paths, quality, rendering, validation
from quillspark.functions.confidence import confidences, harvest
from quillspark.sources import sheets
from quillspark.sources.mail import as_documents, parse, parsed, rendered
from quillspark.sources.uploads import magic


def mail() -> EmailMessage:
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["Date"] = "Grüße", "A <a@x.example>", "b@x.example, c@x.example", "Tue, 02 Jan 2024 03:04:05 +0100"
    m.set_content("plain body")
    m.add_alternative("<p>html body <img src='cid:i'></p>", subtype="html")
    m.add_attachment(b"%PDF-1", maintype="application", subtype="pdf", filename="x y.pdf")
    m.add_attachment(b"PK", maintype="application", subtype="zip", filename="z.zip")
    return m


def test_mail_manifest():
    subject, sender, to, cc, at, mid, kind, body, parts = parse(mail().as_bytes())
    assert (subject, sender, to, cc, mid, kind) == ("Grüße", "a@x.example", ["b@x.example", "c@x.example"], [], None, "text/html") and "html body" in body
    assert at.isoformat() == "2024-01-02T02:04:05+00:00"
    assert [(p["filename"], p["outcome"], p["skip_reason"]) for p in parts] == [("x_y.pdf", "job", None), ("z.zip", "skipped", "unsupported_type")]
    outer = EmailMessage()
    outer["Subject"] = "Fwd"
    outer.set_content("see below")
    outer.add_attachment(mail())
    assert [(p["outcome"], p["skip_reason"]) for p in parse(outer.as_bytes())[-1]] == [("skipped", "nested_message")]
    assert parse(b"")[-2:] is not None and parse(b"Date: nonsense\n\nx")[4] is None


def test_mail_table(spark):
    df = spark.createDataFrame([(1, bytearray(mail().as_bytes())), (2, None)], "n long, raw binary")
    got = {r.n: r for r in parsed(df, "n", "raw").collect()}
    assert got[1].subject == "Grüße" and len(got[1].parts) == 2 and got[2].subject == ""
    assert parsed(df.limit(0), "n", "raw").count() == 0


def test_confidence_harvest(spark):
    doc = {"a": {"confidence": 0.5, "config": {"x": 0.9}}, "Scores": [0.1, [1, True, 2], {"y": 0.3}], "rec_score": 0.99, "confidences": {"z": 0.2}}
    assert harvest(doc) == [0.5, 0.1, 1.0, 0.99]
    df = spark.createDataFrame([('{"score": 1}',), ("broken{",), (None,)], "j string")
    assert [r.c for r in df.select(confidences(F.col("j")).alias("c")).collect()] == [[1.0], [], []]


@pytest.mark.parametrize(("token", "bad"), [("grxzpfq", True), ("05041981", False), ("aaaaaa", True), ("Straße", False), ("word", False)])
def test_gibberish(spark, token, bad):
    assert spark.range(1).select(quality.gibberish(F.lit(token)).alias("b")).first().b is bad


def test_iban_and_dates(spark):
    df = spark.createDataFrame([("DE89370400440532013000",), ("DE88370400440532013000",), ("XX12345678901234567",)], "s string")
    assert [r.p for r in df.select(validation.iban_problem(F.col("s")).alias("p")).collect()] == [None, "checksum", "country"]
    df = spark.createDataFrame([("06 06/19/80",), ("01 07 20 26",), ("02.08.2025 und 40/40/99",), ("02.082.2025",), (None,)], "s string")
    assert [tuple(r.d) for r in df.select(validation.date_counts(F.col("s")).alias("d")).collect()] == [(1, 1), (1, 1), (2, 1), (1, 1), (0, 0)]
    df = spark.createDataFrame([("45 06/19/80",), ("99 1 2 30 40",), ("3.4.1899, 12/31/99; 31/12/1999",), ("",)], "s string")
    assert [tuple(r.d) for r in df.select(validation.date_counts(F.col("s")).alias("d")).collect()] == [(1, 0), (1, 1), (3, 1), (0, 0)]


def test_validation_counters(spark):
    text = "IBAN DE88370400440532013000\nDiagnose: E10.9, U07.1\nName:\n| Ort: | __ | Tag: | 06 06/19/80 |\nhttps://x.example\n14:30\n\tCode: \t---\r\nok"
    df = spark.createDataFrame([(text,), (None,), ("",)], "s string").select(*validation.counters(F.col("s")))
    got = [r.asDict() for r in df.collect()]
    want = {"iban_total": 1, "iban_invalid": 1, "icd_total": 2, "icd_invalid": 1, "date_total": 1, "date_implausible": 1, "labelled_lines": 5, "orphan_labels": 3}
    assert got[0] == want and got[1] == got[2] == dict.fromkeys(want, 0)


def test_paths_and_rendering(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("v")).first().v

    assert value(paths.folder_path(F.lit(" a \\ b"), F.lit(None).cast("string"), F.lit("x/y"))) == "a/b"
    assert value(paths.folder_path(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("x/y/z"))) == "x/y"
    assert value(paths.folder_path(F.lit(None).cast("string"), F.lit(""), F.lit("x"))) == "inbox"
    assert value(rendering.block(F.lit("doc_title"), F.lit("# Kept"), F.lit(1))) == "# Kept"
    assert value(rendering.block(F.lit("figure"), F.lit(None).cast("string"), F.lit(3))) == "*[Figure on page 3]*"
    assert value(rendering.block(F.lit("text"), F.lit("☑ ja □ nein ○"), F.lit(1))) == "[x] ja [ ] nein ○"
    assert value(magic(F.lit(b"%PDF-1.7"))) == "pdf" and value(magic(F.lit(b"??"))) == "unknown"
    table = "<table><tr><td>a</td><td>b|c</td></tr><tr><td>1</td></tr></table>"
    assert value(rendering.block(F.lit("table"), F.lit(table), F.lit(1))) == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"
    assert value(rendering.block(F.lit("table"), F.lit("<table></table>"), F.lit(1))) == ""


@pytest.mark.parametrize(
    ("text", "plain", "count"),
    [
        (r"Name: $ \underline{\text{Mia}} $ $ \underline{\text{Mai}} $ $x^2$", "Name: Mia Mai $x^2$", 2),
        (r"$$ \underline{01}\underline{07}_{Tag\quad Monat} $$", "01 07 Tag Monat", 1),
        (r"$$ \begin{array}{c}\underline{0\underline{2}5}\\ Tag\end{array} $$", "0 2 5 Tag", 1),
        (r"$ \sum \underline{Tag} $", r"$ \sum \underline{Tag} $", 0),
        (r"$ \foo{Tag} $ $ {Tag $ $5 und $7", r"$ \foo{Tag} $ $ {Tag $ $5 und $7", 0),
        (r"$ Tag}} \ 3 $", "Tag 3", 1),
        ("$$", "$$", 0),
        ("", "", 0),
        (None, None, None),
    ],
)
def test_form_latex(spark, text, plain, count):
    df = spark.createDataFrame([(text,)], "s string")
    flat, n = form_latex.flatten_forms(F.col("s"))
    assert tuple(df.select(flat, n).first()) == (plain, count)


def test_workbooks(spark):
    from quillspark.plans.documents import workbook

    df = spark.createDataFrame([(1, bytearray(workbook("x", 4))), (2, bytearray(b"no zip")), (3, None)], "n long, raw binary")
    rows = sheets.rows_of(df, "n", "raw")
    assert [(r.n, r.error) for r in rows.filter("error is not null").orderBy("n").collect()] == [(2, "BadZipFile"), (3, "BadZipFile")]
    (got,) = sheets.markdown(rows, "n").collect()
    assert (got.n, got.sheet_count, got.row_count) == (1, 2, 2) and got.markdown.startswith("## Sheet: S0\n\n| na me | col_2 | no | col_4 |\n")
    assert sheets.markdown(sheets.rows_of(df.limit(0), "n", "raw"), "n").count() == 0
    assert [sheets.column_of(r) for r in ("A1", "Z9", "AA1", "")] == [0, 25, 26, -1]


def test_mail_documents(spark):
    m = mail()
    m.get_body(("html",)).add_related(b"png", maintype="image", subtype="png", cid="<i>", filename="p[1].png")
    df = spark.createDataFrame([(1, bytearray(m.as_bytes())), (2, None)], "n long, raw binary")
    mails = parsed(df, "n", "raw")
    text = {r.n: r.markdown for r in rendered(mails).collect()}
    assert "html body ![inline attachment" in text[1]
    done = spark.createDataFrame([(1, 1, "# Inner", 3)], "n long, index int, markdown string, pages long")
    got = {r.n: (r.markdown, r.page_count) for r in as_documents(mails, "n", done).collect()}
    assert got[2] == ("(empty email)", 1) and "\n\n---\n\n(skipped: z.zip — unsupported_type)" in got[1][0]


def test_byte_sizes_round_exact_halves_to_even(spark):
    rows = [(0,), (1023,), (1024,), (1024 + 256,), (1024 + 768,), (1048575,), (1050935296,), (5 * 2**30 + 2**28,), (2**63 - 1,), (None,)]
    got = [r.s for r in spark.createDataFrame(rows, "n long").select(paths.byte_size(F.col("n")).alias("s")).collect()]
    assert got == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.8 KB", "1024.0 KB", "1002.2 MB", "5.2 GB", "8589934592.0 GB", None]


def test_mail_headers_are_parsed_once_with_equal_results(monkeypatch):
    import email.policy

    from quillspark.sources import mail as source

    odd = b"Content-Type: multipart/mixed; boundary=q\nDate: x\nTo: a@x.example,\n b@x.example\nSubject: =?utf-8?q?=C3=BC?= " + b"y" * 2000 + b"\n\n--q\nContent-Type: bad\n\nb\n--q\nContent-Type: text/plain\nContent-Type: image/png\n\nc\n--q--\n"
    outer = EmailMessage()
    outer.set_content("see below")
    outer.add_attachment(mail())
    mails = [mail().as_bytes(), outer.as_bytes(), odd, b"", b"Subject: \xff\n\n\xff", b"Content-Type: text/html; charset=nope\n\n<p>x"]

    def tried(raw):
        try:
            return parse(raw)
        except LookupError as e:
            return str(e)

    got = [tried(m) for m in mails * 2]
    monkeypatch.setattr(source, "POLICY", email.policy.default)
    assert got == [tried(m) for m in mails * 2]
    monkeypatch.undo()
    raw, made, factory = mail().as_bytes(), [], email.policy.default.header_factory
    source._header.cache_clear()
    monkeypatch.setattr(type(factory), "__call__", lambda self, name, value, call=type(factory).__call__: made.append((name, value)) or call(self, name, value))
    parse(raw)
    assert made and len(made) == len(set(made))  # each was parsed at every look before


def test_checks_of_a_small_table_are_dealt_to_all_tasks(spark):
    from quillspark.plans import registry

    registry.load()
    out = registry.QUERIES["agg14_validation_counts"](spark, "/root/testdata/sf0.001")
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
