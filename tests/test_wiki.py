from pyspark.sql import functions as F

from quillspark.functions.wiki import markdown_of, relink, relinked, to_markdown


def test_markdown():
    html = """<h2>Title</h2><div class="page-metadata">by x</div><p>One <b>two</b> <a href="/pages/7/x">link</a><script>no</script> <a href="javascript:x">plain</a></p>
    <ul><li>a</li><li>b <code>c</code></li></ul><pre class="language-sql">SELECT  1</pre><div class="macro-info"><p>Mind</p><p>this</p></div><img src="i.png" alt="pic">"""
    assert to_markdown(html, "https://w.example/wiki/") == (
        "## Title\n\nOne **two** [link](https://w.example/pages/7/x) plain\n\n- a\n- b `c`\n\n```sql\nSELECT  1\n```\n\n> Mind\n>\n> this\n\n![pic](https://w.example/wiki/i.png)"
    )
    assert to_markdown(None) == to_markdown("<script>x") == ""


def test_links(spark):
    text = "[a](https://w/pages/7/x) ![a](https://w/pages/7/x) [b](https://w/x?pageId=8) [c](https://w/pages/9)"
    want = "[a](/jobs/j7) ![a](https://w/pages/7/x) [b](/jobs/j8) [c](https://w/pages/9)"
    assert relinked(text, {"7": "j7", "8": "j8"}) == want
    df = spark.createDataFrame([(text, {"7": "j7", "8": "j8"}, "<p>x</p>", None), (None, None, None, None)], "t string, m map<string,string>, h string, b string")
    got = df.select(relink(F.col("t"), F.col("m")).alias("r"), markdown_of(F.col("h"), F.col("b")).alias("k")).collect()
    assert [tuple(r) for r in got] == [(want, "x"), ("", "")]
