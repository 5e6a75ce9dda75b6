import duckdb
from pyspark.sql import functions as F

from lodestone.operators import evidence, retrieval
from lodestone.plans import archives as plans
from lodestone.sources import archives


def test_nested_quotes(spark):
    rows = ['a<div class="quote">x<div>y</div>z</div>b', 'a<div class="quoteheader">q</div><div class="quote" id="1">w</div>b', 'keep<div class="quote">never ends', "plain <div>d</div>", None]
    got = [r.x for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, h string").select("i", archives.without_quotes(F.col("h")).alias("x")).orderBy("i").collect()]
    assert got == ["ab", "ab", "keep", "plain <div>d</div>", None]


def test_mail(spark, tmp_path):
    (tmp_path / "a.html").write_text('<div class="message author" id="email-1"><strong>Subject</strong>: Hi &amp; ho<strong>Date</strong>: 1 Jan 2009<pre>Text &lt;one&gt;</pre></div><div class="message other" id="email-2"><pre>no</pre></div><div class="message author" id="email-3"><pre>two</pre></div>')
    got = archives.html_mail(archives.whole_files(spark, str(tmp_path / "a.html")), "author").orderBy("id").collect()
    assert [(r.id, r.title, r.date, r.text) for r in got] == [("email-1", "Hi & ho", "1 Jan 2009", "Text <one>"), ("email-3", "Untitled", None, "two")]
    (tmp_path / "b.md").write_text("# Heading\n\nFrom a@b.org Thu Jan 1\nSubject: One\nSubject: Two\nSent: 2 Jan 2009\n\nBody line\nmore\n---\nSource files: x\n")
    r = archives.markdown_mail(archives.whole_files(spark, str(tmp_path / "b.md"))).first()
    assert (r.sender, r.subject, r.date, r.body) == ("a@b.org", "One", "2 Jan 2009", "Body line\nmore")
    files = spark.createDataFrame([("a", ""), ("b", None), ("c", "FROM: x@y\n folded\nno field: z\n---\nkept"), ("d", "text\n---\nmore\n---\nExternal link: u\nend")], "file string, value string")
    got = {m.file: (m.sender, m.subject, m.date, m.body) for m in archives.markdown_mail(files).collect()}
    assert got == {"a": (None, "Untitled", None, ""), "b": (None, "Untitled", None, None), "c": ("x@y", "Untitled", None, "no field: z\n---\nkept"), "d": (None, "Untitled", None, "text")}


def test_catalogue(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# List\n\n> Indexes 2 live apps, 1 building blocks and 1 organisations.\n\n### One\nURL: https://x.org/apps/one\nTags: a, b\nLast updated: 2024-02-30\nDescription: d\n\n### Two\nURL: https://x.org/apps/two\n\n### Three\nURL: https://x.org/nowhere/three\n")
    sections = archives.catalogue_sections(spark, str(tmp_path / "c.txt"))
    entries = archives.catalogue_entries(sections)
    got = {r.name: (r.section, r.id, r.tags, r.last_updated) for r in entries.collect()}
    assert got == {"One": ("apps", "one", ["a", "b"], None), "Two": ("apps", "two", [], None), "Three": (None, "three", [], None)}
    assert {r.section: (r.declared, r.found) for r in archives.declared_counts(sections, entries).collect()} == {"apps": (2, 2), "blocks": (1, 0), "orgs": (1, 0)}


def test_angles_and_expansions(spark):
    rows = [(1, k, k, f"th{k % 3}", "essay", False) for k in range(1, 9)] + [(1, 9, 9, "th0", "primary", False)]
    c = spark.createDataFrame(rows, "question_id long, doc_id long, rank long, theme string, tier string, on_subject boolean")
    assert evidence.angles(c, 1).filter("lead").count() == 1
    got = evidence.broad_pick(c, 1, 4).collect()
    assert len(got) == 4 and 9 in {r.doc_id for r in got}
    q = spark.createDataFrame([(1, "why the 1 mb limit on blocks"), (2, "thanks"), (3, "merkle branch inclusion")], "question_id long, question string")
    out = {(r.question_id, r.query) for r in retrieval.expanded(q, [(r"(?i)1\s*mb", "block size limit")], [(r"(?i)merkle", "merkle")]).collect()}
    assert out == {(1, "block size limit"), (1, "limit"), (3, "merkle")}
    assert {r.question_id: (r.courtesy, r.bare, r.short) for r in retrieval.reply_skips(q).collect()} == {1: (False, False, False), 2: (True, True, True), 3: (False, False, True)}


def test_expansions_and_their_sql_know_the_letters_of_all_languages(spark, tmp_path):
    texts = ["sie bütion hat drei", "an tion, here", "tion", "_tion 7", "möble élan", "tion2 ble", "äthe of them", "the\n of x", "ewas now gut", "ñwas  nun", "It WAS so", "x²tion", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, plans.question_expansions(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    assert got == sorted(con.sql(plans.ORACLE_SQL["question_expansions"]).fetchall())
    added = {i for i, q in got if q in ("ending", "able words")}
    assert added == {1, 2, 5, 11} and {i for i, q in got if q in ("the of", "was")} == {7, 10}
