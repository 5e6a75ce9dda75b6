import random

from pyspark.sql import functions as F

from lodestone.operators import duplicates as dup
from lodestone.operators import graphs, snapshots

ITEM = "pos long, id string, url string, title string, date string, modified string, tags array<string>"


def slow_upserts(existing, incoming):
    """Row after row over a list, looked through each time. forgotten: keys that the walk no longer finds."""
    items, ids, urls = [], {}, {}
    for rows, new in ((existing, False), (incoming, True)):
        for r in sorted(rows):
            _, i, u, _, date, modified, tags = r
            at = ids[i] if i in ids else urls.get(u)
            if at is None:
                items.append((r, tags))
                ids[i] = urls[u] = len(items) - 1
                continue
            old, old_tags = items[at]
            a, b = modified or date, old[5] or old[4]
            if a > b or a == b and new:
                ids.pop(old[1], None)
                urls.pop(old[2], None)
                items[at] = (r, tags or old_tags)
                ids[i] = urls[u] = at
    return sorted((r[1], r[2], r[3], tuple(tags)) for r, tags in items)


def upserts(spark, existing, incoming, folder):
    found = snapshots.upserted(spark.createDataFrame(existing, ITEM), spark.createDataFrame(incoming, ITEM), str(folder))
    return sorted((r.id, r.url, r.title, tuple(r.tags)) for r in found.collect())


def test_chains_over_both_keys(spark, tmp_path):
    a, b, c = (0, "id1", "u1", "A", "2024-01-01", None, ["x"]), (0, "id2", "u1", "B", "2024-01-02", None, []), (1, "id2", "u2", "C", "2024-01-03", None, [])
    assert upserts(spark, [a], [b, c], tmp_path) == [("id2", "u2", "C", ("x",))] == slow_upserts([a], [b, c])
    older = (1, "id2", "u2", "C", "2023-01-01", None, [])
    assert upserts(spark, [a], [b, older], tmp_path) == [("id2", "u1", "B", ("x",))]
    assert upserts(spark, [], [a], tmp_path) == [("id1", "u1", "A", ("x",))] and upserts(spark, [], [], tmp_path) == []


def test_random_rows_equal_a_sequential_walk(spark, tmp_path):
    r = random.Random(5)
    for keys in (6, 40):
        row = lambda pos: (pos, f"i{r.randrange(keys)}", f"u{r.randrange(keys)}", f"t{pos}", f"2024-01-0{r.randint(1, 9)}", r.choice([None, f"2024-02-0{r.randint(1, 9)}"]), r.choice([[], ["a"], ["b", "c"]]))
        old, new = [row(k) for k in range(50)], [row(k + 1000) for k in range(50)]
        assert upserts(spark, old, new, tmp_path) == slow_upserts(old, new)


def test_components_of_a_long_chain(spark, tmp_path):
    order = list(range(64))
    random.Random(2).shuffle(order)
    rows = [(n, f"a{k // 2}", f"b{(k + 1) // 2}") for n, k in enumerate(order)] + [(1000, "z", None), (1001, None, None)]
    got = {r.row: r.component for r in graphs.row_components(spark.createDataFrame(rows, "row long, id string, url string"), ("id", "url"), str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows} and {got[n] for n in range(64)} == {0} and got[1000] == 1000 and got[1001] == 1001


def kept(spark, hits):
    frame = spark.createDataFrame([(1, n, *h) for n, h in enumerate(hits)], f"question_id long, rank int, {dup.HIT}")
    return sorted(dup.collapsed(frame).collect(), key=lambda r: r.place)


def test_a_pair_is_one_row_with_both_sentences_and_the_richer_locator(spark):
    short = ("principle:medium:what-is-bitcoin-aaa", "principle", "education/medium--what-is-bitcoin-aaa.md", "What is Bitcoin", None, "Bitcoin is electronic cash.", ["Money"])
    long = ("essay:medium:what%2Dis-bitcoin-aaa", "essay", "csw://essay/medium/what-is-bitcoin-aaa", "What is Bitcoin", None, "Bitcoin is electronic cash. Settlement is final.", ["Law"])
    (row,) = kept(spark, [short, long])
    assert row.id == short[0] and row.locator == long[2] and row.excerpt == long[5] and row.themes == ["Money", "Law"]
    assert set(row.aliases) == {long[0], long[2]}
    more = (*short[:5], "Cash needs no issuer. Bitcoin is electronic cash", [])
    (row,) = kept(spark, [long, more])
    assert row.excerpt.startswith("Bitcoin is electronic cash. Settlement is final.") and row.excerpt.count("Cash needs no issuer.") == 1


def test_titles_days_and_wording(spark):
    same = "Bitcoin is peer-to-peer electronic cash with no trusted issuer."
    essay = lambda i, title, date, text: (f"essay:medium:{i}", "essay", None, title, date, text, None)
    rows = kept(spark, [essay("aaa", "What is Bitcoin", "2018-06-01", same), essay("copy", "What Is Bitcoin", "2018-06-01", same), essay("bbb", "What is Bitcoin", "2024-02-02", same)])
    assert [r.id for r in rows] == ["essay:medium:aaa", "essay:medium:bbb"] and rows[0].aliases == ["essay:medium:copy"]
    rows = kept(spark, [essay("cash", "T", None, same + " Its supply is fixed."), essay("tax", "T", None, "Capital gains arise when coins are sold and must be reported to the authority."), ("n", "mail", None, "T", None, same, None), ("m", "mail", None, "T", None, same, None)])
    assert len(rows) == 4  # only paired kinds collapse by title
    assert kept(spark, [("x", None, None, None, None, None, None), ("y", "essay", None, "", None, None, None)])[1].excerpt == ""


def test_keys(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = lambda x: F.lit(x).cast("string")
    assert one(dup.pair_key(lit("x"), lit("education/substack--A%20b.md"))) == "substack:a b" and one(dup.pair_key(lit("mail:1"), lit(None))) is None
    assert one(dup.title_key(lit(" It's — A ‘Title’! "))) == "its a ‘title".replace("‘", "") and one(dup.title_key(lit("!!"))) is None
    stop = ("bitcoin",)
    assert one(dup.series_key(lit("Tax and Bitcoin — income"), stop)) == one(dup.series_key(lit("Taxing Bitcoin — VAT"), stop)) == "tax"
    key = lambda kind, themes, title: one(dup.cluster_key(lit("i"), lit(kind), F.lit(themes).cast("array<string>") if themes is None else F.array(*map(F.lit, themes)), lit(title)))
    assert key("Primary", None, "x") == "primary" and key("e", [" Law "], "x") == "theme:law" and key("e", None, "Fixed Rules: a") == "series:fix-rul"
    assert key("e", None, "a") == "title:a" and key("e", [""], None) == "id:i"
