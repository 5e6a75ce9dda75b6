"""Personal data: fixed patterns, and terms that reveal what the patterns protect. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import documents, told_apart, whole_text, written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: The contract's patterns, with possessive loops where nothing after them could take characters back, so that Java's
#: matcher doesn't recurse; \G and the look-behind try a run of characters only where it begins (or goes on after a match).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
SPAN = "struct<kind:string,start:int,end:int,value:string>"

#: Code points before and after a protected entity in which a term counts as occurring with it. What is told by these
#: co-occurrences is looked for in all texts, wherever it stands.
CONTEXT = 80
#: Letters a term has at least.
TERM_LETTERS = 4
#: A further occurrence of a term, not seen and not with the entity, that its p(e|t) is estimated with.
UNSEEN = 1
#: Bits of an entity's information that a term must leave at most to be generalised, and to be removed; and the share of it
#: that it must give away in any case.
GENERALISE, REMOVE, SHARE = 1.0, 0.42, 0.8
#: Terms, and places of terms, up to which they are broadcast; beyond that Spark joins them by shuffles.
BROADCAST_TERMS = 200_000


WORDS = rf"(?<!\p{{L}})\p{{L}}{{{TERM_LETTERS},}}+"


def matches(text: Column, pattern: str | Column, kind: str) -> Column:
    """All matches as spans in code points: the pieces between them and the matches, walked side by side."""
    empty = F.array().cast(f"array<{SPAN}>")
    pattern = F.lit(pattern)
    parts = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["0"])
        end = start + F.length(F.coalesce(x["1"], F.lit("")))
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["1"].alias("value"))
        return F.struct(end.alias("pos"), F.when(x["1"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], span)).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("pos"), empty.alias("out")), step, lambda acc: acc["out"])


def luhn(digits: Column) -> Column:
    """The check sum of a digit string: every second digit from the right counts twice, less nine from ten on."""

    def step(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The contract's spans by kind as listed, then start."""
    of = []
    for kind in KINDS:
        found = F.filter(matches(text, PATTERNS[kind], kind), lambda s: valid(kind, s["value"]))
        there = F.contains(text, F.lit(NEEDED[kind])) if NEEDED[kind] else text.rlike("[0-9]")
        of.append(F.when(there, found).otherwise(F.array().cast(f"array<{SPAN}>")))
    return F.concat(*of)


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), spans, and around: for each span its entity and the words beside it as term spans.

    Written, as every later step reads it; the text itself isn't kept.
    """
    text = F.col("text")
    with_spans = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).select("doc_id", "text", base_spans(text).alias("spans"))
    def beside(s: Column) -> Column:
        # one code point more on each side tells whether the outermost word is whole
        begin = F.greatest(s["start"] - CONTEXT - 1, F.lit(0))
        left = F.substr(text, begin + 1, s["start"] - begin)
        right = F.substr(text, s["end"] + 1, F.lit(CONTEXT + 1))
        cut_left = F.when(begin > 0, F.length(F.regexp_extract(left, r"^\p{L}*", 0))).otherwise(0)
        whole_right = F.when(F.length(right) > CONTEXT, F.length(right) - F.length(F.regexp_extract(right, r"\p{L}*+$", 0))).otherwise(F.length(right))
        at_left = F.transform(F.filter(matches(left, WORDS, TERM), lambda t: t["start"] >= cut_left), lambda t: F.struct((t["start"] + begin).alias("start"), (t["end"] + begin).alias("end"), F.lower(t["value"]).alias("term")))
        at_right = F.transform(F.filter(matches(right, WORDS, TERM), lambda t: t["end"] <= whole_right), lambda t: F.struct((t["start"] + s["end"]).alias("start"), (t["end"] + s["end"]).alias("end"), F.lower(t["value"]).alias("term")))
        return F.struct(F.concat(s["kind"], F.lit(":"), F.lower(s["value"])).alias("entity"), F.concat(at_left, at_right).alias("terms"))

    around = F.when(F.size("spans") > 0, F.transform("spans", beside))
    return written(with_spans.select("doc_id", F.sha2(text, 256).alias("digest"), "spans", around.alias("around")), "marked")


def revealing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """digest, start, end, term, left: terms that leave at most GENERALISE bits of a protected entity, wherever they stand.

    From counts over all texts: p(e|t) is the share of the term's occurrences that stand with the entity, with UNSEEN more
    that don't, p(e) the entity's share of all words; the term leaves -log2(p(e|t)) of the entity's -log2(p(e)) bits. What may
    be left doesn't drift with the size of the corpus, and twice the same corpus gives the same spans. All pairs count, also
    those of one text.
    """
    pairs_of = F.array_distinct(F.flatten(F.transform("around", lambda a: F.transform(a["terms"], lambda t: F.struct(a["entity"].alias("entity"), t["term"].alias("term"), t["start"].alias("start"), t["end"].alias("end"))))))
    rows = found.filter("around is not null").select("digest", F.explode(pairs_of).alias("p")).select("digest", "p.*")
    # one row for each place in a text, with the number of copies: copies are added up before anything is joined
    places = written(rows.groupBy("digest", "entity", "term", "start", "end").agg(F.count("*").alias("n")), "places")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(whole_text()), F.lit(WORDS), F.lit(0))).alias("term"))
    pairs = places.groupBy("entity", "term").agg(F.sum("n").alias("n_te"))
    counts = written(words.groupBy("term").agg(F.count("*").alias("n_t")), "terms")
    total = F.broadcast(counts.agg(F.sum("n_t").alias("n")))  # one row
    entities = found.filter("around is not null").select(F.explode("around").alias("a")).groupBy(F.col("a.entity").alias("entity")).agg(F.count("*").alias("n_e"))
    known = -F.log2(F.least(F.col("n_e") / F.col("n"), F.lit(1.0)))
    left = -F.log2(F.least(F.col("n_te") / (F.col("n_t") + UNSEEN), F.lit(1.0)))
    told = written(pairs.join(counts, "term").join(entities, "entity").join(total).withColumn("left", left).filter((F.col("left") <= GENERALISE) & (F.col("left") <= (1 - SHARE) * known)).select("entity", "term", "left", (F.col("n_t") > F.col("n_te")).alias("elsewhere")), "told")
    beside = places.join(told, ["entity", "term"]).select("digest", "start", "end", "term", "left")
    return beside.unionByName(standing_elsewhere(docs, told.filter("elsewhere").groupBy("term").agg(F.min("left").alias("left"))))


def up_to_size(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_TERMS else df


def standing_elsewhere(docs: DataFrame, told: DataFrame) -> DataFrame:
    """digest, start, end, term, left: all places of the terms told (term, left) in all texts."""
    text = whole_text()
    told = written(told, "told-elsewhere")
    words = docs.select(F.sha2(text, 256).alias("digest"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0)))).alias("term"))
    held = words.join(up_to_size(told, told.count()), "term").groupBy("digest").agg(F.array_sort(F.collect_set(F.struct("term", "left"))).alias("held"))
    held = written(held, "held")
    size = held.agg(F.coalesce(F.sum(F.size("held")), F.lit(0)).alias("n")).first().n
    # each text is searched for its own terms alone: letters, so nothing to quote
    pattern = F.concat(F.lit(r"(?<!\p{L})(?iu:"), F.array_join(F.transform("held", lambda t: t["term"]), "|"), F.lit(r")(?!\p{L})"))
    texts = docs.select(F.sha2(text, 256).alias("digest"), text.alias("text")).join(up_to_size(held, size), "digest")
    spans = texts.select("digest", "held", F.explode(matches(F.col("text"), pattern, TERM)).alias("s"))
    own = F.get(F.filter("held", lambda t: t["term"] == F.lower(F.col("s.value"))), F.lit(0))
    return spans.select("digest", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.lower("s.value").alias("term"), own["left"].alias("left")).filter("left is not null")


def all_spans(docs: DataFrame) -> DataFrame:
    """doc_id, digest, spans (base) and terms (the method's spans: start, end, value, left) for each row of docs."""
    found = marked(docs)
    terms = revealing(docs, found).groupBy("digest", "start", "end").agg(F.min(F.struct("left", F.col("term").alias("value"))).alias("m"))
    by_text = written(terms.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", "end", "m.value", "m.left"))).alias("terms")), "by-text")
    joined = found.select("doc_id", "digest", "spans").join(by_text, "digest", "left")
    free = F.filter("terms", lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return joined.select("doc_id", "digest", "spans", F.coalesce(free, F.array().cast("array<struct<start:int,end:int,value:string,left:double>>")).alias("terms"))


def listed(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs (doc_id, text; others are ignored).

    A null text is empty; null and repeated ids keep their rows; an empty table gives none; no spans give an empty string."""
    rows = all_spans(docs)
    base, terms = listed(F.col("spans")), listed(F.transform("terms", lambda t: F.struct(F.lit(TERM).alias("kind"), t["start"].alias("start"), t["end"].alias("end"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"), F.concat_ws(",", F.concat(base, terms)).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced: base spans by [KIND], terms removed ([REMOVED]) or generalised to their
    first two letters and *, wherever they stand. All columns stay, whatever their names; other texts stay as they are, nulls too."""
    columns = docs.columns
    digest, spans, terms = fresh(columns, "digest"), fresh(columns, "spans"), fresh(columns, "terms")
    by_text = all_spans(docs.select("doc_id", "text")).filter("size(spans) > 0 or size(terms) > 0").dropDuplicates(["digest"]).select(F.col("digest").alias(digest), F.col("spans").alias(spans), F.col("terms").alias(terms))
    by_text = written(by_text, "by-text")
    base = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("tag")))
    told = F.transform(terms, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["left"] <= REMOVE, F.lit("[REMOVED]")).otherwise(F.concat(F.substr(t["value"], F.lit(1), F.lit(2)), F.lit("*"))).alias("tag")))
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        covered = s["start"] < acc["pos"]  # an overlapping span has its start covered already
        added = F.concat(acc["out"], F.substr(text, acc["pos"] + 1, s["start"] - acc["pos"]), s["tag"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(covered, acc["out"]).otherwise(added).alias("out"))

    clean = F.aggregate(F.array_sort(F.concat(base, told)), F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, acc["pos"] + 1, F.length(text))))
    asked, alone = told_apart(docs, F.sha2(whole_text(), 256), by_text, F.col(digest))  # texts without any span meet nothing
    joined = asked.withColumn(digest, F.sha2(whole_text(), 256)).join(by_text, digest, "left")
    return joined.withColumn("text", F.when(F.col(spans).isNotNull(), clean).otherwise(text)).select(columns).union(alone.select(columns))


def fresh(columns: list[str], name: str) -> str:
    """A column name that none of columns has, in any case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name


def op4_disclosure_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))
