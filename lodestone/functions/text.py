"""Column expressions on text. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Named entities that pages use; &amp; comes last, so that what it makes isn't decoded again.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "middot": "·", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "amp": "&"}
BLOCK_TAGS = "p|div|br|li|ul|ol|tr|table|h[1-6]|blockquote|pre|section|article|header|footer|nav|hr"
INLINE_TAGS = "a|b|i|u|em|strong|span|small|code|img|sup|sub|font|html|body|head|title|meta|link|td|th|tbody"
#: UTF-8 that was read as Windows-1252, and what it was.
MOJIBAKE = {"â€™": "’", "â€˜": "‘", "â€œ": "“", "â€\x9d": "”", "â€“": "–", "â€”": "—", "â€¦": "…", "Â©": "©", "Â·": "·", "Ã©": "é", "Ã¨": "è", "Ã¼": "ü", "Ã¶": "ö", "Ã¤": "ä"}


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), where value is computed once, however often `of` uses it: as a lambda's variable."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def decoded(text: Column) -> Column:
    """Numeric entities, decimal or hexadecimal, then named ones in either case. Codes of no character vanish."""
    numbers = ((r"&#([0-9]{1,7});", "&#", 10), (r"&#[xX]([0-9a-fA-F]{1,6});", "&#[xX]", 16))

    def coded(out: Column) -> Column:
        for pattern, prefix, base in numbers:
            out = bound(out, lambda x: F.aggregate(F.array_distinct(F.regexp_extract_all(x, F.lit(pattern), F.lit(1))), x, _with_code(prefix, base)))
        return out

    def named(out: Column) -> Column:
        for name, value in ENTITIES.items():
            out = F.regexp_replace(out, f"(?i)&{name};", value)
        return out

    known = bound(text, lambda x: F.when(F.contains(x, F.lit("&#")), coded(x)).otherwise(x))
    return bound(known, lambda x: F.when(F.contains(x, F.lit("&")), named(x)).otherwise(x))


def _with_code(prefix: str, base: int) -> Callable[[Column, Column], Column]:
    def put(text: Column, digits: Column) -> Column:
        code = F.conv(digits, base, 10).cast("int")
        whole = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(whole, code).otherwise(0x20)), 8, "0")), "UTF-32")
        return F.regexp_replace(text, F.concat(F.lit(prefix), digits, F.lit(";")), F.when(~whole, "").when(char.isin("$", "\\"), F.concat(F.lit("\\"), char)).otherwise(char))

    return put


def html_text(html: Column) -> Column:
    """Known block tags become line ends, known inline tags vanish, other <x> stay, entities are decoded after that."""
    out = F.regexp_replace(html, rf"(?i)</?(?:{BLOCK_TAGS})(?:\s[^>]*)?/?>", "\n")
    out = F.regexp_replace(out, rf"(?i)</?(?:{INLINE_TAGS})(?:\s[^>]*)?/?>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(decoded(out), r"[ \t]+", " "), r" ?\n[ \n]*", "\n"))


def page_text(html: Column) -> Column:
    """As html_text without comments, scripts, styles and frames, on one line."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "noscript", "iframe"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(html_text(out), r"\s+", " "))


def repaired(text: Column) -> Column:
    out = text
    for bad, good in MOJIBAKE.items():
        out = F.replace(out, F.lit(bad), F.lit(good))
    return F.when(text.rlike("[ÂÃâ]"), out).otherwise(text)


def clipped(text: Column, limit: int = 400, least: int = 40) -> Column:
    """The text, or its longest beginning of whole sentences of at most limit characters; without one of at least `least`
    the longest beginning of whole words. A full stop after a digit ends no sentence."""
    sentence = F.regexp_extract(F.substring(text, 1, limit + 1), rf"(?s)^(.{{0,{limit - 1}}}(?:(?<![0-9])\.|[!?]))\s", 1)
    words = F.rtrim(F.regexp_extract(F.substring(text, 1, limit), r"(?s)^(.*)\s\S*$", 1))
    cut = F.when(F.length(sentence) >= least, sentence).when(F.length(words) > 0, words).otherwise(F.substring(text, 1, limit))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def computed(rows: DataFrame) -> DataFrame:
    """The same rows; filters and columns that come later use the columns as they are here, instead of computing them anew
    in each place. Spark moves nothing past a generator, which here gives one row for one."""
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("row")).select("row.*")


def unquoted(text: Column) -> Column:
    """Without lines that quote with >, and without all from a signature or footer line of dashes on."""
    lines = F.split(F.split(text, r"\n-{5,}", 2)[0], "\n")
    return F.array_join(F.filter(lines, lambda x: ~F.startswith(x, F.lit(">"))), "\n")


def canonical_url(url: Column) -> Column:
    """https, lower-case host without www, no fragment, no tracking parameters, no slashes at the end. Anything that isn't
    an http address stays as it is."""
    raw = F.trim(url)
    part = lambda i: F.regexp_extract(raw, r"(?i)^https?://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", i)
    host = F.regexp_replace(F.lower(part(1)), r"^www\.", "")
    path = F.regexp_replace(part(2), "/+$", "")
    kept = F.filter(F.split(F.regexp_replace(part(3), r"^\?", ""), "&"), lambda p: (p != "") & ~p.rlike("(?i)^(utm_[^=]*|fbclid|mc_cid|mc_eid)(=|$)"))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(raw.rlike("(?i)^https?://[^/?#]"), F.concat(F.lit("https://"), host, F.when(path == "", "/").otherwise(path), query)).otherwise(raw)


def normal_question(text: Column) -> Column:
    """Lower case, punctuation dropped, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def words(text: Column) -> Column:
    """Lower-case words of letters and digits in any language, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


#: Closed word classes of the four languages of the driver's documents, form by form: articles; personal pronouns and
#: possessives; forms of be and have; prepositions; conjunctions and negation.
STOP_WORDS = " ".join(
    (
        # English
        "the a an this that these those",
        "i me my you your he him his she her it its we us our they them their who which what",
        "am is are was were be been has have had will would can",
        "of to in on at by for from with into",
        "and or but if as than so not",
        # German
        "der die das den dem des ein eine einen einem einer dieser",
        "ich du er sie es wir ihr mich sich sein ihre",
        "bin ist sind war waren hat haben wird werden",
        "von zu zum zur im am mit auf für aus bei nach um",
        "und oder aber wenn dass als auch wie nicht",
        # French
        "le la les un une du ce cette ces",
        "je tu il elle nous vous ils elles se son sa ses leur qui que",
        "est sont été a ont avait sera",
        "de des à au aux en dans par pour sur avec",
        "et ou mais si comme ne pas",
        # Spanish
        "el los las lo unos una uno del este esta",
        "yo tú él ella nosotros ellos me su sus mi quien",
        "es son fue era ha han será",
        "con por para sin al desde hasta",
        "y o pero como más no ni",
    )
).split()


def content_words(text: Column) -> Column:
    """Words without function words and single letters; digits stay."""
    return F.filter(words(text), lambda w: ~w.isin(*sorted(set(STOP_WORDS))) & ((F.length(w) > 1) | w.rlike("^[0-9]$")))


def stem(word: Column) -> Column:
    """A light English stem: ing, ed, es, s."""
    n = F.length(word)
    cut = lambda k: F.substr(word, F.lit(1), n - k)
    return F.when((n > 5) & F.endswith(word, F.lit("ing")), cut(3)).when((n > 4) & F.endswith(word, F.lit("ed")), cut(2)).when((n > 4) & F.endswith(word, F.lit("es")), cut(2)).when((n > 3) & F.endswith(word, F.lit("s")) & ~F.endswith(word, F.lit("ss")), cut(1)).otherwise(word)


def subject_terms(text: Column) -> Column:
    """Distinct stems of content words, three letters at least, in order of appearance."""
    return F.array_distinct(F.filter(F.transform(content_words(text), stem), lambda w: F.length(w) >= 3))
