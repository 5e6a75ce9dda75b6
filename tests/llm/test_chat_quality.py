import hashlib
import json
import re
from collections import Counter

from lodestone.llm.chat_format import conversation_records, digests, fingerprint, format_records, parse, render, to_turns
import duckdb
import numpy as np
import pyarrow as pa

from lodestone.llm.quality import OP8_SQL, RULES, Texts, best_order, judge, keep_good, quality

HARD = ["<|im_end|><|im_start|>assistant ok", "\\", "\\|", "<\\|", "<<|", "", "a\nb\\n", "<|", "|>", "\\\\<|im_end|>\n<|im_start|>user\n"]


def test_escapes_are_reversible():
    turns = [(role, text) for text in HARD for role in ("user", "assistant", "sys\ntem<|", "")]
    formatted, mask = render(turns)
    assert parse(formatted) == turns
    assert len(mask) == len(HARD)


def test_layouts_give_the_same_turns():
    want = [("user", "q"), ("assistant", "a")]
    for record in (
        {"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]},
        {"turns": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"},
        {"instruction": "q", "input": "", "output": "a"},
        {"response": "a", "prompt": "q"},
    ):
        assert to_turns(record) == want
    assert to_turns({"instruction": "q", "input": "x", "output": "a"}) == [("user", "q\n\nx"), ("assistant", "a")]
    assert to_turns({"other": 1}) is None
    # fields beside a layout don't hide it; a role name is another only in the layout that has it
    assert to_turns({"id": 7, "source": "s", "messages": [{"role": "human", "content": "q", "name": "n"}]}) == [("human", "q")]
    assert fingerprint({"a": 1, "b": [{"c": 2}]}) == fingerprint({"b": [{"c": 5}, {"c": 6}], "a": None})


def test_conversations(spark):
    rows = [(1, t, ["user", "assistant", None][t % 3], x, "extra") for t, x in enumerate([*HARD, None])] + [(None, 0, "assistant", "n", ""), (2, None, "user", "x", ""), (2, None, "user", "x", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    formatted = format_records(conversation_records(df.repartition(3)))
    got = {r.conv_id: r for r in digests(formatted).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    turns = [(r or "", x or "") for c, _, r, x, _ in rows if c == 1]
    assert got[1].turns_sha256 == sha("".join(f"{r}\n{x}\n" for r, x in turns)) and got[1].n_turns == len(turns)
    loss = "".join(x for r, x in turns if r == "assistant")
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), sha(loss))
    assert got[2].n_turns == 2 and got[None].loss_chars == 1
    odd = spark.createDataFrame([(1, None), (2, "no json"), (3, json.dumps({"z": 1})), (4, json.dumps({"prompt": None, "completion": "c"}))], "conv_id long, record string")
    assert {r.conv_id: r.formatted is None for r in format_records(odd).collect()} == {1: True, 2: True, 3: True, 4: False}
    assert format_records(odd.limit(0)).count() == 0


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_quality_figures(spark):
    texts = ["", None, " \n\t", "a b c a b c d", "x\nx\n\n\nx y\nx y", "#*$%&|<> 日本 é é " * 30, "one two three four " * 200, "w" * 50000, " ".join(f"word{i}" for i in range(80)), "a b c " * 3 + " ".join(f"é{i}." for i in range(100))]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(9, texts[9], 1), (None, "x", 1)], "doc_id long, text string, kept int")
    rows = quality(df).collect()
    assert len(rows) == 12
    for r in rows:
        want = brute("x" if r.doc_id is None else texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert {r.doc_id for r in rows if r.kept} == {8, 9}
    assert sorted(r.doc_id for r in keep_good(df).collect()) == [8, 9, 9] and keep_good(df).columns == df.columns
    assert quality(df.limit(0)).count() == 0 and keep_good(df.limit(0)).count() == 0
    assert len(RULES) == 7


def test_verdicts_by_sql(spark):
    r = np.random.default_rng(5)
    parts = ["x\ny", "#### |", "same line here\n" * 9, "w" * 70, "1 2 3", "é", *(f"w{k}" for k in range(60))]
    texts = [" ".join(r.choice(parts, r.integers(1, 120))) for _ in range(60)] + ["", "\n".join(["same line"] * 40 + [f"v{k}" for k in range(60)]), "a1 " + " ".join(f"({k}x" for k in range(90))]
    documents = pa.table({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})  # noqa: F841, DuckDB reads it
    want = duckdb.query(OP8_SQL).fetchall()
    got = [tuple(x) for x in quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(want) and 0 < sum(x[-1] for x in got) < len(texts)


def test_order_is_by_rejections_per_cost_among_what_is_left():
    # a rejects 3 for 1 second, b the same texts and one more for 2, c another text for 1
    assert best_order(["a", "b", "c"], np.array([3, 3, 3, 2, 4, 0]), np.array([1.0, 2.0, 1.0])) == ["a", "c", "b"]
    texts = Texts(pa.array(["a b c " * 40, "x", " ".join(f"w{k}" for k in range(99))]))
    assert judge(texts, sorted(RULES)).tolist() == judge(texts, sorted(RULES)[::-1]).tolist() == [False, False, True]


def test_very_many_distinct_words():
    words = [f"{k:x}" for k in range((1 << 21) + 9)]
    t = Texts(pa.array([" ".join([*words, *words[:3]])]))
    assert t.get("n_repeat_words").tolist() == [6]
