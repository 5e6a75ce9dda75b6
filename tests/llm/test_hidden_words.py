from collections import Counter

import pyarrow as pa

from lodestone.llm import toxicity


def test_nothing_hidden_is_passed_over():
    """Signs before a full stop, what follows the 64th character, doubled letters; whole addresses stay as they are."""
    known = ["bastard", "asshole", "pathetic", "stupid", "letter", "please", "write", "about", "gardens", "tomorrow", "people", "here"]
    counts = Counter()
    for w in known:
        for g in toxicity.trigrams(w):
            counts[g] += 50
    model = toxicity.CharModel(dict(counts))
    joined = ".".join(["please", "write", "about", "gardens", "tomorrow"] * 3 + ["b@stard", "please"])
    text = f"b@stard. @ssh0le. p@thetic. stuupiid letter  a.bastard1@example.org. {joined}"
    found = toxicity.Restored(pa.array([text]), model, {})
    reads = dict(zip(text.split(), (found.readings[c] for c in found.codes.tolist())))
    assert "bastard" in reads["b@stard."] and "asshole" in reads["@ssh0le."] and "pathetic" in reads["p@thetic."]
    assert "stupid" in reads["stuupiid"] and reads["letter"] == ["letter"]
    assert reads["a.bastard1@example.org."] == ["a.bastard1@example.org"]
    assert len(joined.split("b@")[0]) > 64 and "bastard" in reads[joined]


def test_separators_of_any_length():
    """Runs of separators, also of several kinds, are one step: they neither cut a word nor lengthen it."""
    counts = Counter()
    for w in ["idiot", "please", "write", "letter"]:
        for g in toxicity.trigrams(w):
            counts[g] += 50
    model = toxicity.CharModel(dict(counts))
    for run in ["-" * 40, "-" * 58, "-" * 70, "-" * 140, "-" * 5000, "-.*" * 100, "i" * 300]:
        assert "idiot" in toxicity.readings(f"i{run}d.i.o.t", model)
        assert "idiot" in toxicity.readings(f"{'please.write.' * 9}i{run}d.i.o.t", model)


def test_stretches_cover_the_word():
    for n in (0, 1, 31, 32, 33, 63, 64, 65, 96, 97, 128, 129, 1000):
        word = ("ab" * n)[:n]
        parts = toxicity.stretches(word)
        assert max(map(len, parts)) <= toxicity.LONGEST and parts[-1][-1:] == word[-1:]
        assert all(any(word[k : k + 32] in part for part in parts) for k in range(max(1, n - 31)))
        assert (len(parts) == 1) == (n <= 64)
