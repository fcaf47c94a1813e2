"""Diffs against the standard library's, in bounded time, and texts rebuilt from them."""

import difflib
import random
import time

import pytest

from relsift.operators import diffing


def standard(old, new):
    return list(difflib.unified_diff(old, new, "a/f", "b/f", lineterm=""))


def edited(r, lines, words):
    out = list(lines)
    for _ in range(r.randint(1, 12)):
        i = r.randrange(len(out) + 1)
        out[i : i + r.randint(0, 9)] = [r.choice(words) for _ in range(r.randint(0, 9))]
    return out


@pytest.mark.parametrize("few", [diffing.FEW, -(10**9)])
def test_equal_to_the_standard_library(monkeypatch, few):
    """Also with hashes alone, and with lines so frequent that they begin no match."""
    monkeypatch.setattr(diffing, "FEW", few)
    r = random.Random(4)
    for case in range(120):
        words = [f"w{i}\n" for i in range(r.choice([1, 2, 3, 8, 60, 400]))]
        old = [r.choice(words) for _ in range(r.choice([0, 1, 5, 50, 300, 700]))]
        new = edited(r, old, words) if case % 3 else [r.choice(words) for _ in range(r.randint(0, 300))]
        assert diffing.unified(old, new, "f") == standard(old, new)
        assert diffing.Matcher(old, new).get_matching_blocks() == difflib.SequenceMatcher(None, old, new).get_matching_blocks()


def test_periodic_texts():
    """Runs of one pattern, of two that hashes modulo a power of two confuse, and of a pattern with a flaw."""
    for old, new in (
        (["a\n", "b\n"] * 150, ["b\n", "a\n"] * 140),
        ([f"{i % 9}\n" for i in range(900)], [f"{i % 9}\n" for i in range(3, 800)]),
        ([f"{i % 50}\n" for i in range(600)], [f"{i % 50}\n" for i in range(600) if i != 301]),
        ([f"{bin(i).count('1') % 2}\n" for i in range(1024)] + ["x\n"], [f"{(bin(i).count('1') + 1) % 2}\n" for i in range(1024)]),
    ):
        assert diffing.unified(old, new, "f") == standard(old, new)


def test_two_megabytes_of_repeated_lines():
    """Each line stands 900 times, which the standard matcher squares."""
    r = random.Random(1)
    words = [f"    return value_of({i:03d})\n" for i in range(110)]
    old = [w for w in words for _ in range(900)]
    r.shuffle(old)
    new = edited(r, old, words)
    assert sum(map(len, old)) > 2_000_000
    began = time.time()
    out = diffing.unified(old, new, "f")
    assert time.time() - began < 30
    assert diffing.patched("".join(old), "\n".join(out)) == "".join(new)


def test_texts_are_rebuilt():
    r = random.Random(9)
    ends = ["\n"] * 6 + ["\x0b", "\x0c", " ", ""]
    for _ in range(300):
        old, new = ("".join(r.choice(["a", "", "-- b", "@@ -1 +1 @@", "+c", " "]) + r.choice(ends) for _ in range(r.randint(0, 30))) for _ in range(2))
        diff = "\n".join(diffing.unified(old.splitlines(True), new.splitlines(True), "f"))
        assert diffing.patched(old, diff) == new
        if diff and old:
            assert diffing.patched(old + "x" if not old.endswith("\n") else "q" + old, diff) != new
    assert diffing.patched("a\n", "--- a/f\n+++ b/f\nnonsense") is None
