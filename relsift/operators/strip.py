"""Whole-line and block comments out of diffs, before they are read by a scorer.

Lines go that stand behind a diff marker and hold a comment as a whole, or run from where one opens a line to
where it closes, with nothing after the closer and no header or unmarked line between. Line comments are one
pattern a language, in the JVM. Diffs in which a block opens are read once from front to back in Python: the
next closer and the next line that no block may cross only ever move on, so that openers that never close
cost no more than others. Line counts of the diff stay those of the real change.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from relsift.operators.tree import suffix

#: Extensions, how their comments open as patterns, and how blocks open and close.
LINES = {(".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx"): "//", (".py", ".pyi", ".sh", ".ps1"): "#(?!!)", (".bat", ".cmd"): "(?i:rem[ \t]|::)"}
BLOCKS = {(".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx"): (("/*", "*/"),), (".py", ".pyi"): (('"""', '"""'), ("'''", "'''")), (".ps1",): (("<#", "#>"),)}
#: Fixed value: what a line of a diff that is no source begins with.
HEADERS = r"--- |\+\+\+ |@@ "
UNTOUCHED = "[diff skipped"

#: A blank that ends no line, as Python sees it.
BLANK = r"[ \t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*+"
#: From the newline before a line to its marker, and what may follow a line.
BEGIN, END = rf"\n(?!{HEADERS})[-+ ]{BLANK}", r"(?=\n|\z)"


def _line_pattern(extension: str) -> str:
    """Line comments of a diff that begins with a newline, each together with the newline before it."""
    kinds = [rf"{b}[^\n]*+" for e, b in LINES.items() if extension in e]
    return f"{BEGIN}(?:{'|'.join(kinds)}){END}"


def _blocks_of(extension: str) -> tuple[tuple[str, str], ...]:
    return next((b for e, b in BLOCKS.items() if extension in e), ())


_OPENS, _EDGE, _REST = re.compile(BEGIN), re.compile(rf"\n(?:{HEADERS}|[^-+ ]|\Z)"), re.compile(BLANK)


class _Next:
    """Where a pattern or sign stands next, for places that only grow."""

    def __init__(self, find):
        self.find, self.at = find, -1

    def __call__(self, start: int) -> int:
        if self.at < start:
            self.at = self.find(start)
        return self.at


def cleared(diff: str, extension: str) -> str:
    """The diff without comments, in one pass."""
    text = f"\n{diff}"
    end = len(text)
    edge = _Next(lambda i: m.start() if (m := _EDGE.search(text, i)) else end)
    closers = [(opener, closer, _Next(lambda i, c=closer: k if (k := text.find(c, i)) >= 0 else end)) for opener, closer in _blocks_of(extension)]
    line = re.compile("|".join(b for e, b in LINES.items() if extension in e))
    out, kept, at = [], 0, 0
    while m := _OPENS.search(text, at):
        start = stop = m.end()
        for opener, closer, shut in closers:
            if text.startswith(opener, start):
                found = shut(start + len(opener))
                if found < min(end, edge(start)):
                    stop = _REST.match(text, found + len(closer)).end()
                    stop = start if stop < end and text[stop] != "\n" else stop
                break
        if stop == start and line.match(text, start):
            stop = text.find("\n", start)
            stop = end if stop < 0 else stop
        if stop > start:
            out.append(text[kept : m.start()])
            kept = at = stop
        else:
            at = start
    return "".join([*out, text[kept:]])[1:]


# rows come a hundred at a time, so that no batch of many large diffs is held with what is made of it
@F.udf(StringType(), useArrow=False)
def _cleared(diff: str | None, extension: str) -> str | None:
    return None if diff is None else cleared(diff, extension)


def without_comments(diff: Column, extension: Column) -> Column:
    """The diff without comments (C12-C14); of kinds of files that aren't known, and of placeholders, unchanged."""
    text = F.concat(F.lit("\n"), diff)
    out, opens = diff, F.lit(False)
    for extensions in LINES:
        for e in extensions:
            out = F.when(extension == e, F.substring(F.regexp_replace(text, F.lit(_line_pattern(e)), F.lit("")), 2, 2**31 - 1)).otherwise(out)
            for opener, _ in _blocks_of(e):
                opens |= (extension == e) & F.contains(diff, F.lit(opener))
    opens &= ~diff.startswith(UNTOUCHED)
    # null where no block opens: nothing is done there
    read = _cleared(F.when(opens, diff), extension)
    return F.when(diff.startswith(UNTOUCHED), diff).when(opens, read).otherwise(out)


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "\n", ""))


def stripped(diffs: DataFrame) -> DataFrame:
    """Diffs with comments gone from unified_diff, and comment_lines_stripped beside (C11)."""
    diff = F.col("unified_diff")
    left = F.col("__left")
    # a diff of which nothing is left had a line more than it had newlines
    gone = F.when((left == "") & (diff != ""), _newlines(diff) + 1).otherwise(_newlines(diff) - _newlines(left))
    found = diffs.withColumn("__left", without_comments(diff, suffix(F.col("path"))))
    return found.withColumns({"comment_lines_stripped": F.coalesce(gone, F.lit(0)).cast("long"), "unified_diff": left}).drop("__left")
