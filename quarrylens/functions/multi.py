"""Many literals in one pass over a text.

The literals become one pattern that follows their common beginnings like a tree, asked at every place of a text without
moving on. It says the longest literal that begins there; all others that begin there are beginnings of that one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Literals that a gate takes of one pattern, at most; a pattern that would need more is not gated.
MOST = 40


def _tree(words: Iterable[str]) -> dict:
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}
    return root


def _written(node: dict) -> str:
    """Longer literals first; an end among other ways is the empty alternative, tried last."""
    ways = []
    for c in sorted(k for k in node if k):
        own, below = c, node[c]
        while len(below) == 1 and "" not in below:
            (c, below), = below.items()
            own += c
        ways.append(re.sub(r"([^0-9A-Za-z \x80-\U0010ffff])", r"\\\1", own) + (_written(below) if set(below) != {""} else ""))
    return f"(?:{'|'.join([*ways, *([''] if '' in node else [])])})"


def tree_pattern(words: Sequence[str]) -> str:
    """Matches nothing but says, as group 1, the longest of the literals that begins at a place."""
    return f"(?=({_written(_tree(words))}))"


def overlaps_itself(word: str) -> bool:
    """Whether two occurrences can share characters, so that counting where a word begins counts too many."""
    return any(word.startswith(word[i:]) for i in range(1, len(word)))


def begun(t: Column, words: Sequence[str]) -> Column:
    """Every literal at every place where it begins, in one array. An empty literal is no literal."""
    words = sorted({w for w in words if w})
    if not words:
        return F.array().cast("array<string>")
    inner = {w: [x for x in words if w.startswith(x)] for w in words}
    longest = F.regexp_extract_all(t, F.lit(tree_pattern(words)), F.lit(1))
    several = {w: xs for w, xs in inner.items() if len(xs) > 1}
    if not several:
        return longest
    known = F.create_map(*[x for w, xs in several.items() for x in (F.lit(w), F.array(*map(F.lit, xs)))])
    return F.flatten(F.transform(longest, lambda w: F.coalesce(F.try_element_at(known, w), F.array(w))))


def counted(found: Column, t: Column, word: str | Column, odd: Sequence[str] = ()) -> Column:
    """How often a word is in ``found``; words that overlap themselves (``odd``) are counted in the text one after the other."""
    n = F.size(F.filter(found, lambda x: x == word))
    return F.when(word.isin(list(odd)) & (n > 1), T.occurrences(t, word)).otherwise(n) if odd else n


def needed(pattern: str, least: int = 2) -> tuple[str, ...] | None:
    """Lower-case literals of which a text must have one for the pattern to match; None if nothing can be said, or only
    literals of fewer than ``least`` characters.

    Read off the pattern's parts: of a sequence the part that asks for most, of alternatives all that each one needs.
    """
    from re import _constants as C
    from re import _parser as P

    def of(parts) -> tuple[str, ...] | None:
        best: tuple[str, ...] | None = None
        run = ""

        def better(new: tuple[str, ...] | None) -> None:
            nonlocal best
            if new and all(new) and len(new) <= MOST and (best is None or min(map(len, new)) > min(map(len, best))):
                best = new

        for kind, value in parts:
            if kind is C.LITERAL:
                run += chr(value).lower()
                continue
            better((run,) if run else None)
            run = ""
            if kind is C.SUBPATTERN:
                better(of(value[3]))
            elif kind is C.BRANCH:
                each = [of(x) for x in value[1]]
                better(tuple(dict.fromkeys(w for x in each for w in x)) if all(each) else None)
            elif kind in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
                better(of(value[2]))
            elif kind is C.IN and len(value) <= 8 and all(k is C.LITERAL for k, _ in value):
                better(tuple(dict.fromkeys(chr(v).lower() for _, v in value)))
        better((run,) if run else None)
        return best

    try:
        parsed = P.parse(pattern)
    except re.error:
        return None
    found = of(parsed)
    return found if found and min(map(len, found)) >= least else None


def folded(t: Column) -> Column:
    """Lower case as patterns compare that ignore case: what they take for an ASCII letter becomes one."""
    odd = reduce(Column.__or__, [F.contains(t, F.lit(c)) for c in "ſİı"])  # rare, and slow to translate
    return F.when(odd, F.lower(F.translate(t, "ſKİı", "skii"))).otherwise(F.lower(t))


def asked(low: Column, pattern: str, says: Column, otherwise: Column) -> Column:
    """``says`` of a pattern if a text in folded case has a literal that the pattern needs: a search for bytes goes before a
    pattern that is tried at every place."""
    literals = needed(pattern, 1)
    return says if literals is None else F.when(reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in literals]), says).otherwise(otherwise)
