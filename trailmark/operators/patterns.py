"""Lists of text patterns compiled into one matcher each.

A list of substrings becomes a trie and the trie one regular expression whose
alternatives part at their first different character, so that a text is read
once whatever the number of patterns.  Matching is then a column expression:
no join, no shuffle, the same in batch and in streams.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 50_000  # patterns compiled of one list; a longer one is refused, as it is no configuration any more


def trie(patterns: Iterable[str]) -> dict:
    """Nested dicts by character; ``None`` ends a pattern, and nothing follows one that ended (it matches already)."""
    root: dict = {}
    for p in sorted({p for p in patterns if p}):
        node = root
        for ch in p:
            if None in node:
                break
            node = node.setdefault(ch, {})
        else:
            node[None] = {}
    return root


def expression(node: dict) -> str:
    """Regular expression of a trie."""
    if None in node:
        return ""
    parts = [re.escape(ch) + expression(below) for ch, below in sorted(node.items())]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def matches(text: Column, anywhere: Iterable[str] = (), at_start: Iterable[str] = ()) -> Column:
    """Whether ``text`` holds any of the patterns (exact characters); NULL text gives NULL, no patterns FALSE."""
    found = []
    for prefix, patterns in (("", anywhere), ("^", at_start)):
        tree = trie(patterns)
        if tree:
            found.append(text.rlike("(?s)" + prefix + expression(tree)))
    if not found:
        return F.when(text.isNotNull(), F.lit(False))
    return found[0] if len(found) == 1 else found[0] | found[1]


def collected(patterns: DataFrame, most: int = MOST) -> list:
    """Rows of a pattern list, a configuration of bounded size."""
    rows = patterns.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a pattern list of more than {most} rows is not compiled")
    return rows


class UserAgentLists:
    """Robot lists over lower-cased user agents: exclude patterns with exceptions and impact, include patterns."""

    def __init__(self, exclude: DataFrame, include: DataFrame, most: int = MOST):
        self.classes: dict[tuple, tuple[list, list]] = {}
        for r in collected(exclude.filter("active = 1").select("pattern", "exceptions", "impact", "starts_with"), most):
            # a comma inside an exception is escaped, so exceptions are decoded after the split
            exceptions = tuple(sorted({unquoted(x).lower() for x in (r["exceptions"] or "").split(",") if x.strip()}))
            kind = self.classes.setdefault((r["impact"], exceptions), ([], []))
            kind[1 if r["starts_with"] == 1 else 0].append((r["pattern"] or "").lower())
        rows = collected(include.filter("active = 1").select("pattern", "starts_with"), most)
        self.include = [[(r["pattern"] or "").lower() for r in rows if (r["starts_with"] == 1) == start]
                        for start in (False, True)]

    def included(self, ua: Column) -> Column:
        return F.coalesce(matches(F.lower(ua), *self.include), F.lit(False))

    def impact(self, ua: Column) -> Column:
        """The strongest impact of the exclude patterns that match and none of whose exceptions does; else NULL."""
        low = F.lower(ua)
        hits = [F.when(matches(low, *kind) & ~matches(low, exceptions), F.lit(impact))
                for (impact, exceptions), kind in sorted(self.classes.items(), key=repr)]
        if not hits:
            return F.lit(None).cast("int")
        return F.greatest(*hits) if len(hits) > 1 else hits[0]


def unquoted(text: str) -> str:
    from urllib.parse import unquote

    return unquote(text)
