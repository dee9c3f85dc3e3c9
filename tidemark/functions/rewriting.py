"""Replacement of many phrases in one pass over a text, or of a few in turn: simplified script, corrected hot words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Phrases:
    """Replaces the longest phrase at the first place where one begins, and goes on after it; what was put in isn't read again.

    Phrases are a trie.  Places where none can begin are skipped by a character
    class, so a text costs its length plus, at each possible beginning, the
    longest phrase at most.  ``letters`` maps the single characters that stand
    outside phrases.
    """

    def __init__(self, phrases: dict[str, str], letters: dict[str, str] | None = None):
        self.root: dict = {}
        for wrong, right in phrases.items():
            node = self.root
            for c in wrong:
                node = node.setdefault(c, {})
            if node is not self.root:
                node[""] = right
        self.begin = re.compile("[" + re.escape("".join(sorted(self.root))) + "]") if self.root else None
        self.letters = str.maketrans(letters or {})

    def __call__(self, text: str) -> str:
        out, kept, at = [], 0, 0
        while self.begin and (found := self.begin.search(text, at)):
            at = found.start()
            node, end, right, i = self.root, None, "", at
            while i < len(text) and (node := node.get(text[i])) is not None:
                i += 1
                if "" in node:
                    end, right = i, node[""]
            if end is None:
                at += 1
                continue
            out += [text[kept:at].translate(self.letters), right]
            kept = at = end
        return "".join([*out, text[kept:].translate(self.letters)])


def rewritten(text: Column, phrases: dict[str, str], letters: dict[str, str] | None = None) -> Column:
    """The text with all phrases replaced in one pass; null stays null.  Tables of a few thousand entries travel with the function."""
    rules = Phrases(phrases, letters)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(rules, na_action="ignore")

    return run(text) if phrases or letters else text


def rewritten_in_turn(text: Column, phrases: dict[str, str], letters: dict[str, str] | None = None) -> Column:
    """The text with each phrase replaced wherever it stands before the next one is, then the letters (one for one); null stays null.

    Where phrases overlap the one that is given first wins, and what was put in is read again.
    """
    for wrong, right in phrases.items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return F.translate(text, "".join(letters), "".join(letters.values())) if letters else text


#: Fixed value: marks before which a transcript has no space.
_TIGHT = "，。！？、,.!?"


def transcript_text(text: Column, phrases: dict[str, str], letters: dict[str, str], hotwords: dict[str, str]) -> Column:
    """A transcript's text with single spaces, none before marks, in simplified script, its hot words corrected.

    The script's tables are arguments (phrases first, then single characters);
    hot words are written in simplified script and replaced in what it gives.
    """
    tidy = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\x{3000}]+", " "), f"[\\s]+([{re.escape(_TIGHT)}])", "$1"))
    return rewritten(rewritten(tidy, phrases, letters), hotwords, letters)
