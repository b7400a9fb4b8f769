"""Query strings to plain values, on the driver: literals joined by +, words and phrases within, wildcards."""

from __future__ import annotations

import re
import shlex
from dataclasses import dataclass

from textloom.functions.porter2 import stem

_ENDS = re.compile(r"^\W+|\W+$")


def clean_word(word: str) -> str:
    """As functions.text.clean, for one word of a query."""
    return _ENDS.sub("", word).replace("'", "").lower()


def normal(word: str, stemmed: bool = True) -> str:
    """A query word as it stands in the index; hyphens stay."""
    word = clean_word(word)
    return stem(word) if stemmed else word


@dataclass(frozen=True)
class Operand:
    """One or more words that must stand next to each other, or patterns any of whose words will do."""

    words: tuple[str, ...]
    patterns: tuple[str, ...] = ()


def literals(query: str) -> list[str]:
    return [x.strip() for x in query.split("+")]


def operands(literal: str, stemmed: bool = True) -> list[Operand]:
    """The operands that one literal wants all of. A literal with an unmatched quote is one phrase as a whole.

    A pattern in a phrase stands for the phrase: the phrase's other words are not looked at.
    """
    try:
        parts = shlex.split(literal)
    except ValueError:
        parts = [literal]
    out = []
    for part in parts:
        words = part.split()
        patterns = [w.lower() for w in words if "*" in w]
        if patterns:
            out += [Operand((), (p,)) for p in patterns]
        else:
            out.append(Operand(tuple(normal(w, stemmed) for w in words)))
    return out


def pattern_grams(pattern: str, k: int = 3) -> set[str]:
    """The k-grams that every word of a pattern must have; none for a bare *.

    They are those of the runs between stars; `$` marks an end of the word where no star stands.
    """
    runs = re.findall(r"[^*]+", pattern)
    if runs and not pattern.startswith("*"):
        runs[0] = "$" + runs[0]
    if runs and not pattern.endswith("*"):
        runs[-1] += "$"
    return {run[at : at + k] for run in runs for at in range(max(len(run) - k, 0) + 1)}
