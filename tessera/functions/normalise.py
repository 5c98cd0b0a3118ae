"""Normalisation of query text: case folding, stop words, stemming (Porter, 1980)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from tessera.plans.ast import Binary, Distance, Free, Not, Phrase, Query, Relation, Wildcard, Zone

STOP_WORDS = frozenset(
    "a about above after again all am an and any are as at be because been before being below between both but by can cannot could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself me more most my no nor not of off on once only or other our ours out over own same she should so some such than that the their theirs them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours".split()
)


class InvalidQuery(ValueError):
    """A query that means nothing once it is normalised."""


def _consonant(w: str, i: int) -> bool:
    c = w[i]
    if c in "aeiou":
        return False
    return not (c == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    kinds = [_consonant(w, i) for i in range(len(w))]
    return sum(1 for a, b in zip(kinds, kinds[1:], strict=False) if not a and b)


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _short_end(w: str) -> bool:
    return len(w) >= 3 and _consonant(w, len(w) - 1) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 3) and w[-1] not in "wxy"


def _swap(w: str, rules: Iterable[tuple[str, str]], least: int) -> str:
    for old, new in rules:
        if w.endswith(old):
            root = w[: len(w) - len(old)]
            return root + new if _measure(root) > least else w
    return w


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def stem(w: str) -> str:
    """Porter's stem of a word in lower case; words of two letters or with other than a-z are left."""
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(w, sorted(_STEP2, key=lambda r: -len(r[0])), 0)
    w = _swap(w, sorted(_STEP3, key=lambda r: -len(r[0])), 0)
    for end in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(end):
            root = w[: -len(end)]
            if _measure(root) > 1 and (end != "ion" or root.endswith(("s", "t"))):
                w = root
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def tokens(words: Iterable[str]) -> tuple[str, ...]:
    """Folded, without stop words and blanks, stemmed."""
    low = (w.lower().strip() for w in words)
    return tuple(s for s in (stem(w) for w in low if w and w not in STOP_WORDS) if s)


def normalise(q: Query) -> Query:
    """``q`` with normalised words. A phrase of one word is free text; a distance needs both of its words."""
    match q:
        case Free():
            return Free(tokens(q.tokens))
        case Phrase():
            left = tokens(q.tokens)
            return Phrase(left) if len(left) > 1 else Free(left)
        case Distance():
            left, right = tokens([q.left]), tokens([q.right])
            if not left or not right:
                raise InvalidQuery("a distance needs two words that aren't stop words")
            return replace(q, left=left[0], right=right[0])
        case Wildcard():
            return Wildcard(q.prefix.lower(), q.suffix.lower())
        case Zone() | Not():
            return replace(q, sub=normalise(q.sub))
        case Relation():
            try:
                return q if q.sub is None else replace(q, sub=normalise(q.sub))
            except InvalidQuery:
                return q
        case Binary():
            return replace(q, left=normalise(q.left), right=normalise(q.right))
    raise TypeError(q)
