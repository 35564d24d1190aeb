"""Porter (1980) suffix stripper with the common NLTK-default extensions.

A per-token helper: callers memoise it per task (``stem_cached``) so each
distinct word of a partition is stemmed once.
"""

from __future__ import annotations

from functools import lru_cache

# ---- fixed values -------------------------------------------------------
VOWELS = "aeiou"
# Irregular forms that bypass the rules.
IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie",
             "tying": "tie", "news": "news", "innings": "inning",
             "inning": "inning", "outings": "outing", "outing": "outing",
             "cannings": "canning", "canning": "canning", "howe": "howe",
             "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
         ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
         ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
         ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
         ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
         ("fulli", "ful"), ("logi", "log")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"),
         ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
         "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
# ------------------------------------------------------------------------


def _by_last(rules: list[tuple[str, str]]) -> dict[str, list[tuple[str, str]]]:
    """The rules of each last letter, in order: only these can fit a word."""
    found: dict[str, list[tuple[str, str]]] = {}
    for suf, rep in rules:
        found.setdefault(suf[-1], []).append((suf, rep))
    return found


_SUFFIXES = {"s", "ed", "ing", "y", "e", "ll", *STEP4, *(suf for suf, _ in STEP2 + STEP3)}
#: A word of lower-case letters and digits with none of these endings is its own stem.
ENDINGS = tuple(sorted(x for x in _SUFFIXES if not any(x != y and x.endswith(y) for y in _SUFFIXES)))
_STEP2_BY, _STEP3_BY, _STEP4_BY = _by_last(STEP2), _by_last(STEP3), _by_last([(suf, "") for suf in STEP4])


class _Kinds(dict):
    """For ``str.translate``: v for a vowel, c for any other character."""

    def __missing__(self, code: int) -> str:
        return "c"


_KINDS = _Kinds((ord(x), "v") for x in VOWELS)


def _kinds(s: str) -> str:
    """v or c for every letter; y is a consonant at the start and after a vowel."""
    kinds = s.translate(_KINDS)
    if "y" in s:
        at = s.find("y", 1)
        while at > 0:
            if kinds[at - 1] == "c":
                kinds = f"{kinds[:at]}v{kinds[at + 1:]}"
            at = s.find("y", at + 1)
    return kinds


def _cons(w: str, i: int) -> bool:
    ch = w[i]
    if ch in VOWELS:
        return False
    if ch == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _measure(s: str) -> int:
    return _kinds(s).count("vc")


def _has_vowel(s: str) -> bool:
    return "v" in _kinds(s)


def _double_cons(s: str) -> bool:
    return len(s) >= 2 and s[-1] == s[-2] and _cons(s, len(s) - 1)


def _cvc(s: str) -> bool:
    if len(s) >= 3:
        return (_cons(s, len(s) - 3) and not _cons(s, len(s) - 2)
                and _cons(s, len(s) - 1) and s[-1] not in "wxy")
    return len(s) == 2 and not _cons(s, 0) and _cons(s, 1)


def _step1a(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-3] + "ie"
    for suf, rep in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suf):
            return w[: len(w) - len(suf)] + rep
    return w


def _step1b(w: str) -> str:
    if w.endswith("ied"):
        return w[:-3] + ("ie" if len(w) == 4 else "i")
    if w.endswith("eed"):
        s = w[:-3]
        return s + "ee" if _measure(s) > 0 else w
    stem = None
    for suf in ("ed", "ing"):
        if w.endswith(suf) and _has_vowel(w[: -len(suf)]):
            stem = w[: -len(suf)]
            break
    if stem is None:
        return w
    for suf, rep in (("at", "ate"), ("bl", "ble"), ("iz", "ize")):
        if stem.endswith(suf):
            return stem[: -len(suf)] + rep
    if _double_cons(stem):
        return stem[:-1] if stem[-1] not in "lsz" else stem
    if _measure(stem) == 1 and _cvc(stem):
        return stem + "e"
    return stem


def _step1c(w: str) -> str:
    if w.endswith("y") and len(w) > 2 and _cons(w, len(w) - 2):
        return w[:-1] + "i"
    return w


def _step2(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _step2(w[:-4] + "al")
    for suf, rep in _STEP2_BY.get(w[-1:], ()):
        if w.endswith(suf):
            stem = w[: -len(suf)]
            ok = _measure(w[:-3]) > 0 if suf == "logi" else _measure(stem) > 0
            return stem + rep if ok else w
    return w


def _step3(w: str) -> str:
    for suf, rep in _STEP3_BY.get(w[-1:], ()):
        if w.endswith(suf):
            stem = w[: -len(suf)]
            return stem + rep if _measure(stem) > 0 else w
    return w


def _step4(w: str) -> str:
    for suf, _ in _STEP4_BY.get(w[-1:], ()):
        if w.endswith(suf):
            stem = w[: -len(suf)]
            ok = _measure(stem) > 1
            if suf == "ion":
                ok = ok and stem[-1:] in ("s", "t")
            return stem if ok else w
    return w


def _step5(w: str) -> str:
    if w.endswith("e"):
        s = w[:-1]
        m = _measure(s)
        if m > 1 or (m == 1 and not _cvc(s)):
            w = s
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def stem(word: str) -> str:
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2 or not w.endswith(ENDINGS):
        return w
    for step in (_step1a, _step1b, _step1c, _step2, _step3, _step4, _step5):
        w = step(w)
    return w


stem_cached = lru_cache(maxsize=1 << 18)(stem)
