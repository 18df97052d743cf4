"""Language processing by word: stems, languages, sentences, parts of speech and patterns over them.

Plain functions, which pandas UDFs apply to whole documents; only what a column expression can't say is here.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- languages ------------------------------------------------------------------------------------------------

#: Frequent words that tell a language.
PROFILES = {
    "en": ("the", "and", "of", "to", "in", "that", "is", "was", "it", "for", "with", "as", "on", "be", "at", "by", "this"),
    "de": ("der", "die", "und", "das", "ist", "von", "den", "ein", "eine", "nicht", "mit", "sich", "auf", "dem", "des", "im", "zu"),
    "fr": ("le", "la", "les", "et", "des", "un", "une", "du", "est", "que", "dans", "pour", "qui", "sur", "pas", "au", "ce"),
    "es": ("el", "los", "las", "y", "que", "del", "una", "por", "con", "para", "como", "su", "al", "lo", "se", "no", "es"),
}


def language(tokens: Column, fallback: str | None = None) -> Column:
    """The language with most words of its profile among the tokens (the first of equals); the fallback where none has any."""
    count = lambda ws: F.size(F.filter(tokens, lambda t: t.isin(*ws)))
    counts = [count(ws) for ws in PROFILES.values()]
    most = F.greatest(*counts)
    out = F.lit(fallback).cast("string")
    for k, c in reversed(list(zip(PROFILES, counts, strict=True))):
        out = F.when((c == most) & (most > 0), k).otherwise(out)
    return out


# ---- stems: M. F. Porter, An algorithm for suffix stripping (1980) --------------------------------------------

_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and (w[i] != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(stem: str) -> int:
    """How many times a vowel run is followed by a consonant run."""
    kinds = re.sub(r"(.)\1+", r"\1", "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem))))
    return kinds.count("vc")


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _doubled(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


@lru_cache(maxsize=1 << 17)  # words repeat
def porter(word: str) -> str:
    w = word
    if len(w) < 3:
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if _has_vowel(stem := w[: -len(end)]):
                    w = stem + "e" if stem.endswith(("at", "bl", "iz")) or (_measure(stem) == 1 and _cvc(stem)) and not _doubled(stem) else stem[:-1] if _doubled(stem) and stem[-1] not in "lsz" else stem
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                w = w[: -len(end)] + table[end] if _measure(w[: -len(end)]) > 0 else w
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if _measure(w) > 1 and _doubled(w) and w.endswith("l") else w


#: Stemmers by name; another may be put here.
STEMMERS = {"porter": porter, "none": lambda w: w}


# ---- sentences ------------------------------------------------------------------------------------------------

MAX_TEXT, MAX_SENTENCES, MAX_SEGMENT = 50_000, 500, 250  # fixed values
_ENDS = re.compile(r"(?<=[.!?])\s+|\n+|\s-|-\s|\|")
_WORD = re.compile(r"[\w'+#@:/.-]*\w|,")


@dataclass
class Sentence:
    """Words with the tags of their elements; ``commas`` are the places of words that a comma follows. Fixed once made."""

    words: list[str]
    commas: set[int] = field(default_factory=set)
    tags: frozenset[str] = frozenset()
    pos: list[str] = field(default_factory=list)
    stemmer: Callable[[str], str] = porter

    @cached_property
    def letters(self) -> str:
        """The tags, a letter each."""
        return "".join(map(_LETTER.__getitem__, self.pos))

    def next_comma(self, at: int) -> int:
        return min((c for c in self.commas if c >= at), default=len(self.words)) if self.commas else len(self.words)

    def stemmed(self, start: int, end: int) -> str:
        return "_".join(self.stemmer(w.lower()) for w in self.words[start:end])

    def joined(self, start: int, end: int) -> str:
        return "_".join(w.lower() for w in self.words[start:end])


def sentence(text: str, tags=(), stemmer=porter) -> Sentence:
    words, commas, tags = _WORD.findall(text), set(), frozenset(tags)
    if "," in words:
        words, found = [], words
        for w in found:
            if w != ",":
                words.append(w)
            elif words:
                commas.add(len(words) - 1)
    if "'s" in text:
        words = [w.removesuffix("'s") for w in words]
    return Sentence(words, commas, tags, tag(words), stemmer)


def sentences(text: str, tags=(), stemmer=porter, whole: bool = False) -> list[Sentence]:
    """At most MAX_SENTENCES of the first MAX_TEXT characters, or those of the whole text; none longer than MAX_SEGMENT (it is parted)."""
    text = text or ""
    parts = [p.strip() for p in _ENDS.split(text if whole else text[:MAX_TEXT])]
    cut = [p[i : i + MAX_SEGMENT] for p in parts if p for i in range(0, len(p), MAX_SEGMENT)]
    return [s for s in (sentence(p, tags, stemmer) for p in (cut if whole else cut[:MAX_SENTENCES])) if s.words]


# ---- parts of speech ------------------------------------------------------------------------------------------

TAGS = ("NN", "NNS", "NNP", "VB", "VBD", "VBG", "JJ", "RB", "IN", "TO", "DT", "CC", "CD", "PRP")
_CLOSED = {
    "IN": "in of on at by for with from into over under after before about as between through during without against among",
    "TO": "to",
    "DT": "the a an this that these those each every some any no",
    "CC": "and or but nor yet so",
    "PRP": "i you he she it we they me him her us them his its their my your our who which what",
    "VB": "is are be am was were been has have had do does did can could will would shall should may might must get make take see know go come say",
    "RB": "not very too also now then here there just only never always often",
}
_LEXICON = {w: t for t, ws in _CLOSED.items() for w in ws.split()}
_LEADS = frozenset(("TO", "DT", "JJ", "PRP"))  # tags that can change the next word's
_NUMBER = re.compile(r"[\d.,:/-]*\d[\d.,:/-]*")
_SUFFIXES = (("ly", "RB"), ("ing", "VBG"), ("ed", "VBD"), ("ous", "JJ"), ("ful", "JJ"), ("ive", "JJ"), ("able", "JJ"), ("ible", "JJ"), ("al", "JJ"), ("ic", "JJ"), ("ize", "VB"), ("ify", "VB"))


@lru_cache(maxsize=1 << 17)  # words repeat
def _alone(w: str) -> tuple[str, str]:
    """A word's tag at the beginning of a sentence and within it: known words, then the word's shape."""
    low = w.lower()
    if low in _LEXICON:
        return _LEXICON[low], _LEXICON[low]
    if _NUMBER.fullmatch(w):
        return "CD", "CD"
    t = next((t for s, t in _SUFFIXES if low.endswith(s) and len(low) > len(s) + 2), "NNS" if low.endswith("s") and not low.endswith(("ss", "us", "is")) and len(low) > 3 else "NN")
    return t, "NNP" if w[:1].isupper() else t


def tag(words: list[str]) -> list[str]:
    """A tag for each word: that of the word alone, then rules on its neighbours."""
    if not words:
        return []
    out = [t for _, t in map(_alone, words)]
    if not (len(words) > 1 and words[1][:1].isupper()):
        out[0] = _alone(words[0])[0]
    before = ""
    for i, t in enumerate(out):
        if before in _LEADS:
            if before == "TO" and t == "NN":
                out[i] = t = "VB"
            elif before in ("DT", "JJ") and t in ("VB", "VBG", "VBD") and words[i].lower() not in _LEXICON:
                out[i] = t = "NN" if t != "VBD" else "JJ"
            elif before == "PRP" and t == "NNS":
                out[i] = t = "VB"
        before = t
    return out


_BIT = {t: 1 << i for i, t in enumerate(TAGS)}
_LETTER = {t: chr(ord("A") + i) for i, t in enumerate(TAGS)}


def mask(tags: list[str]) -> list[int]:
    """Each tag as a single bit."""
    return [_BIT[t] for t in tags]


class Pattern:
    """A sequence of tag sets, written ``NNP (IN DT) NNP``; ``!(A B)`` is any tag but these, ``*`` after a tag its prefix."""

    def __init__(self, text: str) -> None:
        self.sets: list[int] = []
        for m in re.finditer(r"(!?)(?:\(([^()]*)\)|([^\s()]+))", text):
            bits = 0
            for name in (m[2] or m[3]).split():
                hit = [b for t, b in _BIT.items() if t == name or (name.endswith("*") and t.startswith(name[:-1]))]
                if not hit:
                    raise ValueError(f"unknown tag: {name}")
                for b in hit:
                    bits |= b
            self.sets.append(((1 << len(TAGS)) - 1) & ~bits if m[1] else bits)
        if not self.sets:
            raise ValueError("an empty pattern matches nothing")
        self.letters = "".join("[" + "".join(x for t, x in _LETTER.items() if _BIT[t] & s) + "]" if s else "(?!)" for s in self.sets)
        self._here, self._any = re.compile(self.letters), re.compile(f"(?={self.letters})")  # on a sentence's letters

    def bitmap(self, tags: list[str]) -> list[bool]:
        """For each place whether the pattern begins there."""
        bits, n = mask(tags), len(self.sets)
        return [i + n <= len(bits) and all(bits[i + j] & s for j, s in enumerate(self.sets)) for i in range(len(bits))]

    def at(self, s: Sentence, i: int) -> bool:
        """Whether it matches at a place, without a comma before its last word."""
        n = len(self.sets)
        return self._here.match(s.letters, i) is not None and s.next_comma(i) >= i + n - 1

    def spans(self, s: Sentence) -> list[tuple[int, int]]:
        n = len(self.sets)
        return [(i, i + n) for i in (m.start() for m in self._any.finditer(s.letters)) if s.next_comma(i) >= i + n - 1]


#: The patterns of each category, by language; another language's may be put here.
GRAMMAR = {
    "en": {
        "name": ["NNP", "NNP NNP", "NNP NNP NNP", "NNP (IN DT) NNP", "NNP IN DT NNP"],
        "noun": ["(NN NNS NNP)", "(NN NNS NNP JJ) (NN NNS NNP)", "(NN NNS NNP JJ) (NN NNS NNP) (NN NNS NNP)"],
        "subject_suffix": ["VB*", "VB* (DT RB VB* NN NNS)", "(RB) VB*"],
        "title": ["(NN NNS NNP JJ CD)", "(NN NNS NNP JJ CD) (NN NNS NNP CD)"],
        "keyword": ["!(IN TO CC DT PRP)"],
    }
}
_COMPILED: dict[tuple[str, str], list[Pattern]] = {}


def grammar(kind: str, lang: str = "en") -> list[Pattern]:
    key = (lang if lang in GRAMMAR else "en", kind)
    if key not in _COMPILED:
        _COMPILED[key] = [Pattern(x) for x in GRAMMAR[key[0]][kind]]
    return _COMPILED[key]


# ---- keyword extractors ---------------------------------------------------------------------------------------


def spans(s: Sentence, kind: str, lang: str = "en") -> list[tuple[int, int]]:
    return sorted({x for p in grammar(kind, lang) for x in p.spans(s)})


def names(doc: list[Sentence], least: int = 2, most: int = 150, lang: str = "en") -> dict[str, int]:
    """Stemmed names with their counts: joined ones seen ``least`` times, single ones once more (all capitals don't count)."""
    seen = Counter(s.stemmed(a, b) for s in doc for a, b in spans(s, "name", lang) if b - a > 1 or not s.words[a].isupper())
    enough = [(n, w) for w, n in seen.items() if n >= (least if "_" in w else least + 1)]
    return {w: n for n, w in sorted(enough, key=lambda x: (-x[0], x[1]))[:most]}


def subjects(doc: list[Sentence], lang: str = "en") -> dict[str, int]:
    """Stemmed nouns that a verb follows, with no comma after them, and how often."""
    out: Counter[str] = Counter()
    nouns, suffixes = grammar("noun", lang), grammar("subject_suffix", lang)
    suffix = re.compile("|".join(f"(?={p.letters})" for p in suffixes))
    for s in doc:
        for m in suffix.finditer(s.letters):  # few: nouns are looked for before them
            b = m.start()
            if s.commas and not (s.next_comma(max(0, b - 1)) > b and any(p.at(s, b) for p in suffixes)):
                continue
            for a in {b - len(p.sets) for p in nouns if b >= len(p.sets) and p.at(s, b - len(p.sets))}:
                out[s.stemmed(a, b)] += 1
    return dict(out)


def title_words(titles: list[Sentence], most: int = 100, lang: str = "en") -> list[str]:
    """Distinct words and word pairs of titles, in order, at most ``most``."""
    found = [s.joined(a, b) for s in titles for a, b in spans(s, "title", lang)]
    return list(dict.fromkeys(found))[:most]
