"""Names in several scripts and spellings, brought to comparable forms and fixed bit vectors."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

from cairnframe.functions.latin import latin

# Words that do not tell names apart.
FILLERS = frozenset("the a an of and that cf ex aff sp entry sheet page herbarium".split())

BINOMIAL = re.compile(r"^([^\W\d_a-z][^\W\d_]*\.? [a-z]{3,}) (?:[(A-Z&]|ex ).*$")
WIDTH = 128


def sound(word: str) -> str:
    """A word with letters of one sound written one way and doubled letters single."""
    w = word.replace("qu", "ku").replace("c", "k").replace("q", "k").replace("x", "ks").replace("w", "v")
    return re.sub(r"(.)\1+", r"\1", w)


@lru_cache(maxsize=1 << 15)
def forms(name: str) -> tuple[str, ...]:
    """The comparable forms of a name: words in sound spelling, sorted, without decoration.

    Decoration is brackets, quotes, what follows a slash or dash, author citations and filler
    words. "X, Y" is read as "Y X", and as "X" where that has two words. Every form of two or
    more words comes also with its first word as an initial.
    """
    plain = " ".join(name.split())
    # A capitalised word, a lower-case one and then a capital or bracket: a binomial with its author.
    if found := BINOMIAL.match(plain):
        plain = found[1]
    s = re.sub(r"\([^)]*\)|[“”\"«»„‘’']", " ", latin(plain))
    s = re.sub(r"\s[–—-]\s.*$", "", s).split("/")[0]
    parts = [p.strip() for p in s.split(",") if p.strip()]
    readings = [" ".join(parts[::-1])] + ([parts[0]] if len(parts) > 1 and len(parts[0].split()) > 1 else [])
    out = []
    for reading in readings:
        text = re.sub(r"(?<=[a-z])\s+(?:[a-z]\.)*[a-z]{2,6}\.", " ", reading.replace("-", " "))
        words = [w for w in re.findall(r"[a-z]+\.?", text) if w.strip(".") not in FILLERS or len(w) == 2 and w.endswith(".")]
        words = [w if len(w) == 2 and w.endswith(".") else sound(w.strip(".")) for w in words]
        if words:
            out.append(" ".join(sorted(words)))
            if len(words) > 1 and len(words[0]) > 2:
                out.append(" ".join(sorted([words[0][0] + ".", *words[1:]])))
    return tuple(dict.fromkeys(out))


@lru_cache(maxsize=1 << 15)
def bits(form: str) -> int:
    """The 2-grams of a form's words as a fixed vector of 128 bits."""
    v = 0
    for w in form.split():
        padded = f"_{w}_"
        for i in range(len(padded) - 1):
            v |= 1 << zlib.crc32(padded[i : i + 2].encode()) % WIDTH
    return v


def dice(a: int, b: int) -> float:
    """Dice similarity of two bit vectors."""
    total = a.bit_count() + b.bit_count()
    return 2 * (a & b).bit_count() / total if total else 0.0
