"""Names of several scripts in Latin letters, and compatibility forms of characters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Devanagari letters as Latin letters.
CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहळ", "k kh g gh n ch chh j jh n t th d dh n t th d dh n p f b bh m y r l v sh sh s h l".split()))
VOWELS = dict(zip("अआइईउऊएऐओऔऋ", "a a i i u u e ai o au ri".split()))
MATRAS = dict(zip("ािीुूेैोौृ", "a i i u u e ai o au ri".split()))
NUKTA = {"j": "z", "d": "r", "dh": "rh", "f": "f", "k": "k", "g": "g"}
# Tamil letters as Latin letters.
TAMIL = dict(zip("கஙசஞடணதநபமயரலவழளறனஜஷஸஹ", "k ng ch nj t n th n p m y r l v zh l r n j sh s h".split()))
TAMIL_VOWELS = dict(zip("அஆஇஈஉஊஎஏஐஒஓஔ", "a a i i u u e e ai o o au".split()))
TAMIL_MATRAS = dict(zip("ாிீுூெேைொோௌ", "a i i u u e e ai o o au".split()))
# Cyrillic letters as Latin letters, and Latin letters that do not decompose.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i i k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" ")))
PLAIN = str.maketrans({"ø": "o", "æ": "ae", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "œ": "oe", "ı": "i", "ß": "ss", **CYRILLIC})

#: Of each Indic script: consonants, vowels, vowel signs, the virama, the nukta, nasal signs, and whether a word's last inherent vowel is silent.
_SCRIPTS = (
    (CONSONANTS, VOWELS, MATRAS, "्", "़", "ंँ", True),
    (TAMIL, TAMIL_VOWELS, TAMIL_MATRAS, "்", "", "ஂ", False),
)


def _indic(s: str, consonants: dict, vowels: dict, matras: dict, virama: str, nukta: str, nasals: str, silent: bool) -> str:
    out, i = [], 0
    while i < len(s):
        c = s[i]
        i += 1
        if c in consonants:
            letter = consonants[c]
            if nukta and s[i : i + 1] == nukta:
                letter = NUKTA.get(letter, letter)
                i += 1
            out.append(letter)
            # A vowel sign or virama replaces the inherent vowel.
            follows = s[i : i + 1]
            if follows == virama:
                i += 1
            elif follows and follows in matras:
                out.append(matras[follows])
                i += 1
            elif follows and follows in consonants or not silent:
                out.append("a")
        elif c in vowels or c in matras:
            out.append(vowels.get(c) or matras[c])
        elif c in nasals:
            out.append("n")
        elif c != nukta and c != virama:
            out.append(c)
    return "".join(out)


def latin(text: str) -> str:
    """Lower-case Latin letters of a text in Latin, Cyrillic, Devanagari or Tamil script; other signs stay."""
    if text.isascii():
        return text.lower()
    s = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).casefold())
    for low, script in zip("ऀ஀", _SCRIPTS):
        if any(low <= c < chr(ord(low) + 0x80) for c in s):
            s = _indic(s, *script)
    return "".join(c for c in s if not unicodedata.combining(c)).translate(PLAIN)


@F.pandas_udf(StringType())
def romanised(value: pd.Series) -> pd.Series:
    """`latin` of each text; null stays null."""
    return value.map(latin, na_action="ignore")


@F.pandas_udf(StringType())
def compatible(value: pd.Series) -> pd.Series:
    """Texts with compatibility characters (full-width forms, ligatures, no-break blanks) in their plain form (NFKC)."""
    return value.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


def name_key(value: Column) -> Column:
    """Words of lower-case ASCII letters and digits, whatever the script; the folded text itself where none are left."""
    words = F.trim(F.regexp_replace(romanised(value), "[^a-z0-9]+", " "))
    return F.when(words != "", words).otherwise(F.lower(F.trim(value)))
