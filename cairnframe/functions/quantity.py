"""Reading measured quantities out of text (plain Python; used inside Arrow batches)."""

from __future__ import annotations

import re
from functools import lru_cache

# Vulgar fractions, superscripts, scale words, range and hedge words.
FRACTIONS = {"½": 0.5, "¼": 0.25, "¾": 0.75, "⅓": 1 / 3, "⅔": 2 / 3, "⅛": 0.125, "⅜": 0.375, "⅝": 0.625, "⅞": 0.875, "⅕": 0.2, "⅖": 0.4, "⅗": 0.6, "⅘": 0.8}
SUPERSCRIPTS = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")
SCALES = {"hundred": 1e2, "thousand": 1e3, "tausend": 1e3, "tsd": 1e3, "mille": 1e3, "mil": 1e3, "tys": 1e3, "тыс": 1e3, "тысяч": 1e3, "हज़ार": 1e3, "हजार": 1e3, "lakh": 1e5, "million": 1e6, "millions": 1e6, "millionen": 1e6, "mio": 1e6, "millones": 1e6, "milhões": 1e6, "billion": 1e9}
RANGE_WORDS = ("to", "bis", "till", "until", "and", "und", "et", "y", "e", "à", "a", "do", "i", "до", "и", "से", "और")
HEDGES = r"or so|or thereabouts|in (?:spring|summer|autumn|winter)|a\.?s\.?l\.?|(?:above|below|over|under|at|near|on|from|along|across) .*|approx\.?|approximately|circa|ca\.?|roughly|or more|or less|give or take.*|max\.?|min\.?|\(.*"

_BLANKS = re.compile(r"[\s  -   　]+")
_NUMBER = (
    r"(?:(?P<{0}sign>[-+−])\s?)?(?:(?P<{0}int>\d{{1,3}}(?:[ ,'’]\d{{3}}(?!\d))+|\d+)(?P<{0}dec>\.\d+|,\d{{1,2}}(?!\d)|,\d{{4,}}(?!\d))?"
    r"(?:[eE](?P<{0}exp>[-+−]?\d+)|\s*[×xX*·]\s*10\s*(?:\^\s*(?P<{0}pow>[-+−]?\d+)|\*\*\s*(?P<{0}pow2>[-+−]?\d+)|(?P<{0}sup>[⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺]+)))?"
    r"(?:\s*(?P<{0}vul>[" + "".join(FRACTIONS) + r"])|\s+(?P<{0}num>\d+)\s?[/⁄]\s?(?P<{0}den>[1-9]\d*))?"
    r"|(?P<{0}bvul>[" + "".join(FRACTIONS) + r"])|(?P<{0}bnum>\d+)\s?[/⁄]\s?(?P<{0}bden>[1-9]\d*))"
    r"(?:\s*(?P<{0}scale>" + "|".join(sorted(map(re.escape, SCALES), key=len, reverse=True)) + r")\.?(?![^\W\d_]))?"
)


def _value(found: re.Match, at: str) -> float:
    g = found.groupdict()
    if g[at + "int"] is not None:
        whole = re.sub(r"\D", "", g[at + "int"])
        value = float(whole + (g[at + "dec"] or "").replace(",", "."))
        power = g[at + "exp"] or g[at + "pow"] or g[at + "pow2"] or (g[at + "sup"] or "").translate(SUPERSCRIPTS)
        if power:
            value = float(f"{value!r}e{int(power.replace(chr(0x2212), '-'))}") if "e" not in repr(value) else value * 10.0 ** int(power.replace(chr(0x2212), "-"))
        if g[at + "vul"]:
            value += FRACTIONS[g[at + "vul"]]
        elif g[at + "num"]:
            value += int(g[at + "num"]) / int(g[at + "den"])
    elif g[at + "bvul"]:
        value = FRACTIONS[g[at + "bvul"]]
    else:
        value = int(g[at + "bnum"]) / int(g[at + "bden"])
    if g[at + "scale"]:
        value *= SCALES[g[at + "scale"].lower()]
    return -value if g[at + "sign"] in ("-", "−") else value


class Units:
    """A unit table ready for reading: symbol → (quantity, base unit, factor, offset).

    Symbols are matched without regard to case, surrounding blanks and a final full stop.
    """

    def __init__(self, rows: list[tuple[str, str, str, float, float]]):
        self.of = {u.strip().rstrip(".").lower(): (q, b, float(f), float(o or 0.0)) for q, u, b, f, o in rows if u}
        # Longest first, so that "km2" is not read as "km".
        words = sorted(self.of, key=lambda u: (-len(u), u))
        unit = "|".join(re.escape(w).replace(r"\ ", r"\s+") + (r"(?![^\W_]|[²³])" if w[-1].isalnum() else "") for w in words) or r"(?!)"
        self.unit = rf"(?:{unit})"
        after = r"\s*(?P<{0}>" + self.unit + r")\.?(?!\s(?:spring|summer|autumn|winter))"
        self.single = re.compile(_NUMBER.format("a") + rf"(?:{after.format('ua')})?", re.I)
        self.second = re.compile(r"\s*(?:[-‐-―−~]|\.\.\.?|…|(?:" + "|".join(RANGE_WORDS) + r")(?![^\W\d_]))\s*" + _NUMBER.format("b") + rf"(?:{after.format('ub')})?", re.I)
        self.part = re.compile(r"\s*(?:,|and|und|et|y)?\s*" + _NUMBER.format("b") + after.format("ub"), re.I)
        self.before = re.compile(r"(?<![^\W_])[(\[]?\s*(?P<u>" + self.unit + r")\.?\s*[)\]]?\s*[:=]?\s*(?:ca\.?|approx\.?|about|[~≈])?\s*$", re.I)
        self.follows = re.compile(after.format("u"), re.I)
        self.hedge = re.compile(rf"\s*[,;]?\s*(?:{HEDGES})?\s*[.!]?\s*$", re.I)
        self.read = lru_cache(maxsize=1 << 15)(self._read)

    def known(self, unit: str | None) -> str | None:
        """The unit's symbol in the table, or None."""
        u = _BLANKS.sub(" ", unit).strip().rstrip(".").strip().lower() if unit else ""
        return u if u in self.of else None

    def symbol(self, found: str | None) -> str | None:
        return self.known(found) if found else None

    def _read(self, raw: str) -> tuple | None:
        """(low, high, unit of low, unit of high, number as written, unknown unit?) of a text; None without a number."""
        text = _BLANKS.sub(" ", raw).strip()
        text = re.sub(r"(?i)\bminus\s+(?=\d)", "-", text)
        first = None
        for found in self.single.finditer(text):
            # Digits inside a word or a unit such as "km2" are not the number.
            if found.start() and (text[found.start() - 1].isalpha() and not found["asign"]):
                continue
            first = found
            break
        if first is None:
            return None
        low, unit = _value(first, "a"), self.symbol(first["ua"])
        if first["asign"] in ("-", "−") and first.start() and text[first.start() - 1].isalnum():
            low = -low
        high, unit_high, end, written = low, unit, first.end(), text[first.start() : first.start("ua") if first["ua"] else first.end()].strip()
        second = self.second.match(text, end)
        if second:
            high, unit_high = _value(second, "b"), self.symbol(second["ub"])
            end = second.end()
            written = text[first.start() : second.start("ub") if second["ub"] else second.end()].strip()
            unit = unit or unit_high
            unit_high = unit_high or unit
        elif unit and (part := self.part.match(text, end)):
            smaller = self.symbol(part["ub"])
            if smaller and self.of[smaller][0] == self.of[unit][0] and self.of[smaller][2] < self.of[unit][2]:
                sign = -1.0 if low < 0 else 1.0
                extra = sign * _value(part, "b") * self.of[smaller][2] / self.of[unit][2]
                return ("sum", low, _value(part, "b") * sign, unit, smaller, extra)
        if unit is None:
            lead = self.before.search(text[: first.start()])
            unit = unit_high = self.symbol(lead["u"]) if lead else None
        unknown = unit is None and not self.hedge.match(text[end:])
        return (low, high, unit, unit_high, written, unknown)

    def micro(self, value: float, unit: str) -> int:
        """Millionths of the base unit, to the nearest whole number."""
        _, _, factor, offset = self.of[unit]
        return round((value * factor + offset) * 1e6)

    def standard(self, raw: str | None, unit: str | None, quote: str | None) -> tuple[str, str, int, int] | None:
        """(quantity, base unit, low, high) in millionths of the base unit, or None if it can't be read.

        The unit in `raw` counts, then `unit`, then the one after the same number in `quote`.
        """
        read = self.read(raw) if raw else None
        if read is None:
            return None
        if read[0] == "sum":
            _, low, more, u, smaller, _ = read
            total = low * self.of[u][2] + more * self.of[smaller][2] + self.of[u][3]
            micro = round(total * 1e6)
            return (*self.of[u][:2], micro, micro)
        low, high, u, v, written, unknown = read
        if u is None:
            if unknown:
                return None
            if unit is not None and unit.strip():
                u = v = self.known(unit)
            elif quote:
                q = _BLANKS.sub(" ", quote)
                at = q.find(written)
                while at >= 0:
                    ends = at + len(written)
                    apart = not (at and (q[at - 1].isdigit() or q[at - 1] in ".,") or ends < len(q) and q[ends].isdigit())
                    if apart and (found := self.follows.match(q, ends)):
                        u = v = self.symbol(found["u"])
                        break
                    at = q.find(written, at + 1)
        if u is None or v is None:
            return None
        a, b = self.micro(low, u), self.micro(high, v)
        return (*self.of[u][:2], min(a, b), max(a, b))
