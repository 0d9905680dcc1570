"""Whether a value is proved by its quote, and a quote by its page; sanity limits; trust tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnframe.functions.latin import compatible
from cairnframe.functions.text import BLANK

#: Signs that are written in several ways, and the way they are compared in.
ALIKE = "–—’", "--'"
# What a proof says of a value.
VERIFIED, NO_QUOTE, NOT_ON_PAGE, NOT_IN_QUOTE = "proved", "the value comes without a quote", "the quote does not stand on the page", "the quote does not state the value"


def plain(value: Column) -> Column:
    """Text for comparison: compatibility forms, one case, one kind of dash and quote, single blanks; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.translate(compatible(F.coalesce(value, F.lit(""))), *ALIKE)), BLANK + "+", " "))


def stripped(text: Column) -> Column:
    """Only the ASCII letters and digits of a plain text, run together."""
    return F.regexp_replace(text, "[^a-z0-9]+", "")


def stated_numbers(text: Column) -> Column:
    """The different numbers of a plain text, without thousands commas and a final point."""
    written = F.regexp_extract_all(text, F.lit(r"\d(?:[\d,.]*\d)?"), 0)
    return F.array_distinct(F.transform(written, lambda n: F.translate(n, ",", "")))


def proof(value: Column, quote: Column, page: Column) -> Column:
    """struct(kept, reason): whether the quote proves the value and the page proves the quote.

    A quote of more than eight letters and digits may differ from the page in everything else; a
    shorter one must stand there as plain text. A quote states a value if it holds its text or all
    of its numbers; a value without numbers may differ in everything but letters.
    """
    return _judged(value.isNotNull(), plain(value), plain(quote), plain(page))


def _judged(given: Column, v: Column, q: Column, p: Column) -> Column:
    on_page = F.contains(p, q) | ((F.length(stripped(q)) > 8) & F.contains(stripped(p), stripped(q)))
    numbers = stated_numbers(v)
    loose = F.when(F.size(numbers) == 0, F.contains(stripped(q), stripped(v))).otherwise(F.size(F.array_except(numbers, stated_numbers(q))) == 0)
    states = given & (((v != "") & F.contains(q, v)) | loose)
    reason = F.when(q == "", NO_QUOTE).when(~on_page, NOT_ON_PAGE).when(~states, NOT_IN_QUOTE).otherwise(VERIFIED)
    return F.struct((reason == VERIFIED).alias("kept"), reason.alias("reason"))


def quote_on_page(quote: Column, page: Column) -> Column:
    """Whether a quote stands on its page."""
    return ~proof(F.lit("-"), quote, page)["reason"].isin(NO_QUOTE, NOT_ON_PAGE)


def value_in_quote(value: Column, quote: Column) -> Column:
    """Whether a quote states a value."""
    return proof(value, quote, quote)["kept"]


def sane(number: Column, high: Column, text: Column, limits: tuple | list) -> Column:
    """Whether a value keeps to its limits: [low, high] for both ends of numbers, else a list of allowed texts.

    A range whose maximum lies below its minimum is refused; a value without a number passes
    numeric limits.
    """
    if len(limits) == 2 and all(isinstance(x, (int, float)) for x in limits):
        inside = lambda c: c.isNull() | c.between(float(limits[0]), float(limits[1]))
        return inside(number) & inside(high) & ~F.coalesce(high < number, F.lit(False))
    allowed = [str(x).strip().lower() for x in limits]
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return (t == "") | t.isin(allowed)


#: The blanks that part sentences, as the content of a Java character class.
_GAP = r"\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def sentences(text: Column) -> Column:
    """A text's sentences, cut after full stops, question and exclamation marks, dandas, and at line ends; blanks alone are none."""
    return F.filter(F.split(text, rf"(?<=[.!?।])[{_GAP}]+|\n+"), lambda s: s.rlike(f"[^{_GAP}]"))


def evidence_sentence(text: Column, value: Column, most: int = 400) -> Column:
    """The sentence that states a value, at most `most` characters of it with the value among them; empty if none does.

    The value's first place in the text, in any case, is looked for, and the sentence grown from it
    to both sides, so that full stops inside a value don't cut it. Failing that, the first sentence that holds
    all of its numbers. A null text or value, and a blank value, have none.
    """
    wanted = F.lower(F.trim(F.regexp_replace(value, BLANK + "+", " ")))
    # Where a sentence ends, the blank after its stop becomes a line end; lengths stay.
    lines = F.regexp_replace(text, r"([.!?।])[^\S\n]", "$1\n")
    at, size = F.position(wanted, F.lower(text)), F.length(wanted)
    before = F.substring_index(F.substring(lines, F.lit(1), at - 1), "\n", -1)
    inside = F.substring(text, at, size)
    after = F.substring_index(F.substring(lines, at + size, F.length(text)), "\n", 1)
    room = F.greatest(F.lit(0), most - size)
    lead = F.least(F.length(before), F.greatest(room - F.length(after), F.floor(room / 2).cast("int")))
    grown = F.concat(F.substring(before, F.length(before) - lead + 1, lead), inside, after)
    numbers = F.regexp_extract_all(wanted, F.lit(r"\d[\d,.]*"), 0)
    counted = F.try_element_at(F.filter(sentences(F.lower(text)), lambda s: F.forall(numbers, lambda n: F.contains(s, n))), F.lit(1))
    found = F.when(at > 0, grown).when(F.size(numbers) > 0, counted)
    return F.when(F.coalesce(wanted, F.lit("")) == "", "").otherwise(F.substring(F.trim(F.coalesce(found, F.lit(""))), 1, most))


def trust_tier(domain: Column, tiers: dict[str, int], default: int = 3) -> Column:
    """A domain's tier by the longest listed suffix at a point; public bodies and universities are tier 1, others `default`."""
    out = F.when(domain.rlike(r"(^|\.)(gov|edu|mil|ac|nic)(\.[a-z]{2})?$"), 1).otherwise(default)
    for suffix, tier in sorted(tiers.items(), key=lambda kv: len(kv[0])):
        out = F.when((F.lower(domain) == suffix.lower()) | F.endswith(F.lower(domain), F.lit("." + suffix.lower())), tier).otherwise(out)
    return out


def phrase_matches(texts: DataFrame, phrases: DataFrame, text_id: str, text: str, term: str) -> DataFrame:
    """(`text_id`, `term`): vocabulary terms that stand in a text as whole words, in any case.

    Terms are met through their first word, so each text meets only terms that begin with one of
    its words; the whole phrase is then checked. Vocabulary of any size is joined, not looped over.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{M}\p{Nd}]+"), lambda w: w != "")
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" "))
    terms = phrases.where(F.col(term).isNotNull()).select(term, F.try_element_at(words(F.col(term)), F.lit(1)).alias("_first"), spaced(F.col(term)).alias("_phrase")).where("_first is not null").distinct()
    firsts = texts.where(F.col(text).isNotNull()).select(text_id, F.explode(F.array_distinct(words(F.col(text)))).alias("_first"))
    met = firsts.join(terms, "_first").select(text_id, term, "_phrase")
    # Only texts that hold a term's first word are read again.
    return met.join(texts.select(text_id, spaced(F.col(text)).alias("_text")), text_id).where(F.contains("_text", F.col("_phrase"))).select(text_id, term).distinct()
