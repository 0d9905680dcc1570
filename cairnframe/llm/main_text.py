"""The main body of web pages, apart from the furniture of their sites.

The token streams of all pages are masked (the page's own title becomes one token that no other
page has, digits become one sign) and compared as a sparse suffix array would, by grouping digests
of substrings that begin at line starts and part starts. A line without the page's title is
covered, and so furniture, if each of its parts (its sentences, or what its separators part)
stands on a page of another record too, be it as that page's title; a run that is unique to its
record stays. A line with the title begins like others: furniture repeats a beginning from page to
page and never goes on with another sentence nor stands in `headings`, prose and section headings
now and then do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnframe.session import cut

TOKEN = re.compile(r"[\wऀ-ॿ]+")
SENTENCES = re.compile(r"[.!?।…][\"”»“’]?\s+[^\W\d_]")
#: A text of `label: value` parts, which is main body throughout.
PARTS = re.compile(r"\s*[^:;|\n]{1,40}:\s[^;|\n]*(?:\s*[;|\n•·]\s*[^:;|\n]{1,40}:\s[^;|\n]*)+[;|\n]?\s*")
SHEET = re.compile(r"\s*\(\s*[\d\W]*\d[\d\W]*\)\s*$")
SUBTITLE = re.compile(r"\s[–—|-]\s")
# Month names as the pages' measurements write them.
MONTHS = frozenset("january february march april may june july august september october november december".split())

#: Where sentences and their clauses end, and what parts the entries of other lines.
SENTENCE_END = re.compile(r"(?<=[.!?।…:;])[\"”»“’]?\s+|\s+[–—]\s+")
PART_END = re.compile(r"\s*[|›»/•·:,;()\[\]—–&]\s*|\s{3,}|\s(?:and|und|et|y|e|i|и|और)\s")


def title_tokens(title: str | None) -> list[str]:
    """The words of a title without sheet number and subtitle, in lower case."""
    if not title:
        return []
    base = SUBTITLE.split(SHEET.sub("", " ".join(title.split())).strip())[0]
    return [t for t in TOKEN.findall(base.lower()) if not t[0].isdigit()]


def masked(tokens: list[str], title: list[str]) -> list[str]:
    """Tokens with the title as one `<T>`, runs of digits as one `#`."""
    out, i, n = [], 0, len(title)
    while i < len(tokens):
        if n and tokens[i] == title[0] and tokens[i : i + n] == title:
            out.append("<T>")
            i += n
        else:
            t = "#" if tokens[i][0].isdigit() else tokens[i]
            if t != "#" or not out or out[-1] != "#":
                out.append(t)
            i += 1
    return out


def _values_only(tokens: list[str]) -> bool:
    """Whether tokens are numbers, months and short words such as units."""
    return all(t[0].isdigit() or t in ("#", "<T>") or len(t) < 3 or t in MONTHS for t in tokens)


def parts(line: str, own: list[str], numbers: bool) -> list[str]:
    """The masked parts of a line, each once: sentences where it has several, else what separators part; values are none."""
    ends = SENTENCE_END if SENTENCES.search(line) else PART_END
    found = dict.fromkeys(tuple(masked(TOKEN.findall(p), own)) for p in ends.split(line))
    return [" ".join(p) for p in found if p and not (numbers and _values_only(list(p)))]


#: What is asked of the corpus for a line: how its beginning goes on, whether its parts are repeated; headings and titles only inform it.
BEGINNING, HEADING, PARTED, TITLE = range(4)


def questions(page_id, title, headings, text: str, beginning: int) -> Iterator[tuple]:
    """What the corpus is asked about a page's lines: (page, line, question, extended, substrings, owner).

    Lines of values (numbers, months and at most one longer word) hold nothing that could repeat
    and are main body, as are pages of `label: value` parts; nothing is asked about them.
    """
    if PARTS.fullmatch(text):
        return
    own = title_tokens(title)
    owner = " ".join(own)
    if own:
        yield page_id, 0, TITLE, False, [owner], owner
    first = own[0] if own else None
    heads = {" ".join(TOKEN.findall(h)) for h in headings.lower().split(" | ")} if headings else ()
    for k, line in enumerate(text.lower().split("\n"), 1):
        tokens = TOKEN.findall(line)
        if not tokens:
            continue
        seen = masked(tokens, own) if first is not None and first in line else None
        if seen and "<T>" in seen:
            if not _values_only(seen):
                starts = [" ".join(seen[:n]) + ("$" if len(seen) < n else "") for n in range(1, min(beginning, len(seen) + 1) + 1)]
                yield page_id, k, HEADING if " ".join(tokens) in heads else BEGINNING, bool(SENTENCES.search(line)), starts, owner
            continue
        numbers = any(c.isdigit() for c in line)
        words = sum(not _values_only([t]) for t in tokens) if numbers else len(tokens)
        if numbers and words < (1 if "©" in line else 2):
            continue
        yield page_id, k, PARTED, False, parts(line, own, numbers), owner


def furniture_lines(pages: DataFrame, least: int = 6, page: str = "page_id", beginning: int = 4) -> DataFrame:
    """(`page`, `line_no`) of each line of `text` that is not main body; lines count from 1, blank lines never.

    `least` is the number of lines, of more than one record, that must share a beginning (at most
    the first `beginning` tokens of a line with the page's title) for it to count as repeated.
    Copies of a record, pages of one title, don't make a part repeated. Pages with a null title
    are one record; null and empty texts have no lines; a null `headings` is an empty one. A page
    in several rows is judged in each.

    The texts are read once. What is shuffled are digests, combined before the shuffle to one row
    each, so a beginning or part that stands on a third of all pages burdens no task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for x in zip(b[page], b["title"], b["headings"], b["text"]) for r in questions(*x, beginning)]
            yield pd.DataFrame(rows, columns=[page, "line_no", "question", "extended", "strings", "owner"])

    kind = pages.schema[page].dataType.simpleString()
    texts = pages.where(F.col("text").isNotNull()).select(page, "title", "headings", "text")
    lines = texts.mapInPandas(run, f"`{page}` {kind}, line_no bigint, question int, extended boolean, strings array<string>, owner string")
    # A beginning is told from a part of the same words.
    tag = F.when(F.col("question") <= HEADING, 1).otherwise(0)
    lines = cut(lines.select(page, "line_no", "question", "extended", F.transform("strings", lambda p: F.xxhash64(p, tag)).alias("digests"), F.xxhash64("owner").alias("owner")))
    every = lines.select(page, "line_no", "question", "extended", "owner", F.explode("digests").alias("digest"))
    counted = every.groupBy("digest").agg(
        F.count("*").alias("lines"),
        (F.min("owner") != F.max("owner")).alias("elsewhere"),
        F.count_if(F.col("extended")).alias("extended"),
        F.count_if(F.col("question") == HEADING).alias("heads"),
        F.max("question").alias("question"),
    )
    counted = cut(counted.where(F.col("elsewhere") | (F.col("question") >= PARTED)))
    never = counted.where((F.col("question") <= HEADING) & (F.col("lines") >= least) & (F.col("extended") * 50 <= F.col("lines")) & (F.col("heads") * 20 <= F.col("lines"))).select("digest")
    repeats = every.where(F.col("question") == BEGINNING).select(page, "line_no", "digest").join(never, "digest", "left_semi").select(page, "line_no")
    # Few parts are unique to a record; the lines that hold one stay.
    unique = counted.where((F.col("question") >= PARTED) & ~F.col("elsewhere")).select("digest")
    stay = every.where(F.col("question") == PARTED).select(page, "line_no", "digest").join(unique, "digest", "left_semi").select(page, "line_no").distinct()
    covered = lines.where((F.col("question") == PARTED) & (F.size("digests") > 0)).select(page, "line_no").join(stay, [page, "line_no"], "left_anti")
    return covered.unionByName(repeats).distinct()


def main_bodies(pages: DataFrame, furniture: DataFrame, page: str = "page_id") -> DataFrame:
    """`pages` with only main-body lines in `text` and headings of the main body in `headings`."""
    drop = furniture.groupBy(page).agg(F.collect_set(F.col("line_no").cast("int")).alias("_drop"))
    both = pages.join(drop, page, "left").withColumn("_drop", F.coalesce("_drop", F.array().cast("array<int>")))
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains("_drop", i + 1))
    gone = F.transform(F.filter(lines, lambda _, i: F.array_contains("_drop", i + 1)), lambda x: F.lower(F.trim(x)))
    heads = F.filter(F.split("headings", r" \| "), lambda h: ~F.array_contains(gone, F.lower(F.trim(h))))
    return both.withColumns({"text": F.when(F.col("text").isNotNull(), F.array_join(kept, "\n")), "headings": F.when(F.col("headings").isNotNull(), F.array_join(heads, " | "))}).drop("_drop")
