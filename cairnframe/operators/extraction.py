"""From landed pages to candidates: stored fields, rules, vocabularies, model answers, other names, and their proof.

A candidate is one value that one page gives for one field of one thing, with the sentence that
states it. Pages are read once; what a page holds stays with the page, so the only shuffles are
the joins of its stored fields and of the vocabularies' first words.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnframe.functions.latin import name_key
from cairnframe.functions.standard import normal
from cairnframe.operators.evidence import NO_QUOTE, NOT_ON_PAGE, evidence_sentence, phrase_matches, proof, trust_tier
from cairnframe.plans.spec import EntitySpec, FieldSpec, Spec

PAGE = ["page_id", "url", "domain", "source_id", "fetched_at", "tier"]
CANDIDATE = ["entity_type", "identity", "field", "raw_value", "quote", "unit", *PAGE, "route", "origin", "by_selector"]
RELATION = ["from_type", "from_identity", "relation", "to_type", "to_identity", "quote", "page_id"]
#: Parts of field names that hold other names of a thing.
OTHER_NAMES = ("common_name", "local_name", "alias", "other_name")
#: The prefix of rules that are patterns over a page's text; other rules are selectors, which ran when the page landed.
PATTERN = "regex:"


@dataclass
class Extraction:
    """What pages gave: proved candidates, refused ones with a `reason`, relations and other names."""

    candidates: DataFrame
    rejected: DataFrame
    relations: DataFrame
    aliases: DataFrame


def page_tiers(pages: DataFrame, spec: Spec) -> DataFrame:
    """`pages` with `tier` as the project file judges the site now; files and services keep theirs, 3 if they have none."""
    web = F.col("source_id").isNull() & F.col("url").rlike("^https?://")
    return pages.withColumn("tier", F.when(web, trust_tier(F.col("domain"), spec.tiers)).otherwise(F.coalesce("tier", F.lit(3))).cast("int"))


def relevant(pages: DataFrame, least: float = 0.0, ids: list[int] | None = None, limit: int | None = None) -> DataFrame:
    """Pages of a relevance above `least`, of given ids if any; `limit` is for previews and takes the lowest ids."""
    out = pages.where(F.col("relevance") > least)
    out = out.where(F.col("page_id").isin(*ids)) if ids is not None else out
    return out.orderBy("page_id").limit(limit) if limit is not None else out


def without_refused_sources(pages: DataFrame, refused_ids: list[str], refused_sites: list[str]) -> DataFrame:
    """Pages whose text a model may see: not of a refused source, nor crawled from a refused website."""
    barred = F.coalesce(F.col("source_id").isin(*refused_ids), F.lit(False)) | (F.col("source_id").isNull() & F.coalesce(F.lower("domain").isin(*[s.lower() for s in refused_sites]), F.lit(False)))
    return pages.where(~barred)


def pattern_values(text: Column, f: FieldSpec) -> Column:
    """What a field's patterns match in a text, whole and in any case: all matches, of a single field each pattern's first."""
    found = []
    for rule in f.rules:
        if rule.startswith(PATTERN):
            hits = F.transform(F.regexp_extract_all(text, F.lit("(?i)" + rule.removeprefix(PATTERN)), 0), lambda x: F.trim(x))
            found.append(hits if f.multiple else F.slice(hits, 1, 1))
    return F.coalesce(F.concat(*found), F.array().cast("array<string>")) if found else F.array().cast("array<string>")


def head(text: Column) -> Column:
    """The first part of a title or of joined headings."""
    return F.substring_index(F.substring_index(F.coalesce(text, F.lit("")), "|", 1), " - ", 1)


def with_stored(pages: DataFrame, fields: DataFrame, names: list[str]) -> DataFrame:
    """`pages` with `stored`: the page's fields as (seq, name, value), in stored order (`seq`, else by value)."""
    seq = F.col("seq").cast("bigint") if "seq" in fields.columns else F.lit(0).cast("bigint")
    mine = fields.where(F.col("name").isin(*names) & F.col("value").isNotNull()).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(seq.alias("seq"), "name", "value"))).alias("stored"))
    empty = F.array().cast("array<struct<seq:bigint,name:string,value:string>>")
    return pages.join(mine, "page_id", "left").withColumn("stored", F.coalesce("stored", empty))


def _stored_of(name: str) -> Column:
    return F.transform(F.filter("stored", lambda x: x["name"] == name), lambda x: x["value"])


def identity_of(entity: EntitySpec) -> Column:
    """The page's name for its thing: the first identity field with a value, else its first heading, else its title."""
    options = []
    for key in entity.identity or [f.name for f in entity.fields[:1]]:
        f = entity.field(key)
        values = F.concat(_stored_of(key), pattern_values(F.coalesce("text", F.lit("")), f)) if f else _stored_of(key)
        options.append(F.nullif(normal(F.try_element_at(values, F.lit(1))), F.lit("")))
    heads = [F.nullif(normal(F.substring_index(F.coalesce("headings", F.lit("")), "|", 1)), F.lit("")), F.nullif(normal(head(F.col("title"))), F.lit(""))]
    return F.coalesce(*options, *heads)


def by_rules(pages: DataFrame, fields: DataFrame, entity: EntitySpec) -> DataFrame:
    """Candidates of the primary entity out of stored fields first and patterns second; a single field gives one a page.

    A value that no sentence states, but that a selector read from the page's markup, is proved by
    the selector. Pages without an identity, and pages that lack a required field, give none.
    """
    rows = with_stored(pages, fields, [f.name for f in entity.fields]).withColumn("identity", identity_of(entity)).where("identity is not null")
    text = F.coalesce("text", F.lit(""))
    per_field = []
    for f in entity.fields:
        values = F.concat(_stored_of(f.name), pattern_values(text, f))
        values = values if f.multiple else F.slice(values, 1, 1)
        selector = next((r for r in f.rules if not r.startswith(PATTERN)), None)

        per_field.append(F.transform(values, _quoted(f.name, selector, text)))
    found = rows.withColumn("_c", F.flatten(F.array(*per_field)))
    required = [f.name for f in entity.fields if f.required]
    whole = reduce(lambda a, n: a & F.exists("_c", lambda c: c["field"] == n), required, F.lit(True))
    flat = found.where(whole).select("identity", *PAGE, F.inline("_c"))
    return flat.select(F.lit(entity.name).alias("entity_type"), "identity", "field", "raw_value", "quote", F.lit(None).cast("string").alias("unit"), *PAGE, F.lit("rules").alias("route"), F.lit("extracted").alias("origin"), "by_selector")


def _quoted(name: str, selector: str | None, text: Column) -> Callable[[Column], Column]:
    """A value of a field with its quote: the sentence that states it, else the selector that read it."""

    def quoted(v: Column) -> Column:
        quote = evidence_sentence(text, v)
        marked = (quote == "") & F.array_contains(_stored_of(name), v) if selector else F.lit(False)
        shown = F.when(marked, F.concat(F.lit(f"[{selector}] "), v)).otherwise(quote)
        return F.struct(F.lit(name).alias("field"), v.alias("raw_value"), shown.alias("quote"), marked.alias("by_selector"))

    return quoted


def by_vocabulary(pages: DataFrame, identities: DataFrame, terms: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """(candidates, relations) of the entities that a vocabulary lists: each term whose alias a page holds as whole words.

    `terms` are (vocabulary, term, alias), `identities` (page_id, identity) of the primary entity,
    to which declared relations lead.
    """
    wanted = [(e.name, f.name, f.vocabulary) for e in spec.entities[1:] for f in e.fields if f.vocabulary and f.name in (e.identity or [f.name])]
    if not wanted:
        empty = pages.where("false")
        return _shaped(empty.selectExpr("'' as entity_type", "'' as identity", "'' as field", "'' as raw_value", "'' as quote", *PAGE)), identities.where("false").selectExpr("'' as from_type", "identity as from_identity", "'' as relation", "'' as to_type", "'' as to_identity", "'' as quote", "page_id")
    uses = F.array(*[F.struct(F.lit(a).alias("entity_type"), F.lit(b).alias("field"), F.lit(c).alias("_vocabulary")) for a, b, c in wanted])
    used = terms.join(terms.sparkSession.range(1).select(F.inline(uses)), F.col("vocabulary") == F.col("_vocabulary")).select("entity_type", "field", "term", "alias").distinct()
    met = phrase_matches(pages, used.select("alias").distinct(), "page_id", "text", "alias")
    rows = met.join(used, "alias").join(pages.select(*PAGE, "text"), "page_id").withColumn("quote", evidence_sentence(F.col("text"), F.col("alias"))).where("quote <> ''")
    candidates = _shaped(rows.select("entity_type", F.col("term").alias("identity"), "field", F.col("term").alias("raw_value"), "quote", *PAGE)).withColumn("route", F.lit("vocabulary")).dropDuplicates(["page_id", "entity_type", "field", "raw_value", "quote"])
    lead = [(r, b) for a, r, b in spec.relations if a == spec.primary.name]
    leads = F.array(*[F.struct(F.lit(r).alias("relation"), F.lit(b).alias("_to")) for r, b in lead]) if lead else F.array().cast("array<struct<relation:string,_to:string>>")
    pairs = rows.select("page_id", "entity_type", F.col("term").alias("to_identity"), "quote", F.inline(leads)).where("entity_type = _to").join(identities.select("page_id", F.col("identity").alias("from_identity")), "page_id")
    return candidates, pairs.select(F.lit(spec.primary.name).alias("from_type"), "from_identity", "relation", F.col("entity_type").alias("to_type"), "to_identity", "quote", "page_id").distinct()


def _shaped(rows: DataFrame) -> DataFrame:
    """`rows` with all columns of candidates."""
    given = {"unit": F.lit(None).cast("string"), "route": F.lit("rules"), "origin": F.lit("extracted"), "by_selector": F.lit(False)}
    return rows.withColumns({c: v for c, v in given.items() if c not in rows.columns}).select(*CANDIDATE)


def vocabulary_terms(vocabulary: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(vocabulary, term, alias): every term under itself and its aliases; places under their names and each of their `;`-parted aliases."""
    out = vocabulary.select("vocabulary", "term", "alias").unionByName(vocabulary.select("vocabulary", "term", F.col("term").alias("alias")))
    if places is not None:
        names = F.concat(F.array("name"), F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), ";"), lambda a: F.trim(a)), lambda a: a != ""))
        out = out.unionByName(places.select(F.lit("places").alias("vocabulary"), F.col("name").alias("term"), F.explode(names).alias("alias")))
    return out.where("alias is not null and term is not null").distinct()


def json_in(text: str | None) -> dict | None:
    """The JSON object in a model's answer, out of a fence or between its outermost braces; None if there is none."""
    if not text or "{" not in text or "}" not in text:
        return None
    try:
        got = json.loads(text[text.index("{") : text.rindex("}") + 1])
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def schema_prompt(spec: Spec) -> str:
    """What a model is told of the entities and their fields, and the form of its answer."""
    lines = [f"- {e.name} (identified by {', '.join(e.identity)}): " + ", ".join(f"{f.name} [{f.type}{' in ' + f.unit if f.unit else ''}{', several' if f.multiple else ''}]" for f in e.fields) for e in spec.entities]
    relations = [f"- {a} {r} {b}" for a, r, b in spec.relations]
    form = '{"records": [{"type": entity, "fields": {field: {"value": …, "unit": …, "quote": …}}}], "relations": [{"from": "entity:identity", "name": relation, "to": "entity:identity", "quote": …}]}'
    return "\n".join(["Entities:", *lines, *(["Relations:", *relations] if relations else []), "Quote the page word for word for every value. Answer with JSON:", form])


def model_answers(pages: DataFrame, ask: Callable[[pd.Series], pd.Series], cache: DataFrame | None = None) -> DataFrame:
    """(page_id, content_hash, answer): `ask` turns a batch of texts into answers, once per different text.

    Texts whose hash is in `cache` (content_hash, answer) are not asked again; null texts never.
    """
    texts = pages.where("text is not null").select("content_hash", "text").dropDuplicates(["content_hash"])
    known = cache.select("content_hash", "answer").dropDuplicates(["content_hash"]) if cache is not None else None
    fresh = texts.join(known, "content_hash", "left_anti") if known is not None else texts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"content_hash": b["content_hash"], "answer": ask(b["text"])})

    asked = fresh.mapInPandas(run, "content_hash string, answer string")
    return pages.select("page_id", "content_hash").join(asked.unionByName(known) if known is not None else asked, "content_hash").select("page_id", "content_hash", "answer")


def by_answers(answers: DataFrame, pages: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """(candidates, relations) out of model answers (page_id, answer); records of unknown types, without identity or value fall out."""
    fields = {e.name: {f.name for f in e.fields} for e in spec.entities}
    keys = {e.name: e.identity or [f.name for f in e.fields[:1]] for e in spec.entities}

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page, answer in zip(b["page_id"], b["answer"]):
                got = json_in(answer) or {}
                for record in got.get("records") or []:
                    kind = str(record.get("type", "")).strip() if isinstance(record, dict) else ""
                    cells = {k: c for k, c in (record.get("fields") or {}).items() if isinstance(c, dict) and k in fields[kind]} if kind in fields else {}
                    name = next((str(cells[k]["value"]) for k in keys.get(kind, ()) if cells.get(k, {}).get("value")), None)
                    for f, c in cells.items() if name else ():
                        values = c.get("value")
                        for v in values if isinstance(values, list) else [values]:
                            if v not in (None, "", []):
                                out.append((page, kind, name, f, str(v), str(c.get("quote") or ""), c.get("unit") and str(c["unit"])))
            yield pd.DataFrame(out, columns=["page_id", "entity_type", "identity", "field", "raw_value", "quote", "unit"])

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page, answer in zip(b["page_id"], b["answer"]):
                for x in (json_in(answer) or {}).get("relations") or []:
                    a, _, i = str(x.get("from", "")).partition(":") if isinstance(x, dict) else ("", "", "")
                    c, _, j = str(x.get("to", "")).partition(":") if isinstance(x, dict) else ("", "", "")
                    if a in fields and c in fields and i and j:
                        out.append((a, i, str(x.get("name", "related_to")), c, j, str(x.get("quote") or ""), page))
            yield pd.DataFrame(out, columns=RELATION)

    rows = answers.select("page_id", "answer")
    records = rows.mapInPandas(told, "page_id bigint, entity_type string, identity string, field string, raw_value string, quote string, unit string")
    relations = rows.mapInPandas(linked, ", ".join(f"{c} {'bigint' if c == 'page_id' else 'string'}" for c in RELATION))
    candidates = records.join(pages.select(*PAGE), "page_id").withColumns({"identity": normal(F.col("identity")), "route": F.lit("ai")}).where("identity <> ''")
    return _shaped(candidates), relations.withColumns({"from_identity": normal(F.col("from_identity")), "to_identity": normal(F.col("to_identity"))})


def verified(candidates: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with `reason`): the proof of each candidate by its quote and its page.

    What a selector read is its own proof. A model's value must be proved throughout; of a rule's
    value the quote need only stand on the page, and where it has none the sentence that states it is found.
    """
    both = candidates.join(pages.select("page_id", F.coalesce("text", F.lit("")).alias("_text")), "page_id", "left")
    judged = both.withColumn("_p", proof(F.col("raw_value"), F.col("quote"), F.col("_text"))).withColumn("_on", proof(F.lit("-"), F.col("quote"), F.col("_text"))["reason"])
    loose = F.col("route") != "ai"
    quoted = F.coalesce("quote", F.lit("")) != ""
    found = F.when(loose & ~quoted, evidence_sentence(F.col("_text"), F.col("raw_value"))).otherwise("")
    keeps = (F.col("by_selector") & (F.col("route") == "rules")) | F.col("_p.kept") | (loose & quoted & ~F.col("_on").isin(NO_QUOTE, NOT_ON_PAGE)) | (found != "")
    done = judged.withColumns({"_keeps": keeps, "quote": F.when(found != "", found).otherwise(F.col("quote")), "reason": F.col("_p.reason")})
    return done.where("_keeps").select(*CANDIDATE), done.where("not _keeps").select(*CANDIDATE, "reason")


def other_names(pages: DataFrame, fields: DataFrame, entity: EntitySpec, structured: DataFrame | None = None, most: int = 80) -> DataFrame:
    """(entity_type, identity, alias, language, source, page_id): other names that a page gives its thing, each once by its key.

    Names stand in the first heading and the title, whole and in their brackets, in fields of
    other names, and as `name` or `alternateName` of structured blocks (page_id, data). Names of
    more than `most` characters, and the identity itself, are none.
    """
    names = [f.name for f in entity.fields if any(w in f.name for w in OTHER_NAMES)] + list(entity.aliases_from)
    stored = list(dict.fromkeys([*names, *entity.identity, *[f.name for f in entity.fields[:1]]]))
    rows = with_stored(pages, fields, stored).withColumn("identity", identity_of(entity)).where("identity is not null")
    texts = [F.substring_index(F.coalesce("headings", F.lit("")), "|", 1), head(F.col("title"))]
    shown = [F.concat(F.array(F.regexp_replace(t, r"\([^)]*\)", "")), F.regexp_extract_all(t, F.lit(r"\(([^)]*)\)"), 1)) for t in texts]
    told = lambda values, source: F.transform(values, lambda v: F.struct(normal(v).alias("alias"), F.lit(source).alias("source")))
    every = [told(x, "page") for x in shown] + [told(_stored_of(n), "field") for n in dict.fromkeys(names)]
    base = rows
    if structured is not None:
        blocks = structured.select("page_id", F.array_compact(F.concat(_strings("$.alternateName"), _strings("$.name"))).alias("_n")).groupBy("page_id").agg(F.flatten(F.collect_list("_n")).alias("_named"))
        base = rows.join(blocks, "page_id", "left").withColumn("_named", F.coalesce("_named", F.array().cast("array<string>")))
        every.append(told(F.col("_named"), "json-ld"))
    language = F.substring_index(F.coalesce("lang", F.lit("")), "-", 1)
    flat = base.select("page_id", "identity", language.alias("language"), F.posexplode(F.flatten(F.array(*every))).alias("pos", "n")).select("page_id", "identity", "language", "pos", "n.alias", "n.source")
    keyed = flat.where((F.length("alias") > 0) & (F.length("alias") <= most)).withColumn("key", name_key(F.col("alias"))).where((F.col("key") != "") & (F.col("key") != name_key(F.col("identity"))))
    first = keyed.groupBy("page_id", "identity", "language", "key").agg(F.min(F.struct("pos", "alias", "source")).alias("f"))
    return first.select(F.lit(entity.name).alias("entity_type"), "identity", "f.alias", "language", "f.source", "page_id")


def _strings(path: str) -> Column:
    """The text or the texts of a list at a JSON path of `data`."""
    value = F.get_json_object("data", path)
    return F.when(value.startswith("["), F.from_json(value, "array<string>")).when(value.isNotNull() & ~value.startswith("{"), F.array(value)).otherwise(F.array().cast("array<string>"))


def extract(pages: DataFrame, fields: DataFrame, spec: Spec, terms: DataFrame | None = None, answers: DataFrame | None = None, structured: DataFrame | None = None) -> Extraction:
    """Everything that landed pages say about the entities of a project, proved.

    `pages` are landed pages, `fields` their stored (page_id, name, value), `terms` vocabularies as
    of `vocabulary_terms`, `answers` a model's (page_id, answer), `structured` JSON-LD blocks.
    """
    judged = page_tiers(pages, spec)
    primary = spec.primary
    found = by_rules(judged, fields, primary)
    relations = None
    if terms is not None:
        identities = found.select("page_id", "identity").distinct()
        listed, relations = by_vocabulary(judged, identities, terms, spec)
        found = found.unionByName(listed)
    if answers is not None:
        told, links = by_answers(answers, judged, spec)
        found, relations = found.unionByName(told), links if relations is None else relations.unionByName(links)
    if relations is None:
        relations = pages.sparkSession.createDataFrame([], ", ".join(f"{c} {'bigint' if c == 'page_id' else 'string'}" for c in RELATION))
    kept, rejected = verified(found, judged)
    return Extraction(kept, rejected, relations, other_names(judged, fields, primary, structured))
