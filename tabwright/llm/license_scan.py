"""License detection by ordered signature rules. DataFrame functions only.

Every rule is a regular expression over the words of a text, with a label, a priority and keywords, one of which any match must hold. A
text is scanned only if it holds one of the general words, and a rule runs only if one of its keywords is there. Both are drawn
from the patterns themselves (:func:`held`), so no gate drops a match. Overlapping detections are
resolved by priority and containment: a detection inside another one of at least its priority is dropped, as a bare license
name is inside a notice that names it. The rules come from short hand-written fragments per license, put into sentence templates.

Words are lower-cased in A-Z; anything but ASCII letters, digits and characters beyond ASCII parts them. For matching each word
gets a space on either side, so that neighbouring matches share nothing and every match starts and ends with a word.

Defined results: null and empty texts have no words and no detections. Repeated rows are scanned each; ids pass as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import PLAIN_GAP, ascii_lower, quoted, whole

#: Fixed phrases of the base result.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Priorities: a name, an address, a notice or a piece of the license's own text, a machine-readable identifier.
NAME, ADDRESS, NOTICE, TAG = 1, 2, 3, 4
#: Texts that a part of a pattern may have to count as few.
MOST_TEXTS = 32
SCORES = {NAME: 0.6, ADDRESS: 0.75, NOTICE: 0.9, TAG: 1.0}

LICENSE = "licen[cs]es?"
VERSION = "(?: (?:v|version|v[0-9]))?(?: [0-9]+)*(?: only| or later| or any later version)?"
GRANT = "(?:licen[cs]ed|released|distributed|available|provided|published|covered)"
UNDER = "(?:under|by|subject to)(?: the)?(?: terms(?: and conditions)? of)?(?: an?| the)?"

#: label: name (without "license"), whether the name stands alone, identifiers, addresses.
LICENSES = {
    "mit": ("mit(?: x11)?|massachusetts institute of technology", False, "mit", "opensource org licenses mit(?: license(?: php)?)?"),
    "apache": ("apache(?: software)?(?: foundation)?", False, "apache [0-9] [0-9]", "apache org licenses(?: license 2 0(?: txt| html)?)?"),
    "gpl": ("gpl|gpl(?: |)v?[0-9]|gnu gpl|(?:gnu )?general public", False, "gpl [0-9] [0-9](?: only| or later)?", "gnu org (?:licenses|copyleft) gpl(?: [0-9] 0)?(?: html| txt)?"),
    "lgpl": ("lgpl|lgpl(?: |)v?[0-9]|(?:gnu )?(?:lesser|library) general public", False, "lgpl [0-9] [0-9](?: only| or later)?", "gnu org (?:licenses|copyleft) lgpl(?: [0-9] [0-9])?(?: html| txt)?"),
    "agpl": ("agpl|agpl(?: |)v?[0-9]|(?:gnu )?affero general public", False, "agpl [0-9] [0-9](?: only| or later)?", "gnu org licenses agpl(?: [0-9] 0)?(?: html| txt)?"),
    "gfdl": ("gfdl|fdl|(?:gnu )?free documentation", False, "gfdl [0-9] [0-9](?: only| or later)?", "gnu org (?:licenses|copyleft) fdl(?: html| txt)?"),
    "bsd": ("(?:(?:new|modified|simplified|revised|original) )?bsd(?: style)?|bsd [0234] clause|[0234] clause bsd|(?:two|three|four) clause bsd", False, "(?:0bsd|bsd [1234] clause)", "opensource org licenses bsd(?: [23] clause| license)?(?: php)?"),
    "mpl": ("mpl|mozilla public", False, "mpl [0-9] [0-9]", "mozilla org (?:en us )?mpl(?: 2 0| 1 1)?"),
    "epl": ("epl|eclipse public", False, "epl [0-9] [0-9]", "eclipse org (?:legal|org documents) epl (?:v10|2 0)(?: html)?"),
    "eupl": ("eupl|european union public", False, "eupl [0-9] [0-9]", "joinup ec europa eu [a-z ]{0,60}eupl"),
    "cddl": ("cddl|common development and distribution", False, "cddl [0-9] [0-9]", "opensource org licenses cddl(?: [0-9])*(?: php)?"),
    "cpl": ("common public", False, "cpl 1 0", "opensource org licenses cpl1 0(?: php)?"),
    "isc": ("isc", False, "isc", "opensource org licenses isc(?: license(?: txt)?)?"),
    "zlib": ("zlib(?: libpng)?", False, "zlib", "zlib net zlib license(?: html)?"),
    "boost": ("bsl 1 0|boost(?: software)?", False, "bsl 1 0", "boost org license 1 0(?: txt)?"),
    "artistic": ("(?:perl )?artistic|clarified artistic", False, "artistic [0-9] [0-9](?: perl| cl8)?", "opensource org licenses artistic license(?: 2 0)?(?: php)?"),
    "psf": ("psf|python software foundation", False, "(?:psf 2 0|python 2 0)", "python org psf license|docs python org 3 license html"),
    "php": ("php", False, "php 3 0[0-9]?", "php net license(?: 3 01)?(?: txt)?"),
    "ruby": ("ruby", False, "ruby", "ruby lang org en about license(?: txt)?"),
    "openssl": ("openssl", False, "openssl", "openssl org source license(?: html)?"),
    "postgresql": ("postgresql", False, "postgresql", "postgresql org about licen[cs]e"),
    "ofl": ("ofl|(?:sil )?open font", False, "ofl [0-9] [0-9](?: no rfn| rfn)?", "(?:scripts sil org|openfontlicense org)(?: |)ofl"),
    "ncsa": ("ncsa|university of illinois ncsa open source", False, "ncsa", "opensource org licenses ncsa(?: php)?"),
    "cecill": ("cecill(?: [abc])?", False, "cecill(?: [abc]| [0-9] [0-9])+", "cecill info licences(?: en| fr)?(?: html)?"),
    "osl": ("osl [0-9] [0-9]|open software", False, "osl [0-9] [0-9]", "opensource org licenses osl 3 0(?: php)?"),
    "afl": ("afl [0-9] [0-9]|academic free", False, "afl [0-9] [0-9]", "opensource org licenses afl 3 0(?: php)?"),
    "apsl": ("apple public source", False, "apsl [0-9] [0-9]", "opensource apple com license apsl"),
    "ms-pl": ("ms pl|microsoft public", False, "ms pl", "opensource org licenses ms pl(?: html)?"),
    "ms-rl": ("ms rl|microsoft reciprocal", False, "ms rl", "opensource org licenses ms rl(?: html)?"),
    "unlicense": ("unlicense", True, "unlicense", "unlicense org"),
    "wtfpl": ("wtfpl|do what the f[a-z]+ you want to public", True, "wtfpl", "wtfpl net(?: about| txt copying)?"),
    "beerware": ("beerware", True, "beerware", "people freebsd org phk"),
    "cc0": ("cc0|creative commons zero", True, "cc0 1 0", "creativecommons org publicdomain zero 1 0"),
    "cc-by": ("cc by|creative commons attribution", True, "cc by [0-9] [0-9]", "creativecommons org licenses by [0-9] [0-9]"),
    "cc-by-sa": ("cc by sa|creative commons attribution share(?: |)alike", True, "cc by sa [0-9] [0-9]", "creativecommons org licenses by sa [0-9] [0-9]"),
    "cc-by-nd": ("cc by nd|creative commons attribution no(?: |)deriv[a-z]+", True, "cc by nd [0-9] [0-9]", "creativecommons org licenses by nd [0-9] [0-9]"),
    "cc-by-nc": ("cc by nc|creative commons attribution non(?: |)commercial", True, "cc by nc [0-9] [0-9]", "creativecommons org licenses by nc [0-9] [0-9]"),
    "cc-by-nc-sa": ("cc by nc sa|creative commons attribution non(?: |)commercial share(?: |)alike", True, "cc by nc sa [0-9] [0-9]", "creativecommons org licenses by nc sa [0-9] [0-9]"),
    "cc-by-nc-nd": ("cc by nc nd|creative commons attribution non(?: |)commercial no(?: |)deriv[a-z]+", True, "cc by nc nd [0-9] [0-9]", "creativecommons org licenses by nc nd [0-9] [0-9]"),
    "odbl": ("odbl|open data commons open database|open database", False, "odbl 1 0", "opendatacommons org licenses odbl(?: 1 0| summary)?"),
    "odc-by": ("open data commons attribution", False, "odc by 1 0", "opendatacommons org licenses by(?: 1 0)?"),
    "pddl": ("open data commons public domain dedication and", False, "pddl 1 0", "opendatacommons org licenses pddl(?: 1 0)?"),
    "ogl": ("open government", False, "ogl uk [0-9] 0", "nationalarchives gov uk doc open government licence(?: version [0-9])?"),
    "sspl": ("sspl|server side public", False, "sspl 1 0", "mongodb com licensing server side public license"),
    "busl": ("busl|business source", False, "busl 1 1", "mariadb com bsl11"),
    "elastic": ("elastic", False, "elastic 2 0", "elastic co licensing elastic license"),
    "blueoak": ("blue oak model", False, "blueoak 1 0 0", "blueoakcouncil org license 1 0 0"),
    "mulan": ("mulan(?: psl| permissive software| publ)?", False, "mulanpsl [0-9] [0-9]", "license coscl org cn mulanpsl2?"),
    "unicode": ("unicode", False, "unicode (?:dfs [0-9]+|3 0)", "unicode org (?:copyright|license)(?: html| txt)?"),
    "vim": ("vim", False, "vim", "vimdoc sourceforge net htmldoc uganda html"),
    "w3c": ("w3c(?: software(?: and document)?)?", False, "w3c(?: 20150513| 19980720)?", "w3 org consortium legal copyright software"),
    "zpl": ("zope public", False, "zpl [0-9] [0-9]", "zope org resources zpl"),
    "sleepycat": ("sleepycat", False, "sleepycat", "opensource org licenses sleepycat(?: php)?"),
    "qpl": ("qpl|q public", False, "qpl 1 0", "opensource org licenses qpl 1 0"),
    "json": ("json", False, "json", "json org license(?: html)?"),
    "curl": ("curl", False, "curl", "curl se docs copyright html"),
    "ftl": ("freetype(?: project)?", False, "ftl", "freetype org license(?: html)?"),
    "openrail": ("(?:creativeml |bigscience )?(?:open(?: |)rail(?: m)?|bloom rail)", False, "(?:creativeml openrail m|bigscience bloom rail 1 0)", "huggingface co spaces [a-z ]{0,60}license"),
}
#: label: phrase of the license's own text or a usual statement.
PHRASES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "neither the name of [a-z0-9 ]{1,80} nor the names of its contributors may be used to endorse or promote"),
    ("apache", "you may not use this (?:file|work) except in compliance with the license"),
    ("gpl", "this (?:program|library|software) is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this (?:program|library|software) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "this (?:program|library|software) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "you should have received a copy of the gnu general public license"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("boost", "distributed under the boost software license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "(?:is|are|was|were|released|dedicated|placed) (?:hereby )?(?:in|into|to) the public domain"),
    ("cc0", "has waived all copyright and related or neighboring rights"),
    ("proprietary", "all rights reserved"),
    ("proprietary", "confidential and proprietary (?:information )?(?:of [a-z0-9 ]{1,40} )?all rights reserved"),
    ("copyright", "copyright(?: c)? [12][0-9]{3}(?: [12][0-9]{3})*(?: by)?"),
)


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    keyword: str
    pattern: str
    #: Of these any match holds one; ``keyword`` is the longest text that all of them hold.
    keywords: tuple[str, ...]
    #: Words of the general gate, of which any match holds one.
    general: tuple[str, ...]


def _alternatives(words: str) -> list[str]:
    """The parts of a pattern between the bars outside of all brackets."""
    out, depth = [""], 0
    for c in words:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _fewest(texts: set[str]) -> tuple[str, ...]:
    """Without the texts that hold another one."""
    return tuple(sorted(t for t in texts if not any(u != t and u in t for u in texts)))


def _needed(tree) -> tuple[set[str] | None, list[set[str]]]:
    """All texts that a parsed pattern matches, if they are few, and sets of texts of which any match holds one."""
    now, sets, exact = {""}, [], True
    for op, value in tree:
        own: set[str] | None = None
        if op is _parser.LITERAL:
            own = {chr(value)}
        elif op is _parser.IN and all(o is _parser.LITERAL for o, _ in value):
            own = {chr(c) for _, c in value}
        elif op is _parser.SUBPATTERN:
            own, more = _needed(value[3])
            sets += more
        elif op is _parser.BRANCH:
            parts = [_needed(v) for v in value[1]]
            if all(e is not None for e, _ in parts):
                own = set().union(*[e for e, _ in parts])
            elif all(m for _, m in parts):
                sets.append(set().union(*[max(m, key=_worth) for _, m in parts]))
        elif op is _parser.MAX_REPEAT and value[:2] == (0, 1):
            own = _needed(value[2])[0]
            own = own and own | {""}
        joined = own and {x + y for x in now for y in own}
        if joined and len(joined) <= MOST_TEXTS:
            now = joined
        else:
            sets.append(now)
            now, exact = own or {""}, False
    return now if exact else None, [t for t in [*sets, now] if all(t)]


def _worth(texts: set[str]) -> tuple[int, int]:
    return min(map(len, texts)), -len(texts)


def held(words: str) -> tuple[str, ...]:
    """Texts of which any match of a rule's words holds one, for each alternative the longest ones."""
    out: set[str] = set()
    for part in _alternatives(words):
        out |= max(_needed(_parser.parse(" (?:" + part.replace(" ", "  ") + ") "))[1], key=_worth)
    return _fewest(out)


def _common(texts: tuple[str, ...]) -> str:
    first = texts[0]
    parts = {first[a:b] for a in range(len(first)) for b in range(a + 1, len(first) + 1)}
    return max((x for x in parts if all(x in t for t in texts)), key=lambda x: (len(x), x), default="")


def _rule(name: str, label: str, priority: int, words: str, keyword: str | None = None, general: str | None = None) -> Rule:
    """Each space between words becomes two, one for either word. ``keyword`` and ``general``: parts of ``words`` that give the gates."""
    keywords = held(words if keyword is None else keyword)
    return Rule(name, label, priority, _common(keywords), " (?:" + words.replace(" ", "  ") + ") ", keywords, keywords if general is None else held(general))


def build_rules() -> tuple[Rule, ...]:
    """All rules in order: the order settles ties between detections of one place and priority."""
    out = [_rule(f"text-{k}", label, NOTICE, words) for k, (label, words) in enumerate(PHRASES)]
    for label, (name, alone, tags, address) in LICENSES.items():
        named = f"(?:the )?(?:{name}){VERSION}(?: international| unported)?"
        titled = f"{named} {LICENSE}{VERSION}"
        out += [
            _rule(f"{label}-tag", label, TAG, f"spdx license identifier(?:(?: [a-z0-9]+){{1,6}} (?:or|and))? {tags}", "spdx license identifier"),
            _rule(f"{label}-notice", label, NOTICE, f"{GRANT} {UNDER} (?:{titled}|{named})", name, f"{GRANT} (?:under|by|subject to)"),
            _rule(f"{label}-address", label, ADDRESS, f"(?:{address})", address),
            _rule(f"{label}-title", label, NAME, f"(?:{name}){VERSION} {LICENSE}{VERSION}", name, LICENSE),
            _rule(f"{label}-field", label, NOTICE, f"{LICENSE} (?:{name}){VERSION}", name, LICENSE),
        ]
        if alone:
            out.append(_rule(f"{label}-name", label, NAME, f"(?:{name}){VERSION}", name))
    return tuple(out)


RULES = build_rules()
#: A text without any of these has no detections.
GENERAL = _fewest({" ".join(w.split()) for r in RULES for w in r.general} | {"licen"})
SPAN = "array<struct<start:int,size:int,priority:int,rule:int,label:string>>"


def spread_words(text: Column) -> Column:
    """The words of the text, each with a space on either side."""
    inner = F.trim(F.regexp_replace(ascii_lower(text), PLAIN_GAP, "  "))
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def word_count(spread: Column) -> Column:
    return F.floor((F.length(spread) - F.length(F.replace(spread, F.lit(" "), F.lit("")))) / 2).cast("int")


def _matches(spread: Column, pattern: Column) -> Column:
    """Start and size in words of a pattern's matches, from the texts between and in them."""
    rows = F.arrays_zip(F.split(spread, pattern, -1).alias("gap"), F.regexp_extract_all(spread, pattern, F.lit(0)).alias("hit"))

    def step(a: Column, r: Column) -> Column:
        start = a["at"] + word_count(r["gap"])
        size = word_count(r["hit"])
        one = F.array(F.struct(start.alias("start"), size.alias("size")))
        return F.struct(F.coalesce(start + size, a["at"]).alias("at"), F.when(r["hit"].isNotNull(), F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("out"))
    return F.aggregate(rows, first, step, lambda a: a["out"])


def gated(spread: Column) -> Column:
    """Whether the text holds a general word."""
    found = F.lit(False)
    for word in GENERAL:
        found = found | F.contains(spread, F.lit(word.replace(" ", "  ")))
    return found


def detections(spread: Column) -> Column:
    """All matches of all rules of whose keywords the text holds one, those that start first and reach furthest first."""
    groups: dict[tuple[str, ...], list[Column]] = {}
    for k, r in enumerate(RULES):
        groups.setdefault(r.keywords, []).append(F.struct(F.lit(k).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.pattern).alias("pattern")))
    table = F.array(*[F.struct(F.array(*map(F.lit, words)).alias("keywords"), F.array(*rules).alias("rules")) for words, rules in groups.items()])
    held_groups = F.filter(table, lambda g: F.exists(g["keywords"], lambda w: F.contains(spread, w)))
    found = F.transform(
        F.flatten(F.transform(held_groups, lambda g: g["rules"])),
        lambda r: F.transform(
            _matches(spread, r["pattern"]),
            lambda m: F.struct(m["start"].alias("start"), (-m["size"]).alias("size"), (-r["priority"]).alias("priority"), r["rule"].alias("rule"), r["label"].alias("label")),
        ),
    )
    return F.when(gated(spread), F.array_sort(F.flatten(found))).otherwise(F.array().cast(SPAN))


def resolved(found: Column) -> Column:
    """Of sorted detections those that lie in no other one of their priority or above.

    What contains a detection comes before it in the order, so one pass with the furthest end per priority is enough.
    """

    def step(a: Column, d: Column) -> Column:
        end, rank = d["start"] - d["size"], -d["priority"]
        inside = F.lit(False)
        for p in range(NAME, TAG + 1):
            inside = inside | ((rank <= p) & (a[f"end{p}"] >= end))
        ends = [F.when(rank == p, F.greatest(a[f"end{p}"], end)).otherwise(a[f"end{p}"]).alias(f"end{p}") for p in range(NAME, TAG + 1)]
        return F.struct(*ends, F.when(inside, a["out"]).otherwise(F.concat(a["out"], F.array(d))).alias("out"))

    first = F.struct(*[F.lit(-1).alias(f"end{p}") for p in range(NAME, TAG + 1)], F.array().cast(SPAN).alias("out"))
    kept = F.aggregate(found, first, step, lambda a: a["out"])
    return F.transform(
        kept,
        lambda d: F.struct(
            d["label"].alias("label"), F.element_at(F.array(*[F.lit(r.name) for r in RULES]), d["rule"] + 1).alias("rule"), (-d["priority"]).alias("priority"),
            d["start"].alias("first_word"), (d["start"] - d["size"] - 1).alias("last_word"),
        ),
    )


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``n_words``, ``base`` (places of the base phrases) and ``found`` (resolved detections: label, rule, priority, words)."""
    own = docs.select(F.col(quoted(key)).alias("doc_id"), spread_words(whole(F.col(quoted(text)))).alias("spread"))
    s = F.col("spread")
    phrases = [(_rule(p, label, NAME, p).pattern, label) for p, label in BASE.items()]
    places = F.concat(*[_labelled(_matches(s, F.lit(p)), label) for p, label in phrases])
    base = F.when(F.contains(s, F.lit("  license ")), F.array_sort(places)).otherwise(F.array().cast("array<struct<start:int,label:string>>"))
    out = own.select("doc_id", "spread", word_count(s).cast("long").alias("n_words"), base.alias("base"), detections(s).alias("all_found"))
    return out.select("doc_id", "n_words", "base", resolved(F.col("all_found")).alias("found"))


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda m: F.struct(m["start"].alias("start"), F.lit(label).alias("label")))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the base places, the labels and a score: that of the best detection, at least a name's for a base place."""
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base, found = F.col("base"), F.col("found")
    own = F.transform(base, lambda b: b["label"])
    top = F.greatest(F.coalesce(F.array_max(F.transform(found, lambda d: d["priority"])), F.lit(0)), F.when(F.size(base) > 0, NAME).otherwise(0))
    score = F.element_at(F.array(F.lit(0.0), *[F.lit(SCORES[p]) for p in sorted(SCORES)]), top + 1)
    starts = F.transform(base, lambda b: b["start"].cast("long"))
    return detect(docs, key, text).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(own).alias("base_labels"), joined(F.concat(own, F.transform(found, lambda d: d["label"]))).alias("labels"), score.alias("score"),
        F.size(found).cast("long").alias("n_found"),
    )
