"""License scans with ordered signature rules, in DataFrame expressions only.

A text is first tested for any of a few stems; only texts that have one go on.
Of the rules (one regular expression over the text's words each) only those
run whose keyword stands in the text. Where places overlap, one that lies
within another yields, and of two at the same place the rule of the higher
priority stays; base rules count before this and keep their labels.
"""

from __future__ import annotations

import functools
import json
import operator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that are not part of a word (ASCII without digits and letters).
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Rule(NamedTuple):
    label: str
    keyword: str  # a word that any match contains
    pattern: str  # over words joined by single spaces, letter case ignored
    priority: int
    confidence: float
    base: bool = False


#: Phrases that every scan reports: label, keyword, phrase.
BASE = (("mit", "mit", "mit license"), ("apache", "apache", "apache license"), ("gpl", "public", "general public license"))

#: Families with versions: label stem, keyword, names, versions (words as in a text, dots split words).
FAMILIES = (
    ("gpl", "gpl", ("gpl", "gnu gpl"), ("1.0", "2.0", "3.0")),
    ("gpl", "general", ("gnu general public licen[cs]e", "(?<!(?:lesser|library|affero) )general public licen[cs]e"), ("1.0", "2.0", "3.0")),
    ("lgpl", "lgpl", ("lgpl", "gnu lgpl"), ("2.0", "2.1", "3.0")),
    ("lgpl", "lesser", ("(?:gnu )?lesser general public licen[cs]e",), ("2.1", "3.0")),
    ("lgpl", "library", ("(?:gnu )?library general public licen[cs]e",), ("2.0",)),
    ("agpl", "agpl", ("agpl", "gnu agpl"), ("1.0", "3.0")),
    ("agpl", "affero", ("(?:gnu )?affero general public licen[cs]e",), ("1.0", "3.0")),
    ("gfdl", "gfdl", ("gfdl",), ("1.1", "1.2", "1.3")),
    ("gfdl", "documentation", ("(?:gnu )?free documentation licen[cs]e",), ("1.1", "1.2", "1.3")),
    ("apache", "apache", ("apache(?: software)? licen[cs]e", "apache"), ("1.0", "1.1", "2.0")),
    ("mpl", "mpl", ("mpl",), ("1.0", "1.1", "2.0")),
    ("mpl", "mozilla", ("mozilla public licen[cs]e",), ("1.0", "1.1", "2.0")),
    ("epl", "eclipse", ("eclipse public licen[cs]e",), ("1.0", "2.0")),
    ("epl", "epl", ("epl",), ("1.0", "2.0")),
    ("cddl", "cddl", ("cddl",), ("1.0", "1.1")),
    ("cddl", "distribution", ("common development and distribution licen[cs]e",), ("1.0", "1.1")),
    ("cpl", "common", ("common public licen[cs]e",), ("1.0",)),
    ("eupl", "eupl", ("eupl",), ("1.0", "1.1", "1.2")),
    ("eupl", "european", ("european union public licen[cs]e",), ("1.0", "1.1", "1.2")),
    ("artistic", "artistic", ("(?:the )?artistic licen[cs]e",), ("1.0", "2.0")),
    ("osl", "open", ("open software licen[cs]e",), ("1.0", "2.0", "2.1", "3.0")),
    ("afl", "academic", ("academic free licen[cs]e",), ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("ofl", "font", ("(?:sil )?open font licen[cs]e",), ("1.0", "1.1")),
    ("ofl", "ofl", ("(?:sil )?ofl",), ("1.0", "1.1")),
    ("psf", "python", ("python software foundation licen[cs]e",), ("2.0",)),
    ("php", "php", ("php licen[cs]e",), ("3.0", "3.01")),
    ("zpl", "zope", ("zope public licen[cs]e",), ("1.1", "2.0", "2.1")),
    ("lppl", "latex", ("latex project public licen[cs]e",), ("1.0", "1.1", "1.2", "1.3")),
    ("cecill", "cecill", ("cecill(?: free software licen[cs]e(?: agreement)?)?",), ("1.0", "1.1", "2.0", "2.1")),
    ("bsl", "boost", ("boost software licen[cs]e",), ("1.0",)),
    ("busl", "business", ("business source licen[cs]e",), ("1.1",)),
    ("sspl", "server", ("server side public licen[cs]e",), ("1.0",)),
    ("elastic", "elastic", ("elastic licen[cs]e",), ("2.0",)),
    ("odbl", "database", ("open (?:data commons open )?database licen[cs]e",), ("1.0",)),
    ("upl", "universal", ("universal permissive licen[cs]e",), ("1.0",)),
    ("mulan", "mulan", ("mulan (?:permissive software licen[cs]e|psl)",), ("1.0", "2.0")),
    ("ms-pl", "microsoft", ("microsoft public licen[cs]e",), ()),
    ("ms-rl", "microsoft", ("microsoft reciprocal licen[cs]e",), ()),
    ("isc", "isc", ("isc licen[cs]e",), ()),
    ("zlib", "zlib", ("zlib(?: libpng)? licen[cs]e",), ()),
    ("unlicense", "unlicense", ("(?:the )?unlicense",), ()),
    ("wtfpl", "wtfpl", ("wtfpl",), ("2.0",)),
    ("ncsa", "ncsa", ("(?:university of illinois )?ncsa(?: open source)? licen[cs]e",), ()),
    ("postgresql", "postgresql", ("postgresql licen[cs]e",), ()),
    ("openssl", "openssl", ("openssl licen[cs]e",), ()),
    ("w3c", "w3c", ("w3c software(?: notice and)? licen[cs]e",), ()),
    ("ruby", "ruby", ("ruby licen[cs]e",), ()),
    ("perl", "perl", ("same terms as perl(?: itself)?",), ()),
    ("vim", "vim", ("vim licen[cs]e",), ()),
    ("json", "json", ("json licen[cs]e",), ()),
    ("beerware", "beer", ("beer ware licen[cs]e", "beer ware"), ()),
    ("beerware", "beerware", ("beerware licen[cs]e",), ()),
    ("mit", "mit", ("mit licen[cs]e", "mit(?: style| x11)? licen[cs]ed?", "licen[cs]ed under (?:the )?mit"), ()),
    ("x11", "x11", ("x11 licen[cs]e",), ()),
    ("bsd", "bsd", ("bsd licen[cs]e", "bsd style licen[cs]e", "licen[cs]ed under (?:the )?bsd"), ()),
    ("bsd-0-clause", "0bsd", ("0bsd",), ()),
)
#: Clauses by number: label, digits or words.
BSD_CLAUSES = (("bsd-1-clause", "1|one"), ("bsd-2-clause", "2|two|simplified"), ("bsd-3-clause", "3|three|new|revised|modified"), ("bsd-4-clause", "4|four|original|old"))
CC_PARTS = (("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative)?s(?: works)?"), ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?"))
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Sentences of license texts and notices: label, keyword, pattern, confidence.
#: Two hold a gap for a name (.{1,80}?, .{1,60}?): these signatures are defined with names of up to that length.
PASSAGES = (
    ("mit", "granted", "permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("mit", "warranty", "the software is provided as is without warranty of any kind express or implied", 0.7),
    ("isc", "granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.95),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 0.95),
    ("bsd-3-clause", "endorse", "neither the name of .{1,80}? may be used to endorse or promote products", 0.9),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the licen[cs]e", 0.8),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 0.95),
    ("lgpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e", 0.95),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public licen[cs]e v ?2 0", 0.95),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 0.95),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 0.9),
    ("bsl-1.0", "boost", "distributed under the boost software licen[cs]e version 1 0", 0.95),
    ("wtfpl", "fuck", "do what the fuck you want to public licen[cs]e", 0.95),
    ("public-domain", "domain", "(?:in|into|to) the public domain", 0.7),
    ("public-domain", "domain", "public domain dedication", 0.8),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", 0.9),
    ("cc", "commons", "creative commons(?: licen[cs]e)?", 0.5),
    ("proprietary", "reserved", "all rights reserved", 0.5),
    ("proprietary", "confidential", "proprietary and confidential", 0.7),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|distribution) .{1,60}? is (?:strictly )?prohibited", 0.8),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", 0.4),
    ("eula", "end", "end user licen[cs]e agreement", 0.7),
    ("open-source", "open", "open source licen[cs]e", 0.3),
    ("spdx", "spdx", "spdx licen[cs]e identifier", 0.5),
)
#: The stems of which one stands in every text that any rule can match, letter case ignored.
STEMS = (
    *"licen gpl apache spdx copyright public creative cc0 rights permission warrant redistribut unencumbered misrepresented endorse proprietary unauthori wtfpl gfdl 0bsd beer mulan cecill eupl cddl mpl epl ofl bsd perl".split(),
    "compliance",
)
#: The same for the Creative Commons' short names, whose two words any break characters may part.
SHORT = rf"cc{BREAK}by"


def _version(words: str) -> str:
    """Words of a version: 2.0 stands as 2, 2 0, v2 or v2 0; other zeros don't fall away."""
    major, minor = words.split(".")
    return rf"v?{major}(?: {minor})?(?![0-9])(?! [1-9](?: |$))" if minor == "0" else rf"v?{major} {minor}"


def rules() -> list[Rule]:
    """All rules, highest priority first; equal priorities in the order given."""
    out = [Rule(label, key, phrase, 10, 0.8, True) for label, key, phrase in BASE]
    for stem, key, names, versions in FAMILIES:
        name = "(?:" + "|".join(names) + ")"
        out.append(Rule(stem, key, name, 10, 0.6))
        for v in versions:
            out.append(Rule(f"{stem}-{v}", key, f"{name}(?: version| ver)? {_version(v)}", 30, 0.9))
            if stem in ("gpl", "lgpl", "agpl"):
                out.append(Rule(f"{stem}-{v}-or-later", key, f"{name}(?: version| ver)? {_version(v)} (?:of the licen[cs]e )?(?:or (?:at your option )?)?(?:any )?(?:later|newer|above)", 40, 0.95))
                out.append(Rule(f"{stem}-{v}-only", key, f"{name}(?: version| ver)? {_version(v)} only", 40, 0.95))
            out.append(Rule(f"{stem}-{v}", "spdx", f"spdx licen[cs]e identifier {stem.replace('-', ' ')} {v.replace('.', ' ')}", 50, 1.0))
        if not versions:
            out.append(Rule(stem, "spdx", f"spdx licen[cs]e identifier {stem.replace('-', ' ')}", 50, 1.0))
    for label, number in BSD_CLAUSES:
        out.append(Rule(label, "bsd", f"(?:{number})(?: clause)? bsd(?: licen[cs]e)?", 30, 0.9))
        out.append(Rule(label, "bsd", f"bsd (?:{number}) clause(?: licen[cs]e)?", 30, 0.9))
    for part, name in CC_PARTS:
        spdx = part.replace("-", " ")
        out.append(Rule(f"cc-{part}", "cc", f"cc {spdx}", 20, 0.7))
        out.append(Rule(f"cc-{part}", "commons", f"creative commons {name}(?: licen[cs]e)?", 20, 0.7))
        for v in CC_VERSIONS:
            words = v.replace(".", " ")
            out.append(Rule(f"cc-{part}-{v}", "cc", f"cc {spdx} {words}", 30, 0.95))
            out.append(Rule(f"cc-{part}-{v}", "commons", f"creative commons {name} (?:licen[cs]e )?(?:version )?{words}", 30, 0.95))
    out += [Rule(label, key, pattern, 25, confidence) for label, key, pattern, confidence in PASSAGES]
    return sorted(out, key=lambda r: -r.priority)


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


#: Marks the starts of a rule's places; no word contains it.
_MARK = "\x01"


def _places(words: Column, rule: Column) -> Column:
    """Where a rule's pattern stands in ' w0 w1 ... ': array of start and end, in words.

    Every place is marked in the text, whose words are then counted once: the
    work is in proportion to the text, however many places there are.
    """
    none = F.array().cast("array<struct<start:int,end:int>>")
    pattern = F.concat(F.lit("(?i)(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
    marked = F.split(F.regexp_replace(words, pattern, F.lit(f"{_MARK}$0")), " ", -1)
    starts = F.filter(F.transform(marked, lambda w, i: F.when(w.startswith(_MARK), i - 1)), lambda i: i.isNotNull())
    sizes = F.transform(F.regexp_extract_all(words, pattern, F.lit(0)), lambda m: (_spaces(m) + 1).cast("int"))
    pairs = F.zip_with(starts, sizes, lambda a, n: F.struct(a.cast("int").alias("start"), (a + n).cast("int").alias("end")))
    return F.when(F.rlike(words, pattern), pairs).otherwise(none)


def _sweep(hits: Column, state: str, step) -> Column:
    """The places kept by one pass over hits in order, in runs of about the root of their number.

    A run starts from the furthest end before it, so that no array grows by
    copying beyond a run's length.
    """
    n = F.size(hits)
    length = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))

    def run(i: Column) -> Column:
        before = F.coalesce(F.array_max(F.transform(F.slice(hits, F.lit(1), i * length), lambda h: -h["until"])), F.lit(-1))
        first = F.struct(before.alias("until"), F.array().alias("kept")).cast(state)
        return F.aggregate(F.slice(hits, i * length + 1, length), first, lambda s, h: step(s, h).cast(state), lambda s: s["kept"])

    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(n / length).cast("int") - 1), run)))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", ruleset: list[Rule] | None = None) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    detections: the places that stay (label, start, n_words, priority).
    Null and empty texts have no words and no labels (empty strings), score 0.
    Rows are independent of each other: repeated rows give equal results, an
    empty table an empty one; ids of any type go through, other columns of
    docs, whatever their names, don't. Texts are scanned whole, in time nearly
    in proportion to their length. Equal places: the higher priority stays,
    then the first label by name.
    """
    ruleset = rules() if ruleset is None else ruleset
    kind = "array<struct<label:string,keyword:string,pattern:string,priority:int,confidence:double,base:boolean>>"
    table = F.from_json(F.lit(json.dumps([r._asdict() for r in ruleset])), kind)  # folded into one literal
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in ruleset})])
    whole = F.coalesce(F.col("__text"), F.lit(""))
    parted = docs.select(F.col(f"`{id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    parted = parted.select("__id", F.array_remove(F.split(whole, BREAK), "").alias("__words"), F.lower(whole).alias("__low"))
    gate = functools.reduce(operator.or_, [F.contains(F.col("__low"), F.lit(s)) for s in STEMS]) | F.rlike(F.col("__low"), F.lit(SHORT))
    parted = parted.withColumn("__gate", gate).drop("__low")
    gated = parted.select("__id", F.size("__words").cast("long").alias("n_words"), F.when(F.col("__gate"), F.concat(F.lit(" "), F.array_join("__words", " "), F.lit(" "))).alias("__all"))
    gated = gated.withColumn("__low", F.lower("__all"))
    own = gated.withColumn("__keys", F.when(F.col("__low").isNotNull(), F.filter(keywords, lambda k: F.contains(F.col("__low"), F.concat(F.lit(" "), k, F.lit(" ")))))).drop("__low")
    chosen = own.withColumn("__rules", F.when(F.size("__keys") > 0, F.filter(table, lambda r: F.array_contains(F.col("__keys"), r["keyword"]))))
    hit = lambda r: F.transform(_places(F.col("__all"), r), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence"), r["base"].alias("base")))
    found = chosen.withColumn("__hits", F.flatten(F.transform("__rules", hit))).drop("__rules", "__keys", "__all")
    # By start, then longest, then highest priority: a place stays if it ends after all before it.
    order = F.transform("__hits", lambda h: F.struct(h["start"].alias("start"), (-h["end"]).alias("until"), (-h["priority"]).alias("low"), h["label"].alias("label"), h["confidence"].alias("confidence"), h["base"].alias("base")))
    ordered = found.withColumn("__order", F.sort_array(order)).drop("__hits")
    kept = "array<struct<label:string,start:int,n_words:int,priority:int,confidence:double>>"
    state = f"struct<until:int,kept:{kept}>"
    step = lambda s, h: F.when(-h["until"] <= s["until"], s).otherwise(
        F.struct((-h["until"]).alias("until"), F.concat(s["kept"], F.array(F.struct(h["label"].alias("label"), h["start"].alias("start"), (-h["until"] - h["start"]).alias("n_words"), (-h["low"]).alias("priority"), h["confidence"].alias("confidence")))).alias("kept"))
    )
    swept = ordered.withColumn("detections", F.coalesce(_sweep(F.col("__order"), state, step), F.array().cast(kept)))
    base = swept.withColumn("__base", F.coalesce(F.filter("__order", lambda h: h["base"]), F.filter("__order", lambda h: F.lit(False)))).drop("__order")
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    none = F.array().cast("array<string>")
    base_labels = F.coalesce(F.col("__base.label"), none)
    return base.select(
        F.col("__id").alias(id),
        "n_words",
        F.when(F.col("__base").isNull(), F.lit(0)).otherwise(F.size("__base")).cast("long").alias("n_base"),
        F.array_min("__base.start").cast("long").alias("first_word"),
        F.array_max("__base.start").cast("long").alias("last_word"),
        names(base_labels).alias("base_labels"),
        names(F.concat(base_labels, F.col("detections.label"))).alias("labels"),
        F.coalesce(F.array_max("detections.confidence"), F.lit(0.0)).alias("score"),
        "detections",
    )
