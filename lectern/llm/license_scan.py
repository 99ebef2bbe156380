"""License scan: ordered signature rules over a text's words.

A text's words, lower-cased and joined by single spaces, are searched by hundreds of regular expressions. A rule
runs only where its keyword occurs, and no rule runs where one expression over the raw text, derived from the rules
and with runs of separators for blanks, finds no place for any of them. A detection that lies inside another of the same or a higher priority is suppressed. Base
phrases are found by the same words and always stay.

Only DataFrame functions run on the rows; the rules are a literal array of a fixed size.

Defined cases: null or empty text has no words, no labels and score 0; texts are read whole; overlapping places
of a phrase all count; equal detections count once; repeated rows are scanned each; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import only

#: The operator's own phrases, and those of the contract of op4_license_scan.
PHRASES = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
CONTRACT = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
SEPARATOR = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"

#: label, keyword, name, identifier, place on the web; words separated by one space, each an expression.
FAMILIES = [
    ("mit", "mit", "mit licen[cs]e", "mit", "opensource org licenses mit"),
    ("mit-0", "mit", "mit no attribution", "mit 0", "opensource org licenses? mit 0"),
    ("x11", "x11", "x11 licen[cs]e", "x11", "xfree86 org legal licenses"),
    ("isc", "isc", "isc licen[cs]e", "isc", "opensource org licenses isc"),
    ("apache-1.1", "apache", "apache (software )?licen[cs]e (version )?1 1", "apache 1 1", "apache org licenses license 1 1"),
    ("apache-2", "apache", "apache (software )?licen[cs]e (version |v )?2( 0)?", "apache 2 0", "apache org licenses license 2 0"),
    ("bsd-2-clause", "bsd", "(simplified|freebsd|2 clause|two clause) bsd( licen[cs]e)?", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(new|modified|revised|3 clause|three clause) bsd( licen[cs]e)?", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(original|4 clause|four clause) bsd( licen[cs]e)?", "bsd 4 clause", "spdx org licenses bsd 4 clause"),
    ("0bsd", "bsd", "(zero clause|0 clause) bsd( licen[cs]e)?", "0bsd", "opensource org licenses 0bsd"),
    ("gpl-1", "public license", "(gnu )?general public license (version |v )?1( 0)?", "gpl 1 0( only| or later)?", "gnu org licenses gpl 1 0"),
    ("gpl-2", "public license", "(gnu )?general public license (version |v )?2( 0)?", "gpl 2 0( only| or later)?", "gnu org licenses gpl 2 0"),
    ("gpl-3", "public license", "(gnu )?general public license (version |v )?3( 0)?", "gpl 3 0( only| or later)?", "gnu org licenses gpl 3 0"),
    ("lgpl-2", "public license", "(gnu )?library general public license (version |v )?2( 0)?", "lgpl 2 0( only| or later)?", "gnu org licenses lgpl 2 0"),
    ("lgpl-2.1", "public license", "(gnu )?lesser general public license (version |v )?2 1", "lgpl 2 1( only| or later)?", "gnu org licenses lgpl 2 1"),
    ("lgpl-3", "public license", "(gnu )?lesser general public license (version |v )?3( 0)?", "lgpl 3 0( only| or later)?", "gnu org licenses lgpl 3 0"),
    ("agpl-3", "public license", "(gnu )?affero general public license (version |v )?3( 0)?", "agpl 3 0( only| or later)?", "gnu org licenses agpl 3 0"),
    ("gfdl-1.2", "documentation license", "(gnu )?free documentation license (version |v )?1 2", "gfdl 1 2( only| or later)?", "gnu org licenses fdl 1 2"),
    ("gfdl-1.3", "documentation license", "(gnu )?free documentation license (version |v )?1 3", "gfdl 1 3( only| or later)?", "gnu org licenses fdl 1 3"),
    ("mpl-1.1", "mozilla", "mozilla public license (version |v )?1 1", "mpl 1 1", "mozilla org mpl 1 1"),
    ("mpl-2", "mozilla", "mozilla public license (version |v )?2( 0)?", "mpl 2 0", "mozilla org mpl 2 0"),
    ("epl-1", "eclipse", "eclipse public license (version |v )?1( 0)?", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2", "eclipse", "eclipse public license (version |v )?2( 0)?", "epl 2 0", "eclipse org legal epl 2 0"),
    ("cddl-1", "common development", "common development and distribution license( (version |v )?1( 0)?)?", "cddl 1 0", "opensource org licenses cddl 1( 0)?"),
    ("cpl-1", "common public", "common public license( (version |v )?1( 0)?)?", "cpl 1 0", "opensource org licenses cpl 1 0"),
    ("eupl-1.1", "european union", "european union public licen[cs]e (version |v )?1 1", "eupl 1 1", "eupl eu 1 1"),
    ("eupl-1.2", "european union", "european union public licen[cs]e (version |v )?1 2", "eupl 1 2", "eupl eu 1 2"),
    ("artistic-1", "artistic", "artistic license (version |v )?1( 0)?", "artistic 1 0", "opensource org licenses artistic license 1 0"),
    ("artistic-2", "artistic", "artistic license (version |v )?2( 0)?", "artistic 2 0", "opensource org licenses artistic license 2 0"),
    ("boost-1", "boost", "boost software license( (version |v )?1( 0)?)?", "bsl 1 0", "boost org license 1 0"),
    ("zlib", "zlib", "zlib( libpng)? licen[cs]e", "zlib", "zlib net zlib license"),
    ("libpng", "libpng", "libpng licen[cs]e", "libpng", "libpng org pub png src libpng license"),
    ("unlicense", "unlicense", "the unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "what the", "do what the f\\w+ you want to public licen[cs]e", "wtfpl", "wtfpl net"),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "postgresql", "opensource org licenses postgresql"),
    ("python-2", "python", "python software foundation licen[cs]e( (version |v )?2)?", "psf 2 0", "docs python org 3 license"),
    ("php-3", "php", "php licen[cs]e (version |v )?3( 0 1?)?", "php 3 0 1?", "php net license"),
    ("ruby", "ruby", "ruby s licen[cs]e", "ruby", "ruby lang org en about license"),
    ("openssl", "openssl", "openssl licen[cs]e", "openssl", "openssl org source license"),
    ("ncsa", "ncsa", "(university of illinois )?ncsa open source licen[cs]e", "ncsa", "opensource org licenses ncsa"),
    ("afl-3", "academic free", "academic free license( (version |v )?3( 0)?)?", "afl 3 0", "opensource org licenses afl 3 0"),
    ("osl-3", "open software", "open software license( (version |v )?3( 0)?)?", "osl 3 0", "opensource org licenses osl 3 0"),
    ("ms-pl", "microsoft public", "microsoft public licen[cs]e", "ms pl", "opensource org licenses ms pl"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[cs]e", "ms rl", "opensource org licenses ms rl"),
    ("ofl-1.1", "font license", "(sil )?open font license( (version |v )?1 1)?", "ofl 1 1", "scripts sil org ofl"),
    ("qpl-1", "q public", "q public license( (version |v )?1( 0)?)?", "qpl 1 0", "opensource org licenses qtpl"),
    ("sleepycat", "sleepycat", "sleepycat licen[cs]e", "sleepycat", "opensource org licenses sleepycat"),
    ("vim", "vim", "vim licen[cs]e", "vim", "vimhelp org uganda"),
    ("w3c", "w3c", "w3c software (notice and )?licen[cs]e", "w3c", "w3 org consortium legal 2015 copyright software and document"),
    ("json", "json", "json licen[cs]e", "json", "json org license"),
    ("icu", "icu", "icu licen[cs]e", "icu", "unicode org copyright"),
    ("unicode", "unicode", "unicode (inc )?licen[cs]e agreement", "unicode dfs 2016", "unicode org license"),
    ("upl-1", "universal permissive", "universal permissive license( (version |v )?1( 0)?)?", "upl 1 0", "oss oracle com licenses upl"),
    ("elastic-2", "elastic", "elastic license( (version |v )?2( 0)?)?", "elastic 2 0", "elastic co licensing elastic license"),
    ("sspl-1", "server side", "server side public license( (version |v )?1)?", "sspl 1 0", "mongodb com licensing server side public license"),
    ("busl-1.1", "business source", "business source license( (version |v )?1 1)?", "busl 1 1", "mariadb com bsl11"),
    ("odbl-1", "database license", "open (data commons )?(open )?database license( (version |v )?1( 0)?)?", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("pddl-1", "public domain dedication", "public domain dedication and licen[cs]e", "pddl 1 0", "opendatacommons org licenses pddl"),
    ("odc-by", "open data commons", "open data commons attribution licen[cs]e", "odc by 1 0", "opendatacommons org licenses by"),
    ("cc0", "cc0", "(creative commons )?cc0( 1 0)?( universal)?", "cc0 1 0", "creativecommons org publicdomain zero 1 0"),
    ("cc-pdm", "public domain mark", "public domain mark( 1 0)?", "cc pdddc", "creativecommons org publicdomain mark 1 0"),
]
#: The elements of a Creative Commons licence, by label, as its short and its long form.
COMMONS = [
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(ative)?s?( works)?"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(ative)?s?( works)?"),
]
#: label, priority, keyword, sentence or mention: whole notices, then bare names without a version.
NOTICES = [
    ("mit", 3, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 3, "copies or substantial", "this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 3, "provided as is", "the software is provided as is without warranty of any kind express or implied"),
    ("isc", 3, "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-3-clause", 3, "endorse or promote", "neither the name of (the )?[^ ]+( [^ ]+){0,12} nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-2-clause", 2, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", 2, "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd-2-clause", 2, "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-4-clause", 3, "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2", 3, "apache", "licensed under the apache licen[cs]e version 2( 0)?( the license)?"),
    ("apache-2", 3, "compliance with the license", "you may not use this file except in compliance with the license"),
    ("gpl", 2, "free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2", 3, "either version 2", "either version 2 of the license or at your option any later version"),
    ("gpl-3", 3, "either version 3", "either version 3 of the license or at your option any later version"),
    ("lgpl", 2, "free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license"),
    ("gpl", 2, "gnu general public", "you should have received a copy of the gnu general public license"),
    ("mpl-2", 3, "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", 3, "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("boost-1", 3, "boost", "distributed under the boost software license version 1 0"),
    ("zlib", 3, "origin of this software", "the origin of this software must not be misrepresented"),
    ("unlicense", 3, "public domain", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", 3, "what the", "you just do what the f\\w+ you want to"),
    ("cc0", 3, "waived all copyright", "has waived all copyright and related or neighboring rights"),
    ("public-domain", 2, "public domain", "(released|placed|dedicated|is) (in|into|to) the public domain"),
    ("public-domain", 1, "public domain", "public domain"),
    ("proprietary", 3, "all rights reserved", "all rights reserved"),
    ("proprietary", 2, "proprietary", "proprietary and confidential"),
    ("proprietary", 2, "unauthorized", "unauthorized (copying|use|distribution|reproduction) [^ ]+( [^ ]+){0,8} (is )?(strictly )?prohibited"),
    ("ofl-1.1", 3, "font software", "this font software is licensed under the sil open font license version 1 1"),
    ("json", 3, "good not evil", "shall be used for good not evil"),
    ("beerware", 3, "beer", "(you can|they can) buy me a beer in return"),
    ("beerware", 2, "beer", "beer ?ware licen[cs]e"),
    ("gpl", 1, "gpl", "gpl"),
    ("gpl-2", 2, "gpl", "gpl ?v?2( 0)?"),
    ("gpl-3", 2, "gpl", "gpl ?v?3( 0)?"),
    ("lgpl", 1, "lgpl", "lgpl"),
    ("lgpl-3", 2, "lgpl", "lgpl ?v?3( 0)?"),
    ("agpl", 1, "agpl", "agpl"),
    ("agpl-3", 2, "agpl", "agpl ?v?3( 0)?"),
    ("gpl", 1, "general public", "(gnu )?general public license"),
    ("lgpl", 1, "general public", "(gnu )?(lesser|library) general public license"),
    ("agpl", 1, "affero", "(gnu )?affero general public license"),
    ("gfdl", 1, "documentation license", "(gnu )?free documentation license"),
    ("mpl", 1, "mozilla", "mozilla public license"),
    ("epl", 1, "eclipse", "eclipse public license"),
    ("apache", 1, "apache", "apache licen[cs]e"),
    ("bsd", 1, "bsd", "bsd licen[cs]e"),
    ("artistic", 1, "artistic", "artistic licen[cs]e"),
    ("cc", 1, "creative commons", "creative commons"),
    ("eupl", 1, "european union", "european union public licen[cs]e"),
]

def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, expression) in order."""
    out = list(NOTICES)
    for label, keyword, name, spdx, web in FAMILIES:
        out += [(label, 3, "spdx", f"spdx license identifier {spdx}"), (label, 3, web.split(" ")[0], web), (label, 2, keyword, name)]
        out.append((label, 3, keyword, f"(licensed|released|distributed|available) under (the terms of )?(the )?{name}"))
    for label, short, long in COMMONS:
        version = "( (version )?[1234] [05])?( international| unported| generic)?"
        out += [
            (label, 2, "cc " + short.split(" ")[0], f"cc {short}{version}"),
            (label, 2, "creative commons", f"creative commons {long}( licen[cs]e)?{version}"),
            (label, 3, "creativecommons", f"creativecommons org licenses {short}( [1234] [05])?"),
            (label, 3, "spdx", f"spdx license identifier cc {short}( [1234] [05])?"),
            (label, 3, "cc " + short.split(" ")[0], f"licensed under (a |the )?(creative commons )?cc {short}{version}"),
        ]
    return out


def phrases_of(expression: str) -> set[str]:
    """All texts an expression can begin with: alternatives and options written out, up to its first open word."""
    if (cut := min((i for x in ("[^", "\\w") if (i := expression.find(x)) >= 0), default=-1)) >= 0:
        expression = expression[:cut].rpartition(" ")[0]

    def choice(at: int) -> tuple[set[str], int]:
        out, parts = set(), []
        while at < len(expression) and expression[at] != ")":
            c = expression[at]
            if c == "|":
                out |= {"".join(x) for x in product(*parts)}
                parts, at = [], at + 1
                continue
            if c == "(":
                one, at = choice(at + 1)
            elif c == "[":
                end = expression.index("]", at)
                one, at = set(expression[at + 1 : end]), end
            else:
                one = {c}
            at += 1
            if expression[at : at + 1] == "?":
                one, at = one | {""}, at + 1
            parts.append(one)
        return out | {"".join(x) for x in product(*parts)}, at

    return {" ".join(x.split()) for x in choice(0)[0]}


@lru_cache(maxsize=8)
def gate(phrases: tuple[str, ...] = tuple(PHRASES)) -> str:
    """What a text must hold for any rule or base phrase to match: the first words of each, as one prefix tree.
    Phrases that hold another at a word are left out, for where they stand the other stands."""
    tree: dict = {}

    def holds(words: list[str]) -> bool:
        for first in range(len(words)):
            at = tree
            for w in words[first:]:
                at = at.get(w)
                if at is None:
                    break
                if not at:
                    return True
        return False

    every = set(phrases).union(*(phrases_of(x) for *_, x in rules()))
    for p in sorted(every, key=lambda p: (len(p.split()), p)):
        words, at = p.split(), tree
        if not holds(words):
            for w in words:
                at = at.setdefault(w, {})

    def letters(nodes: dict) -> dict:
        """The words of one level as a tree of letters; "" ends a word and holds the level below."""
        out: dict = {}
        for word, below in nodes.items():
            at = out
            for c in word:
                at = at.setdefault(c, {})
            at[""] = below
        return out

    def written(at: dict) -> str:
        forms = [c + written(x) for c, x in sorted(at.items()) if c]
        if "" in at:
            forms.append(f"[{SEPARATOR}]++" + written(letters(at[""])) if at[""] else f"(?![^{SEPARATOR}])")
        return forms[0] if len(forms) == 1 else f"(?:{'|'.join(forms)})"

    return f"(?i)(?<![^{SEPARATOR}]){written(letters(tree))}"


def _rules_column() -> Column:
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"struct({quote(n)} as label, {p} as priority, {quote(k)} as keyword, {quote(f' {x}(?= )')} as pattern)" for n, p, k, x in rules())
    return F.expr(f"array({rows})")


def _found(text: Column, rule: Column) -> Column:
    """struct(first, end, label, priority) of every place of a rule's expression in text."""
    parts = F.struct(F.split(text, rule["pattern"], -1).alias("gaps"), F.regexp_extract_all(text, rule["pattern"], F.lit(0)).alias("hits"))
    empty = F.expr("cast(array() as array<struct<first:int,end:int>>)")

    def placed(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

        def step(s: Column, x: Column) -> Column:
            first = s["at"] + F.length(x["gap"])
            end = first + F.length(x["hit"])
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(first.alias("first"), end.alias("end")))).alias("out"))

        pairs = F.zip_with(F.slice(p["gaps"], 1, F.greatest(F.size(p["hits"]), F.lit(0))), p["hits"], lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return F.aggregate(pairs, start, step, lambda s: s["out"])

    at = F.flatten(F.transform(F.array(parts), placed))
    return F.transform(at, lambda x: F.struct(x["first"], (-x["end"]).alias("back"), (-rule["priority"]).alias("low"), rule["label"].alias("label")))


def _surviving(hits: Column) -> Column:
    """Of struct(first, back, low, label), the (label, priority) not inside one of the same or a higher priority.
    In order of (first, end downwards, priority downwards) an interval stands after all that contain it."""
    start = F.struct(*[F.lit(-1).alias(f"m{p}") for p in (1, 2, 3)], F.expr("cast(array() as array<struct<label:string,priority:int>>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        end, p = -x["back"], -x["low"]
        reach = F.when(p == 3, s["m3"]).when(p == 2, F.greatest(s["m2"], s["m3"])).otherwise(F.greatest(s["m1"], s["m2"], s["m3"]))
        one = F.array(F.struct(x["label"].alias("label"), p.alias("priority")))
        out = F.when((end <= reach) | F.array_contains(s["out"], one[0]), s["out"]).otherwise(F.concat(s["out"], one))
        return F.struct(*[F.when(p == q, F.greatest(s[f"m{q}"], end)).otherwise(s[f"m{q}"]).alias(f"m{q}") for q in (1, 2, 3)], out.alias("out"))

    return F.aggregate(F.array_sort(hits), start, step, lambda s: s["out"])


def scan(docs: DataFrame, key: str = "doc_id", phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of every row. phrases:
    labels by base phrase, lower-case words joined by single spaces."""
    text = F.coalesce("text", F.lit(""))
    d = only(docs, key, "text").select(key, text.alias("_text"))
    d = d.withColumn("n_words", F.size(F.array_remove(F.split("_text", f"[{SEPARATOR}]+"), "")).cast("long"))
    d = d.withColumn("_gate", F.col("_text").rlike(gate(tuple(phrases))))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.array_remove(F.split(F.translate("_text", upper, lower), f"[{SEPARATOR}]+"), "")
    d = d.withColumn("_words", F.when(F.col("_gate"), F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))).drop("_text")
    rule = _rules_column()
    hits = F.flatten(F.transform(F.filter(rule, lambda r: F.contains(F.col("_words"), r["keyword"])), lambda r: _found(F.col("_words"), r)))
    # A place takes its first word alone, so that places that overlap all count.
    each = {p: " " + re.sub("(?= )|$", "(?=", p, count=1) + " )" for p in phrases}
    either = f"(?:{'|'.join(each.values())})"
    blanks = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    counts = {p: F.size(F.split("_words", x, -1)) - 1 for p, x in each.items()}
    d = d.withColumn("_base", F.when(F.col("_words").isNotNull(), F.array(*[F.struct(F.lit(phrases[p]).alias("label"), n.alias("n")) for p, n in counts.items()])))
    d = d.withColumn("_n", F.coalesce(F.aggregate("_base", F.lit(0), lambda a, x: a + x["n"]), F.lit(0)))
    d = d.withColumn("detections", F.when(F.col("_words").isNotNull(), _surviving(hits)))
    base = F.coalesce(F.transform(F.filter("_base", lambda x: x["n"] > 0), lambda x: x["label"]), F.array().cast("array<string>"))
    more = F.coalesce(F.transform("detections", lambda x: x["label"]), F.array().cast("array<string>"))
    first = F.when(F.col("_n") > 0, blanks(F.split("_words", either, 2)[0]))
    last = F.when(F.col("_n") > 0, blanks(F.regexp_extract("_words", f"(?s)^(.*){either}", 1)))
    weight = F.array_max(F.transform("detections", lambda x: F.element_at(F.array(F.lit(0.5), F.lit(0.8), F.lit(0.95)), x["priority"])))
    return d.select(
        key,
        "n_words",
        F.col("_n").cast("long").alias("n_base"),
        first.cast("long").alias("first_word"),
        last.cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.greatest(F.when(F.col("_n") > 0, F.lit(0.9)).otherwise(F.lit(0.0)), F.coalesce(weight, F.lit(0.0))).alias("score"),
        "detections",
    )
