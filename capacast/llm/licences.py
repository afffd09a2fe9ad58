"""Licence recognition by sentence rules, in DataFrame functions only."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of well-known licences in lower case without punctuation, by identifier.  Where a sentence has a
# slot (holder, program), it stands here as ``SLOTS`` leaves it.
SENTENCES: dict[str, list[str]] = {
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and "
                  "associated documentation files the software to deal in the software without restriction including "
                  "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                  "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                  "the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or "
                   "substantial portions of the software"],
    "mit-as-is": ["the software is provided as is without warranty of any kind express or implied including but not "
                  "limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "apache2-header": ["licensed under the apache license version 2 0 the license"],
    "apache2-compliance": ["you may not use this file except in compliance with the license"],
    "apache2-as-is": ["unless required by applicable law or agreed to in writing software distributed under the license "
                      "is distributed on an as is basis without warranties or conditions of any kind either express or "
                      "implied"],
    "gpl-free": ["this program is free software"],
    "gpl3-terms": ["you can redistribute it and or modify it under the terms of the gnu general public license as "
                   "published by the free software foundation either version 3 of the license or at your option any "
                   "later version"],
    "gpl-warranty": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted "
                  "provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and "
                   "the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions "
                   "and the following disclaimer in the documentation and or other materials provided with the "
                   "distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                    "or promote products derived from this software without specific prior written permission"],
    "isc-grant": ["permission to use copy modify and distribute this software for any purpose with or without fee is hereby "
                  "granted provided that the above copyright notice and this permission notice appear in all copies"],
    "0bsd-grant": ["permission to use copy modify and distribute this software for any purpose with or without fee is "
                   "hereby granted"],
    "zlib-as-is": ["this software is provided as is without any express or implied warranty"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications "
                   "and to alter it and redistribute it freely subject to the following restrictions"],
    "unlicense-domain": ["this is free and unencumbered software released into the public domain"],
    "unlicense-grant": ["anyone is free to copy modify publish use compile sell or distribute this software either in "
                        "source code form or as a compiled binary for any purpose commercial or non commercial and by any "
                        "means"],
    "cc0-waiver": ["waived all copyright and related or neighboring rights"],
    "bsl-grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the "
                  "software and accompanying documentation covered by this license the software to use reproduce display "
                  "distribute execute and transmit the software and to prepare derivative works of the software and to "
                  "permit third parties to whom the software is furnished to do so all subject to the following"],
    "mpl2-copy": ["if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
                  "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"],
    "all-rights": ["all rights reserved"],
}

# Names of licences as ``NAMING`` leaves them.  GNU and Creative Commons names follow by rule.
NAMES: dict[str, list[str]] = {
    "MIT": ["mit", "mit x11", "x11 mit", "expat", "expat mit", "mit expat"],
    "Apache-2.0": ["apache 2 0", "apache 2", "apache software 2 0", "apache software foundation 2 0", "asl 2 0"],
    "BSD-3-Clause": ["bsd 3 clause", "3 clause bsd", "three clause bsd", "new bsd", "modified bsd", "revised bsd"],
    "BSD-2-Clause": ["bsd 2 clause", "2 clause bsd", "two clause bsd", "simplified bsd", "freebsd"],
    "BSD": ["bsd", "bsd style"],
    "0BSD": ["0bsd", "zero clause bsd", "bsd zero clause"],
    "ISC": ["isc"],
    "Zlib": ["zlib", "zlib libpng"],
    "Unlicense": ["unlicense"],
    "WTFPL": ["wtfpl"],
    "BSL-1.0": ["bsl 1 0", "boost software 1 0", "boost 1 0", "boost software"],
    "Artistic-2.0": ["artistic 2 0"],
    "MPL-1.1": ["mpl 1 1", "mozilla public 1 1"],
    "MPL-2.0": ["mpl 2 0", "mpl 2", "mozilla public 2 0", "mozilla public 2"],
    "EPL-1.0": ["epl 1 0", "eclipse public 1 0"],
    "EPL-2.0": ["epl 2 0", "epl 2", "eclipse public 2 0", "eclipse public 2"],
    "CC0-1.0": ["cc0", "cc0 1 0", "cc zero", "cc zero 1 0", "cc0 1 0 universal"],
    **{f"CC-{kind}-{version}": [f"cc {kind} {version}".lower().replace("-", " ").replace(".", " ")]
       for kind in ("BY-NC-SA", "BY-NC-ND", "BY-NC", "BY-SA", "BY-ND", "BY") for version in ("4.0", "3.0", "2.5", "2.0")},
}
for _family, _version in (("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")):
    for _form, _word in (("-or-later", " later"), ("-only", " only"), ("", "")):
        _name = f"{_family} {_version}".lower().replace(".", " ")
        NAMES[f"{_family}-{_version}{_form}"] = sorted({_name + _word, _name.removesuffix(" 0") + _word})

# Patterns and what takes their place, in order; they mean the same to Java and to RE2.
# On the lower-case text, before it is cut into sentences:
MARKS = [
    (r"spdx-license-identifier:[ \t]*([^\n]*)", "\n\nlicensed under \\1\n\n"),
    (r"gpl[-v ]*([0-9.]+)\+", r"gpl \1 or later"),
    (r"([^a-z])v\.[ ]*([0-9])", r"\1version \2"),
    (r"foundation[;:,][^a-z0-9]+either", "foundation either"),
]
# On a sentence of words, to fill its slots alike:
SLOTS = [
    (r"^copyright .*all rights reserved$", "all rights reserved"),
    (r"^(?:[a-z0-9]+ ){1,4}is distributed in the hope that ", "this program is distributed in the hope that "),
    (r"^(?:[a-z0-9]+ ){1,4}is free software$", "this program is free software"),
    (r"^to the extent possible under law .*waived (all copyright and related or neighboring rights) .*$", r"waived \1"),
    (r"^(?:neither the name of .* )?nor the names of (?:its|other|any) contributors ",
     "neither the name of the copyright holder nor the names of its contributors "),
    (r"^permission to use copy modify and or distribute ", "permission to use copy modify and distribute "),
]
SLOTTED = "^(?:copyright|to the extent|neither|nor|permission to) |is distributed in the hope|is free software$"
# A sentence that puts something under a licence; what follows is the licence's name.
REFERENCE = (r"^(?:(?:[a-z0-9]+ ){1,8}(?:is|are|be) (?:also |hereby |now |freely |dual |made )?)?"
             r"(?:(?:released|licensed|licenced|distributed|published|provided|available|made available|offered|covered|"
             r"shared|used) (?:only )?under|(?:covered|governed) by|subject to|(?:(?:[a-z0-9]+ ){1,4}is free software )?you (?:can|may) "
             r"redistribute it and or modify it under) ")
# On such a sentence, until the name is left:
NAMING = [
    (REFERENCE, ""),
    (r"^(?:the )?(?:terms of )?(?:the )?version ([0-9][0-9 ]*) of (?:the )?(.*?)( or (?:at your option )?(?:any )?(?:later|newer).*)?$",
     r"\2 \1\3"),
    (r" (?:see|please see|refer to|for|that|which|found in|as found|as described|as specified|the full text|a copy|https?|"
     r"www) .*$", ""),
    (r"as published by the free software foundation|of the license", " "),
    (r" or (?:at your option )?(?:any )?(?:later|newer)\b", " later"),
    (r"\b(?:the|a|an|either|both|licen[sc]es?|terms|and conditions|version|ver|v|international|unported|generic|agreement|"
     r"public domain dedication|file|gnu|of)\b", " "),
    (r"general public", "gpl"), (r"creative commons", "cc"), (r"attribution", "by"), (r"non ?commercial", "nc"),
    (r"share ?alike", "sa"), (r"no ?deriv(?:ative)?s?(?: works)?\b", "nd"),
    (r"\b(?:cc )?cc ?0\b", "cc0"),
    (r"\bv([0-9])", r"\1"), (r"gpl ?v? ?([0-9])", r"gpl \1"), (r" +", " "), (r"(?:lesser|library) gpl", "lgpl"),
    (r"affero gpl", "agpl"), (r"\b(cc cc)\b", "cc"), (r"\b([al]?gpl) [al]?gpl\b", r"\1"),
]


def short(licence: str) -> str:
    """A licence's name in identifiers."""
    return re.sub(r"-(\d)(\.0)?", r"\1", licence.lower())


# Rules in order of precedence; sentences have to occur in this order, others may come between.
RULES: list[tuple[str, str, list[str]]] = [
    ("mit-text", "MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("apache2-notice", "Apache-2.0", ["apache2-header", "apache2-compliance", "apache2-as-is"]),
    ("gpl3-notice", "GPL-3.0-or-later", ["gpl-free", "gpl3-terms", "gpl-warranty"]),
    ("bsd3-text", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("bsd2-text", "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("mpl2-notice", "MPL-2.0", ["mpl2-ref", "mpl2-copy"]),
    ("zlib-text", "Zlib", ["zlib-as-is", "zlib-grant"]),
    ("unlicense-text", "Unlicense", ["unlicense-domain", "unlicense-grant"]),
    ("mit-grant", "MIT", ["mit-grant", "mit-notice"]),
    ("apache2-header", "Apache-2.0", ["apache2-header"]),
    ("gpl3-terms", "GPL-3.0-or-later", ["gpl3-terms"]),
    ("isc-text", "ISC", ["isc-grant"]),
    ("0bsd-text", "0BSD", ["0bsd-grant"]),
    ("bsl-text", "BSL-1.0", ["bsl-grant"]),
    ("unlicense-domain", "Unlicense", ["unlicense-domain"]),
    ("cc0-waiver", "CC0-1.0", ["cc0-waiver"]),
    *[(f"{short(licence)}-ref", licence, [f"{short(licence)}-ref"]) for licence in NAMES],
    ("all-rights", "proprietary", ["all-rights"]),
]

# Every known sentence holds one of these, so a text without any needs no splitting.
CUES = "licen[sc]|rights reserved|hereby granted|copyright notice|as is|free software|without any warranty|" \
       "redistribut|endorse or promote|unencumbered|anyone is free to|waived all copyright|copy of the mpl|" \
       "(?:[a-z]ed|available) (?:only )?(?:under|by) (?:the |a |either )?(?:cc|creative|mit|expat|[al]?gpl|gnu|bsd|apache|isc|zlib|0bsd)"
UNKNOWN = "unrecognised"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENDS = "[.!?:;]+[ \t\r\n]+"
BLANK_LINE = "\n[^a-z0-9\n]*\n"
ALTERNATIVES = " (?:or|and|with) "


def identifiers() -> dict[str, str]:
    """Identifier by normalised sentence."""
    return {sentence: name for name, listed in SENTENCES.items() for sentence in listed}


def references() -> dict[str, str]:
    """Identifier by normalised name of a licence."""
    return {name: f"{short(licence)}-ref" for licence, names in NAMES.items() for name in names}


def _replaced(value: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, other in steps:
        value = F.regexp_replace(value, pattern, re.sub(r"\\(\d)", r"$\1", other))
    return value


def _replaced_sql(value: str, steps: list[tuple[str, str]]) -> str:
    for pattern, other in steps:
        value = f"regexp_replace({value}, '{pattern}', '{other}', 'g')"
    return value


def _lookup(table: dict[str, str]) -> Callable[[Column], Column]:
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return lambda key: F.try_element_at(literal, key)


def _known(lines: Column) -> Column:
    """Identifiers of the known ones among newline-separated sentences, in order, as |a|b|."""
    sentence, reference = _lookup(identifiers()), _lookup(references())

    def named(s: Column) -> Column:
        names = F.split(_replaced(s, NAMING), ALTERNATIVES)
        return F.when(sentence(s).isNotNull(), F.array(sentence(s))).when(
            s.rlike(REFERENCE), F.transform(names, lambda n: reference(F.trim(n))))

    words = F.transform(F.split(lines, "\n"), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    filled = F.transform(F.filter(words, lambda s: s != ""),
                         lambda s: F.when(s.rlike(SLOTTED), _replaced(s, SLOTS)).otherwise(s))
    found = F.flatten(F.filter(F.transform(filled, named), lambda n: n.isNotNull()))
    return F.concat(F.lit("|"), F.concat_ws("|", F.filter(found, lambda n: n.isNotNull())), F.lit("|"))


def _pattern(names: list[str]) -> str:
    return r"\|" + r"\|(.*\|)?".join(re.sub("([-.])", r"[\1]", n) for n in names) + r"\|"


def recognise(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, licence, rule, licences, sentences, n_sentences) for every row with a known licence sentence.

    Sentences end at .!?:; before white space.  They are looked up twice: with lines ending sentences as well, and with
    line breaks taken as blanks but for lines without words, as licence texts are often wrapped.  A sentence is known by
    equality once its slots are filled alike, or as a reference: its frame ("... is released under the terms of ...") is
    taken off, and the names left are looked up one by one.  Tag lines (SPDX-License-Identifier) are read as references.
    A name with anything else behind it is no reference.

    ``sentences`` is the longer of the two identifier sequences (the first if equal).  ``licence`` and ``rule`` come from
    the first rule that either sequence fulfils, ``licences`` lists those of all rules; a known sentence outside of any rule
    gives "unrecognised".  Letters compare by A-Z without case; everything else but digits separates words.  Null and empty
    texts give no row, repeated rows one each; other columns are ignored.
    """
    text = _replaced(F.translate(F.col(text_column), UPPER, LOWER), MARKS)
    wrapped = F.regexp_replace(F.regexp_replace(text, BLANK_LINE, ". "), "[\r\n]", " ")
    cues = CUES.replace(" ", "[^a-z0-9]+")
    found = docs.where(F.translate(F.col(text_column), UPPER, LOWER).rlike(cues)).select(
        F.col(id_column).alias("doc_id"), _known(F.regexp_replace(text, ENDS, "\n")).alias("by_line"),
        _known(F.regexp_replace(wrapped, ENDS, "\n")).alias("by_stop"))
    known = found.where("by_line <> '||' or by_stop <> '||'")
    count = {c: F.when(F.col(c) == "||", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit("|"), F.lit(""))) - 1)
             for c in ("by_line", "by_stop")}
    # Rules of one sentence are looked up by it, the others tried as patterns.
    single = {seq[0]: i for i, (_, _, seq) in reversed(list(enumerate(RULES))) if len(seq) == 1}
    place = F.create_map(*[F.lit(x) for pair in single.items() for x in pair])
    several = [F.when(F.col("by_line").rlike(_pattern(seq)) | F.col("by_stop").rlike(_pattern(seq)), F.lit(i))
               for i, (_, _, seq) in enumerate(RULES) if len(seq) > 1]
    alone = F.transform(F.split(F.concat("by_line", "by_stop"), r"\|"), lambda s: F.try_element_at(place, s))
    hits = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(*several), alone), lambda i: i.isNotNull())))
    matched = known.withColumn("hits", hits)
    rules, licences = (F.array(*[F.lit(rule[field]) for rule in RULES]) for field in (0, 1))
    return matched.select(
        "doc_id", F.coalesce(F.get(licences, F.get("hits", 0)), F.lit(UNKNOWN)).alias("licence"),
        F.coalesce(F.get(rules, F.get("hits", 0)), F.lit("none")).alias("rule"),
        F.concat_ws(",", F.array_distinct(F.transform("hits", lambda i: F.get(licences, i)))).alias("licences"),
        F.when(count["by_stop"] > count["by_line"], F.col("by_stop")).otherwise(F.col("by_line")).alias("sentences"),
        F.greatest(count["by_line"], count["by_stop"]).cast("int").alias("n_sentences"))


def oracle_sql() -> str:
    """DuckDB form of ``recognise(documents)``, with joins and aggregates in place of the row-wise functions."""
    pairs = ", ".join(f"('{s}', '{n}')" for s, n in identifiers().items())
    names = ", ".join(f"('{s}', '{n}')" for s, n in references().items())
    rules = ", ".join(f"({i}, '{r}', '{lic}', '{_pattern(seq)}')" for i, (r, lic, seq) in enumerate(RULES))
    return f"""
WITH known(sentence, name) AS (VALUES {pairs}), named_licence(words, name) AS (VALUES {names}),
     rules(place, rule, licence, pattern) AS (VALUES {rules}),
     lowered AS (SELECT doc_id, {_replaced_sql(f"translate(text, '{UPPER}', '{LOWER}')", MARKS)} AS t FROM documents),
     forms AS (
       SELECT doc_id, 1 AS form, t FROM lowered
       UNION ALL
       SELECT doc_id, 2, {_replaced_sql("t", [(BLANK_LINE, ". "), ("[" + chr(13) + chr(10) + "]", " ")])} FROM lowered),
     lines AS (SELECT doc_id, form, string_split(regexp_replace(t, '{ENDS}', chr(10), 'g'), chr(10)) AS parts FROM forms),
     each AS (
       SELECT doc_id, form, trim(regexp_replace(unnest(parts), '[^a-z0-9]+', ' ', 'g')) AS s,
              generate_subscripts(parts, 1) AS place
       FROM lines),
     filled AS (
       SELECT doc_id, form, place,
              CASE WHEN regexp_matches(s, '{SLOTTED}') THEN {_replaced_sql("s", SLOTS)} ELSE s END AS s
       FROM each WHERE s <> ''),
     looked_up AS (SELECT doc_id, form, place, s, name FROM filled LEFT JOIN known ON sentence = s),
     referring AS (
       SELECT doc_id, form, place, string_split_regex({_replaced_sql("s", NAMING)}, '{ALTERNATIVES}') AS parts
       FROM looked_up WHERE name IS NULL AND regexp_matches(s, '{REFERENCE}')),
     parted AS (
       SELECT doc_id, form, place, trim(unnest(parts)) AS words, generate_subscripts(parts, 1) AS part FROM referring),
     named AS (
       SELECT doc_id, form, place, 0 AS part, name FROM looked_up WHERE name IS NOT NULL
       UNION ALL
       SELECT doc_id, form, place, part, name FROM parted JOIN named_licence USING (words)),
     sequences AS (
       SELECT doc_id, form, '|' || string_agg(name, '|' ORDER BY place, part) || '|' AS seq, count(*) AS n
       FROM named GROUP BY doc_id, form),
     longest AS (
       SELECT doc_id, arg_max(seq, n * 10 - form) AS sentences, max(n)::INTEGER AS n_sentences
       FROM sequences GROUP BY doc_id),
     hits AS (
       SELECT DISTINCT doc_id, place, rule, licence FROM sequences JOIN rules ON regexp_matches(seq, pattern)),
     firsts AS (SELECT doc_id, licence, min(place) AS place FROM hits GROUP BY doc_id, licence),
     listed AS (SELECT doc_id, string_agg(licence, ',' ORDER BY place) AS licences FROM firsts GROUP BY doc_id),
     best AS (SELECT doc_id, arg_min(licence, place) AS licence, arg_min(rule, place) AS rule FROM hits GROUP BY doc_id)
SELECT doc_id, coalesce(licence, '{UNKNOWN}') AS licence, coalesce(rule, 'none') AS rule,
       coalesce(licences, '') AS licences, sentences, n_sentences
FROM longest LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
