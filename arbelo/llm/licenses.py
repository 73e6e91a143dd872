r"""License scans (operator 8): ordered signature rules, DataFrame functions only.

A text becomes its words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing,
joined by single spaces.  Some hundreds of signature patterns (each license of
`LICENSES` in each form of `FORMS`, the sentences of `BODIES` and the signatures
written out in license_texts.py) are gated by keywords: a pattern runs only on
texts that have its keywords among their words.  Every match is an interval of
words with a label and the form's priority; an interval inside another one of
higher priority, or of the same priority and longer, is suppressed.

The base phrases are rules too; their places are counted before suppression and
their labels always stay.

Edge cases: null and empty texts have no words, no places, empty labels and
score 0; repeated rows are scanned as often as they occur; an empty table gives
an empty result.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbelo.llm.license_texts import SIGNATURES
from arbelo.llm.spans import bind, match_spans, running


class Rule(NamedTuple):
    label: str
    keyword: str
    needs: str  # a second word; every match of the pattern has both words of one of its rules. The keyword again if there is none
    pattern: str
    priority: int
    base: bool = False


BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label, keywords (every match of the name has one of them, with & both of a pair), its name, its SPDX words.
LICENSES = [
    ("gpl-1", "gpl|general&public", r"(?:gnu )?(?:general public license|gpl) (?:version |v)?1(?: 0)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2", "gpl|gplv2|general&public", r"(?:gnu )?(?:(?:general public license|gpl) (?:version |v)?2(?: 0)?|gplv2)", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3", "gpl|gplv3|general&public", r"(?:gnu )?(?:(?:general public license|gpl) (?:version |v)?3(?: 0)?|gplv3)", r"gpl 3 0(?: only| or later)?"),
    ("lgpl-2", "lgpl|lgplv2|library&general", r"(?:gnu )?(?:(?:library general public license|lgpl) (?:version |v)?2(?: 0)?|lgplv2)", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lgpl|lesser&general", r"(?:gnu )?(?:lesser general public license|lgpl) (?:version |v)?2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "lgpl|lgplv3|lesser&general", r"(?:gnu )?(?:(?:lesser general public license|lgpl) (?:version |v)?3(?: 0)?|lgplv3)", r"lgpl 3 0(?: only| or later)?"),
    ("agpl-3", "agpl|affero|agplv3", r"(?:gnu )?(?:(?:affero general public license|agpl)(?: (?:version |v)?3(?: 0)?)?|agplv3)", r"agpl 3 0(?: only| or later)?"),
    ("gfdl", "gfdl|documentation&free", r"(?:gnu )?(?:free documentation license|gfdl)(?: (?:version |v)?1 [123])?", r"gfdl 1 [123](?: only| or later)?"),
    ("apache-1.0", "apache", r"apache (?:software )?license (?:version |v)?1 0", r"apache 1 0"),
    ("apache-1.1", "apache", r"apache (?:software )?license (?:version |v)?1 1", r"apache 1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?license (?:version |v)?2(?: 0)?", r"apache 2 0"),
    ("mit", "mit|expat|x11", r"(?:the )?(?:mit|expat|x11)(?: x11)? license", r"mit"),
    ("mit-0", "mit", r"mit no attribution(?: license)?", r"mit 0"),
    ("isc", "isc", r"isc license", r"isc"),
    ("0bsd", "0bsd|bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)(?: license)?", r"0bsd"),
    ("bsd-2-clause", "bsd|freebsd", r"(?:(?:simplified|2 clause|two clause) bsd|bsd 2 clause|freebsd)(?: license)?", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:(?:new|revised|modified|3 clause|three clause) bsd|bsd 3 clause)(?: license)?", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:(?:original|old|4 clause|four clause) bsd|bsd 4 clause)(?: license)?", r"bsd 4 clause"),
    ("mpl-1.1", "mozilla|mpl", r"(?:mozilla public license|mpl) (?:version |v)?1 [01]", r"mpl 1 [01]"),
    ("mpl-2.0", "mozilla|mpl", r"(?:mozilla public license|mpl) (?:version |v)?2(?: 0)?", r"mpl 2 0"),
    ("epl-1.0", "eclipse|epl", r"(?:eclipse public license|epl) (?:version |v)?1(?: 0)?", r"epl 1 0"),
    ("epl-2.0", "eclipse|epl", r"(?:eclipse public license|epl) (?:version |v)?2(?: 0)?", r"epl 2 0"),
    ("cddl", "cddl|distribution", r"(?:common development and distribution license|cddl)(?: (?:version |v)?1 [01])?", r"cddl 1 [01]"),
    ("cpl", "cpl|common", r"(?:common public license|cpl 1 0)", r"cpl 1 0"),
    ("eupl", "eupl|european", r"(?:european union public licen[cs]e|eupl)(?: (?:version |v)?1 [012])?", r"eupl 1 [012]"),
    ("ms-pl", "microsoft|ms", r"microsoft public license", r"ms pl"),
    ("ms-rl", "microsoft|ms", r"microsoft reciprocal license", r"ms rl"),
    ("cc0", "cc0|creative", r"(?:creative commons zero|cc0)(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("cc-by", "cc|creative", r"(?:creative commons attribution|cc by) (?:(?:version |v)?[1234](?: [05])?)(?: (?:international|unported))?", r"cc by [1234] [05]"),
    ("cc-by-sa", "cc|creative", r"(?:creative commons attribution share ?alike|cc by sa)(?: [1234](?: [05])?)?", r"cc by sa [1234] [05]"),
    ("cc-by-nd", "cc|creative", r"(?:creative commons attribution no ?deriv(?:ative)?s|cc by nd)(?: [1234](?: [05])?)?", r"cc by nd [1234] [05]"),
    ("cc-by-nc", "cc|creative", r"(?:creative commons attribution non ?commercial|cc by nc)(?: [1234](?: [05])?)?", r"cc by nc [1234] [05]"),
    ("cc-by-nc-sa", "cc|creative", r"(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: [1234](?: [05])?)?", r"cc by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "cc|creative", r"(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd)(?: [1234](?: [05])?)?", r"cc by nc nd [1234] [05]"),
    ("artistic-1.0", "artistic", r"artistic license(?: 1 0)?", r"artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic license (?:version |v)?2(?: 0)?", r"artistic 2 0"),
    ("boost", "boost|bsl", r"boost software license(?: (?:version )?1 0)?", r"bsl 1 0"),
    ("busl", "business|busl", r"business source license(?: 1 1)?", r"busl 1 1"),
    ("zlib", "zlib", r"zlib(?: libpng)? license", r"zlib"),
    ("libpng", "libpng", r"libpng license", r"libpng(?: 2 0)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: version 2)?", r"wtfpl"),
    ("python", "python|psf", r"(?:python software foundation license|psf license)(?: (?:version )?2)?", r"(?:python|psf) 2 0"),
    ("php", "php", r"php license(?: (?:version )?3(?: 0[01]?)?)?", r"php 3 0[01]?"),
    ("ruby", "ruby", r"ruby license", r"ruby"),
    ("openssl", "openssl", r"openssl license", r"openssl"),
    ("postgresql", "postgresql", r"postgresql license", r"postgresql"),
    ("curl", "curl", r"curl license", r"curl"),
    ("ofl", "font&license", r"(?:sil )?open font license(?: (?:version )?1 [01])?", r"ofl 1 [01]"),
    ("odbl", "odbl|database", r"(?:open database license|odbl)(?: 1 0)?", r"odbl 1 0"),
    ("pddl", "pddl|domain", r"(?:public domain dedication and license|pddl)(?: 1 0)?", r"pddl 1 0"),
    ("public-domain", "domain", r"public domain", r"public domain"),
    ("sspl", "sspl|server", r"(?:server side public license|sspl)(?: (?:version |v)?1)?", r"sspl 1 0"),
    ("elastic", "elastic", r"elastic license(?: (?:version )?2(?: 0)?)?", r"elastic 2 0"),
    ("ncsa", "ncsa|illinois", r"(?:university of illinois ncsa open source license|ncsa license)", r"ncsa"),
    ("ecl", "educational|ecl", r"educational community license(?: (?:version )?2 0)?", r"ecl 2 0"),
    ("proprietary", "rights|proprietary", r"(?:all rights reserved|proprietary license)", r"licenseref proprietary"),
]

_GNU = r"modify it under the terms of the gnu {} as published by the free software foundation (?:either )?version {}"
#: label, two words that every match has, a sentence of the license's own text or of the notice it asks for.
BODIES = [
    ("gpl-1", "modify", "foundation", _GNU.format("general public license", "1")),
    ("gpl-2", "modify", "foundation", _GNU.format("general public license", "2")),
    ("gpl-3", "modify", "foundation", _GNU.format("general public license", "3")),
    ("lgpl-2", "modify", "foundation", _GNU.format("library general public license", "2")),
    ("lgpl-2.1", "modify", "foundation", _GNU.format("lesser general public license", "2 1")),
    ("lgpl-3", "modify", "foundation", _GNU.format("lesser general public license", "3")),
    ("agpl-3", "modify", "foundation", _GNU.format("affero general public license", "3")),
    ("apache-2.0", "agreed", "writing", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("mit", "permission", "portions", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("isc", "permission", "granted", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "permission", "granted", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "permitted", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "endorse", "neither", r"neither the names? of (?:[^ ]+ ){1,24}may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", "mentioning", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("mpl-1.1", "contents", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "mozilla", "form", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "accompanying", "eclipse", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("boost", "permission", "organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("zlib", "liable", "authors", r"without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "unencumbered", "domain", r"this is free and unencumbered software released into the public domain"),
    ("cc0", "deed", "dedicated", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("artistic-1.0", "semblance", "artistic", r"the copyright holder maintains some semblance of artistic control"),
    ("ofl", "permission", "font", r"permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("openssl", "openssl", "toolkit", r"software developed by the openssl project for use in the openssl toolkit"),
    ("postgresql", "fee", "agreement", r"for any purpose without fee and without a written agreement is hereby granted"),
    ("python", "psf", "nonexclusive", r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("busl", "licensor", "production", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
]

#: form, priority, pattern around the name (N) or the SPDX words (S).
FORMS = [
    ("title", 1, "N"),
    ("licence", 1, r"N (?:licen[cs]ed?|terms)"),
    ("grant", 2, r"(?:licen[cs]ed|released|distributed|published|provided|available|redistributed|used) (?:to you )?under (?:the )?(?:terms of )?(?:the )?(?:terms of the )?N"),
    ("subject", 2, r"(?:subject to|governed by|covered by|in accordance with|complies with) (?:the )?(?:terms of )?(?:the )?N"),
    ("copy", 3, r"(?:you may obtain a copy of|a copy of|see) the N(?: at)?"),
    ("spdx", 4, r"spdx license identifier S"),
]


#: Licenses whose name always has the word "license".
_NAMED_LICENSE = ["apache-1.0", "apache-1.1", "apache-2.0", "mit", "isc", "ms-pl", "ms-rl", "artistic-1.0", "artistic-2.0", "boost", "busl", "zlib", "libpng", "python", "php", "ruby", "openssl", "postgresql", "curl", "elastic", "ecl"]


def _between_spaces(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def rules() -> list[Rule]:
    out = [Rule(label, phrase.split()[0], phrase.split()[-1], _between_spaces(phrase), 1, True) for phrase, label in BASE.items()]
    for label, keywords, name, spdx in LICENSES:
        for form, priority, around in FORMS:
            pattern = _between_spaces(around.replace("N", f"(?:{name})").replace("S", f"(?:{spdx})"))
            if form == "spdx":
                out.append(Rule(label, "spdx", "identifier", pattern, priority))
            else:
                pairs = [k.partition("&") for k in keywords.split("|")]
                out += [Rule(label, k, second or ("license" if label in _NAMED_LICENSE else k), pattern, priority) for k, _, second in pairs]
    out += [Rule(label, keyword, needs, _between_spaces(body), 3) for label, keyword, needs, body in BODIES]
    return out + [Rule(label, *_longest(words), _between_spaces(words), 3) for label, words in SIGNATURES]


def _longest(words: str) -> list[str]:
    """The two longest words of a signature: the least likely to stand in other texts."""
    return sorted(set(words.split()), key=lambda w: (-len(w), w))[:2]


def _folded(text: Column) -> Column:
    """A-Z in lower case. lower() is faster; of the letters that it changes else, only two become or hold ASCII letters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130")), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def _detections(here: Column, text: Column, table: list[Rule]) -> Column:
    """array<struct<start,end,label,priority,base>> of all matches; start and end number words; here: the text's keywords."""
    pairs: dict[tuple, list[dict]] = {}
    for r in table:
        pairs.setdefault((r.label, r.pattern, r.priority, r.base), []).append({"one": r.keyword, "two": r.needs})
    # one literal, folded when the plan is optimised: a column for each field of each rule takes seconds to build
    told = [dict(zip(("label", "pattern", "priority", "base"), rule, strict=True)) | {"pairs": words} for rule, words in pairs.items()]
    known = F.from_json(F.lit(json.dumps(told)), "array<struct<label:string,pattern:string,priority:int,base:boolean,pairs:array<struct<one:string,two:string>>>>")
    gated = F.filter(known, lambda r: F.exists(r["pairs"], lambda p: F.array_contains(here, p["one"]) & F.array_contains(here, p["two"])))
    spaces = lambda n: F.length(n) - F.length(F.replace(n, F.lit(" "), F.lit("")))

    def placed(r: Column) -> Column:
        # as many words begin before a place as there are spaces before it, but one
        return F.transform(match_spans(text, r["pattern"], spaces), lambda s: F.struct((s["start"] - 1).alias("start"), s["end"].alias("end"), r["label"].alias("label"), r["priority"].alias("priority"), r["base"].alias("base")))

    return F.flatten(F.transform(gated, placed))


def _unsuppressed(found: Column, most: int) -> Column:
    """The detections inside no other one of higher priority, or of the same priority and longer.

    In the order of starts, of one start the longest first, whatever holds a
    detection stands before it; so for each priority the farthest end so far
    tells, of one end the earliest start.
    """
    reach = lambda d: d["end"].cast("long") * (1 << 31) + ((1 << 31) - 1 - d["start"])
    tops = lambda d: F.struct(*[F.when(d["priority"] == p, reach(d)).otherwise(F.lit(-1).cast("long")).alias(f"p{p}") for p in range(1, most + 1)])
    farther = lambda a, b: F.struct(*[F.greatest(a[f"p{p}"], b[f"p{p}"]).alias(f"p{p}") for p in range(1, most + 1)])
    kind = "array<struct<" + ",".join(f"p{p}:bigint" for p in range(1, most + 1)) + ">>"
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), (-d["priority"]).alias("low"), d.alias("d"))))

    def kept(own: Column, far: Column) -> Column:
        def beaten(x: Column, i: Column) -> Column:
            d, before = x["d"], F.get(far, i - 1)
            higher = [(d["priority"] < p) & (before[f"p{p}"] >= d["end"].cast("long") * (1 << 31)) for p in range(1, most + 1)]
            longer = [(d["priority"] == p) & (before[f"p{p}"] > reach(d)) for p in range(1, most + 1)]
            any_ = higher[0]
            for h in (*higher[1:], *longer):
                any_ = any_ | h
            return F.coalesce(any_, F.lit(False))

        return F.transform(F.filter(own, lambda x, i: ~beaten(x, i)), lambda x: x["d"])

    return bind(ordered, lambda own: bind(bind(F.transform(own, lambda x: tops(x["d"])), lambda t: running(t, farther, kind)), lambda far: kept(own, far)))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """key, n_words, found (all detections) and kept (those that no other one suppresses) of every row."""
    table = table or rules()
    listed = lambda *fields: F.split(F.lit(" ".join(sorted({getattr(r, c) for r in table for c in fields}))), " ")
    keywords, seconds, every = listed("keyword"), listed("needs"), listed("keyword", "needs")
    words = F.regexp_extract_all(_folded(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,label:string,priority:int,base:boolean>>")
    rows = docs.select(F.col(key).alias(key), words.alias("words"))
    # texts without any pair of keywords keep nothing but the number of words; the gate is a cheaper superset of the rules' own
    rows = rows.select(key, F.size("words").cast("long").alias("n_words"), F.when(F.arrays_overlap("words", keywords) & F.arrays_overlap("words", seconds), F.col("words")).alias("words"))
    # the keywords of a text are a column of their own: inside the filter over rules they would be found anew for each rule
    rows = rows.select(key, "n_words", F.array_intersect("words", every).alias("here"), F.when(F.col("words").isNotNull(), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).alias("plain"))
    rows = rows.select(key, "n_words", F.when(F.col("plain").isNotNull(), _detections(F.col("here"), F.col("plain"), table)).otherwise(none).alias("found"))
    return rows.withColumn("kept", F.when(F.size("found") > 1, _unsuppressed(F.col("found"), max(r.priority for r in table))).otherwise(F.col("found")))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    found = scan(docs, key, text).withColumn("own", F.filter("found", lambda d: d["base"]))
    starts = F.transform("own", lambda d: d["start"].cast("long"))
    told = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), ",")
    base = F.transform("own", lambda d: d["label"])
    score = F.coalesce(F.array_max(F.transform("kept", lambda d: d["priority"])), F.lit(0)) / F.lit(4.0)
    return found.select(key, "n_words", F.size("own").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), told(base).alias("base_labels"), told(F.concat(base, F.transform("kept", lambda d: d["label"]))).alias("labels"), score.alias("score"))
