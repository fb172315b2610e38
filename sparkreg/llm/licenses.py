"""License scans: ordered signature rules over normalised words, as Column expressions only.

A text is lower-cased (A-Z), and what is not a word becomes one space. Rules are regular expressions
over that, each with a keyword, a priority and a weight. Keywords gate: a text without any anchor
word meets no rule, and a family of rules runs only where its keyword and the words that its
expressions begin with stand. A detection's interval is its words' numbers: matches are marked in
place, so that the interval is where the rule matched and nowhere else. Of the detections, one is
suppressed where another covers its whole interval with a higher priority, or with the same priority
and a longer interval, or the same interval and an earlier rule: in order of start, longest first,
each is held against the farthest ends so far of its own and higher priorities, in one pass. The
score is one minus the product of (1 - weight) over the labels left, each with its best rule.

Nulls and edges: a null text is empty; texts of any length are scanned whole; rows with equal or
null doc_id are scanned one by one; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: phrase -> label; these are reported wherever they stand and are never suppressed.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: One of these stands wherever a rule matches or a base phrase stands.
ANCHORS = (
    " licen", " copyright", " cc ", " cc0", " gpl", " lgpl", " agpl", " gplv", " spdx", " unlicense", " public domain",
    " copyleft", " warrant", " redistribut", " permission", " creative commons", " rights reserved", " mpl ", " bsd ", " wtfpl",
)
NOTICE, VERSION, NAME, HINT = 40, 30, 20, 10
WEIGHT = {NOTICE: 0.9, VERSION: 0.8, NAME: 0.6, HINT: 0.2}


def _gnu() -> list[tuple[str, int, str, str]]:
    out = []
    for short, long, versions in (
        ("gpl", "gnu general public license", ("1", "2", "3")),
        ("lgpl", "gnu (?:lesser|library) general public license", ("2", "2 1", "3")),
        ("agpl", "gnu affero general public license", ("1", "3")),
    ):
        for v in versions:
            spdx = f"{short}-{v.replace(' ', '.')}" + (".0" if " " not in v else "")
            number = f"v? ?{v}" + ("(?: 0)?" if " " not in v else "")
            named = f" {long}(?: as published by the free software foundation)?(?: either)?(?: version)? {number}"
            out += [
                (f"{spdx}-or-later", NOTICE, " licen", f"{named}(?: of the license)? or (?:at your option )?any later version"),
                (f"{spdx}-only", NOTICE, " licen", f"{named} only"),
                (spdx, VERSION, " licen", named),
                (f"{spdx}-or-later", VERSION, f" {short}", f" {short} ?{number} or later"),
                (f"{spdx}-only", VERSION, f" {short}", f" {short} ?{number} only"),
                (spdx, VERSION, f" {short}", f" {short} ?{number}"),
            ]
        out += [(short, NAME, " licen", f" {long}"), (short, HINT, f" {short}", f" {short} license")]
    return out


def _creative_commons() -> list[tuple[str, int, str, str]]:
    out = []
    words = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative|ative work)s?", "sa": "share ?alike"}
    for kind in ("by", "by nc", "by nc nd", "by nc sa", "by nd", "by sa"):
        label = "cc-" + kind.replace(" ", "-")
        full = " ".join(words[w] for w in kind.split())
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            tail = f"{v}(?: (?:international|unported|generic))?(?: license)?"
            out += [
                (f"{label}-{v.replace(' ', '.')}", NOTICE, " creative commons", f" creative commons {full} {tail}"),
                (f"{label}-{v.replace(' ', '.')}", VERSION, " cc ", f" cc {kind} {tail}"),
            ]
        out += [(label, NAME, " creative commons", f" creative commons {full}"), (label, NAME, " cc ", f" cc {kind}")]
    return [*out, ("cc0-1.0", NOTICE, " cc0", " cc0 1 0(?: universal)?"), ("cc0-1.0", NAME, " cc0", " cc0"), ("creative-commons", HINT, " creative commons", " creative commons license")]


def _versioned() -> list[tuple[str, int, str, str]]:
    """Names with their versions: each version, and the bare name."""
    families = {
        "apache": (" apache(?: software)? license", ("1 0", "1 1", "2 0")),
        "mpl": (" mozilla public license", ("1 0", "1 1", "2 0")),
        "epl": (" eclipse public license", ("1 0", "2 0")),
        "cddl": (" common development and distribution license", ("1 0", "1 1")),
        "eupl": (" european union public licence?s?e?", ("1 0", "1 1", "1 2")),
        "artistic": (" artistic license", ("1 0", "2 0")),
        "osl": (" open software license", ("1 0", "2 0", "2 1", "3 0")),
        "afl": (" academic free license", ("1 1", "1 2", "2 0", "2 1", "3 0")),
        "bsl": (" boost software license", ("1 0",)),
        "ms-pl": (" microsoft public license", ()),
        "ms-rl": (" microsoft reciprocal license", ()),
        "ofl": (" sil open font license", ("1 0", "1 1")),
        "gfdl": (" gnu free documentation license", ("1 1", "1 2", "1 3")),
        "lppl": (" latex project public license", ("1 0", "1 1", "1 2", "1 3")),
        "cpl": (" common public license", ("1 0",)),
        "ipl": (" ibm public license", ("1 0",)),
        "php": (" php license", ("3 0", "3 01")),
        "python": (" python(?: software foundation)? license", ("2 0",)),
        "zpl": (" zope public license", ("1 1", "2 0", "2 1")),
        "apsl": (" apple public source license", ("1 0", "1 1", "1 2", "2 0")),
        "qpl": (" q public license", ("1 0",)),
        "odbl": (" open database license", ("1 0",)),
        "rpl": (" reciprocal public license", ("1 1", "1 5")),
        "npl": (" netscape public license", ("1 0", "1 1")),
        "spl": (" sun public license", ("1 0",)),
        "cecill": (" cecill(?: free software)? license", ("1 0", "1 1", "2 0", "2 1")),
        "mulan-psl": (" mulan permissive software license", ("1", "2")),
        "sspl": (" server side public license", ("1",)),
        "busl": (" business source license", ("1 1",)),
        "elastic": (" elastic license", ("2 0",)),
        "openssl": (" openssl license", ()),
        "vim": (" vim license", ()),
        "ruby": (" ruby license", ()),
        "postgresql": (" postgresql license", ()),
        "w3c": (" w3c software(?: notice and)? license", ()),
        "x11": (" x11 license", ()),
        "isc": (" isc license", ()),
        "zlib": (" zlib(?: libpng)? license", ()),
        "mit": (" mit license", ()),
        "ncsa": (" university of illinois ncsa open source license", ()),
        "unlicense": (" the unlicense", ()),
    }
    out = []
    for label, (name, versions) in families.items():
        key = " unlicense" if "unlicense" in name else " licen"
        out += [(f"{label}-{v.replace(' ', '.')}", VERSION, key, f"{name}(?: version)?(?: v)? ?{v}") for v in versions]
        out.append((label, NAME, key, name))
    return out


#: Signatures written out one by one.
_WRITTEN = [
    ("mit", NOTICE, " permission", " permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", VERSION, " licen", " (?:released|licensed|distributed|available) under the (?:terms of the )?mit license"),
    ("mit", HINT, " licen", " licensed under mit"),
    ("isc", NOTICE, " permission", " permission to use copy modify and or distribute this software for any purpose"),
    ("apache-2.0", NOTICE, " licen", " licensed under the apache license version 2 0"),
    ("apache", VERSION, " licen", " (?:released|licensed|distributed) under the (?:terms of the )?apache license"),
    ("bsd-3-clause", NOTICE, " redistribut", " redistribution and use in source and binary forms.{0,600}? neither the name"),
    ("bsd-2-clause", VERSION, " redistribut", " redistribution and use in source and binary forms"),
    ("bsd-3-clause", VERSION, " bsd ", " (?:3|three) clause bsd|(?: new| modified| revised) bsd license| bsd 3 clause"),
    ("bsd-2-clause", VERSION, " bsd ", " (?:2|two) clause bsd| simplified bsd license| bsd 2 clause"),
    ("bsd-2-clause", VERSION, " licen", " freebsd license"),
    ("bsd-4-clause", VERSION, " bsd ", " (?:4|four) clause bsd| original bsd license| bsd 4 clause"),
    ("bsd", NAME, " bsd ", " bsd(?: style)? license"),
    ("unlicense", NOTICE, " public domain", " free and unencumbered software released into the public domain"),
    ("public-domain", VERSION, " public domain", " (?:released|placed|dedicated)(?: in| into| to) the public domain"),
    ("public-domain", NAME, " public domain", " public domain"),
    ("wtfpl", NAME, " wtfpl", " wtfpl"),
    ("wtfpl", NAME, " licen", " do what the fuck you want to public license"),
    ("mpl-2.0", VERSION, " mpl ", " mpl 2 0"),
    ("proprietary", VERSION, " licen", " (?:end user|proprietary|commercial) license(?: agreement)?"),
    ("proprietary", VERSION, " licen", " not licensed for (?:redistribution|commercial use)"),
    ("all-rights-reserved", NAME, " rights reserved", " all rights reserved"),
    ("copyright", HINT, " copyright", " copyright(?: c)? (?:19|20)[0-9]{2}"),
    ("copyleft", HINT, " copyleft", " copyleft"),
    ("spdx", VERSION, " spdx", " spdx license identifier [a-z0-9]+"),
    ("warranty-disclaimer", HINT, " warrant", " (?:without|no) warranty(?: of any kind)?"),
    ("warranty-disclaimer", HINT, " warrant", " without warranties or conditions of any kind"),
    ("license-reference", HINT, " licen", " see the license(?: file)?(?: for)?"),
    ("license-reference", HINT, " licen", " licensed under the"),
    ("license-reference", HINT, " licen", " under the terms of the .{0,60}? license"),
]


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, regular expression) in order; a match ends before a space."""
    return [(a, b, c, f"(?:{d})(?= )") for a, b, c, d in (*_WRITTEN, *_gnu(), *_creative_commons(), *_versioned())]


def normalised(text: Column) -> Column:
    """Words of a text, each after one space, with one space at the end."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), NOT_WORD, " ")


def _spaces(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")


def _place(norm: Column, phrase: str, last: bool) -> Column:
    """Number of the word at which the first or last place of phrase begins, or null."""
    found = f" {phrase} "
    if not last:
        at = F.instr(norm, found)
        return F.when(at > 0, _spaces(F.substring(norm, F.lit(1), at - 1)))
    at = F.instr(F.reverse(norm), found[::-1])
    return F.when(at > 0, _spaces(F.substring(norm, F.lit(1), F.length(norm) - at - len(found) + 1)))


#: start, minus the end, minus the priority, rule: the order in which suppression goes through them.
DETECTION = "struct<s:int,ne:int,np:int,rule:int,label:string,weight:double>"
#: Detections that one inner fold of suppression takes.
FOLD = 256


def _literal(regex: str) -> str:
    """What every match of a rule's expression begins with, as far as that is plain text."""
    depth = 0
    for c in regex:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            return ""
    plain = re.match("[a-z0-9 ]*", regex).group()
    return plain[:-1] if regex[len(plain) : len(plain) + 1] in ("?", "*", "{") else plain


def families() -> dict[tuple[str, str], list[int]]:
    """Numbers of the rules of each keyword and beginning."""
    out: dict[tuple[str, str], list[int]] = {}
    for k, (_, _, keyword, regex) in enumerate(rules()):
        out.setdefault((keyword, _literal(regex[3:-5])), []).append(k)
    return out


def _detections(norm: str, table: str) -> Column:
    """Detections of one text as an array of structs. A match begins with a space, so that marks put
    around it stand at the ends of the word before it and of its last word."""
    marked = lambda mark: f"filter(transform(ws, (w, i) -> if(contains(w, chr({mark})), i, null)), i -> i is not null)"
    return F.expr(f"""
      array_sort(flatten(transform(
        flatten(transform(
          filter({table}, f -> contains({norm}, f.keyword) and contains({norm}, f.literal)),
          f -> filter(f.rules, r -> {norm} rlike r.regex))),
        r -> flatten(transform(
          array(split(regexp_replace({norm}, r.regex, concat(chr(1), '$0', chr(2))), ' ')),
          ws -> zip_with({marked(1)}, {marked(2)}, (s, e) -> named_struct(
            's', s, 'ne', -e, 'np', -r.pri, 'rule', r.rule, 'label', r.label, 'weight', r.weight)))))))
    """)


def _kept(found: str) -> Column:
    """Sorted detections without the suppressed ones. m<p> is the farthest end of those before with a
    priority of p or more: such a one that reaches d's end covers d and is stronger. Folds in two
    levels, as an array that grows by one element is copied each time."""
    levels = (HINT, NAME, VERSION, NOTICE)
    state = lambda f: ", ".join(f"'m{p}', {f(p)}" for p in levels)
    reach = "case -d.np " + " ".join(f"when {p} then st.m{p}" for p in levels) + " end"
    return F.expr(f"""
      flatten(aggregate(
        sequence(0, int((size({found}) - 1) / {FOLD})),
        named_struct({state(lambda p: "-1")}, 'parts', cast(array() as array<array<{DETECTION}>>)),
        (acc, k) -> aggregate(
          slice({found}, k * {FOLD} + 1, {FOLD}),
          named_struct({state(lambda p: f"acc.m{p}")}, 'kept', cast(array() as array<{DETECTION}>)),
          (st, d) -> named_struct(
            {state(lambda p: f"if(-d.np >= {p}, greatest(st.m{p}, -d.ne), st.m{p})")},
            'kept', if({reach} >= -d.ne, st.kept, concat(st.kept, array(d)))),
          st -> named_struct({state(lambda p: f"st.m{p}")}, 'parts', concat(acc.parts, array(st.kept)))),
        acc -> acc.parts))
    """)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and detections: the
    kept ones with their first word and the word after their last, counted from 0."""
    every_rule = [
        F.struct(F.lit(a).alias("label"), F.lit(b).alias("pri"), F.lit(d).alias("regex"), F.lit(k).alias("rule"), F.lit(WEIGHT[b]).alias("weight"))
        for k, (a, b, _, d) in enumerate(rules())
    ]
    table = F.array(
        *[
            F.struct(F.lit(keyword).alias("keyword"), F.lit(literal).alias("literal"), F.array(*[every_rule[k] for k in numbers]).alias("rules"))
            for (keyword, literal), numbers in families().items()
        ]
    )
    norm = F.col("_norm")
    x = docs.select("doc_id", normalised(F.col("text")).alias("_norm"))
    gate = F.lit(False)
    for a in ANCHORS:
        gate = gate | F.contains(norm, F.lit(a))
    x = x.select("doc_id", "_norm", F.greatest(_spaces(norm) - 1, F.lit(0)).alias("n_words"), gate.alias("_gate"))
    phrases = list(BASE)
    count = [F.regexp_count(norm, F.lit(f"(?<= ){p}(?= )")).cast("long") for p in phrases]
    shut = lambda on, off: F.when(F.col("_gate"), on).otherwise(off)
    x = x.withColumn("_rules", F.when(F.col("_gate"), table)).select(
        "doc_id", "n_words",
        *[shut(c, F.lit(0).cast("long")).alias(f"_n{k}") for k, c in enumerate(count)],
        *[shut(_place(norm, p, False), F.lit(None)).alias(f"_f{k}") for k, p in enumerate(phrases)],
        *[shut(_place(norm, p, True), F.lit(None)).alias(f"_l{k}") for k, p in enumerate(phrases)],
        F.coalesce(_detections("_norm", "_rules"), F.array().cast(f"array<{DETECTION}>")).alias("_all"),
    )
    every = range(len(phrases))
    base = F.filter(F.array(*[F.when(F.col(f"_n{k}") > 0, F.lit(BASE[p])) for k, p in enumerate(phrases)]), lambda v: v.isNotNull())
    x = x.select(
        "doc_id", "n_words", sum((F.col(f"_n{k}") for k in every), F.lit(0).cast("long")).alias("n_base"),
        F.least(*[F.col(f"_f{k}") for k in every]).alias("first_word"), F.greatest(*[F.col(f"_l{k}") for k in every]).alias("last_word"),
        F.array_sort(F.array_distinct(base)).alias("_base"),
        _kept("_all").alias("detections"),
    )
    labels = F.array_sort(F.array_distinct(F.concat("_base", F.transform("detections", lambda d: d["label"]))))
    x = x.withColumn("_labels", labels)
    weight = F.expr(f"""
      1e0 - aggregate(_labels, 1e0, (p, v) -> p * (1e0 - greatest(
        if(array_contains(_base, v), {WEIGHT[NAME]}e0, 0e0),
        coalesce(array_max(transform(filter(detections, d -> d.label = v), d -> d.weight)), 0e0))))
    """)
    return x.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"),
        F.array_join("_labels", ",").alias("labels"), weight.alias("score"),
        F.expr("transform(detections, d -> named_struct('first', d.s, 'end', -d.ne, 'label', d.label, 'priority', -d.np, 'rule', d.rule))").alias("detections"),
    )


def op6_license_scan(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("detections")
