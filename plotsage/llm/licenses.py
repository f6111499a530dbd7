"""Licence scan by sentence rules: sentences to identifiers, sequences of identifiers to licences. Built-in functions only."""

from __future__ import annotations

import functools
import json
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotsage.llm.columns import let

# Licences by their SPDX identifiers, and the names that references use, normalised (lower case, other
# characters as one blank). Of Creative Commons licences the names are made by rule below.
NAMES: dict[str, tuple[str, ...]] = {
    "0BSD": ("bsd zero clause license",),
    "AFL-3.0": ("academic free license version 3 0", "academic free license v3 0"),
    "AGPL-3.0": ("gnu affero general public license version 3", "gnu affero general public license v3 0", "gnu agpl version 3", "agpl v3", "agpl 3 0"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 license"),
    "Artistic-2.0": ("artistic license 2 0", "artistic license version 2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "freebsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"),
    "BSD-4-Clause": ("bsd 4 clause license", "original bsd license"),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0"),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal license"),
    "CDDL-1.0": ("common development and distribution license version 1 0", "common development and distribution license 1 0"),
    "EPL-1.0": ("eclipse public license 1 0", "eclipse public license v1 0", "eclipse public license version 1 0"),
    "EPL-2.0": ("eclipse public license 2 0", "eclipse public license v2 0", "eclipse public license version 2 0"),
    "EUPL-1.2": ("european union public licence version 1 2", "european union public licence 1 2", "eupl 1 2", "eupl version 1 2"),
    "GFDL-1.2": ("gnu free documentation license version 1 2",),
    "GFDL-1.3": ("gnu free documentation license version 1 3",),
    "GPL-1.0": ("gnu general public license version 1",),
    "GPL-2.0": ("gnu general public license version 2", "gnu general public license v2 0", "gnu gpl version 2", "gpl v2", "gpl 2 0"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3 0", "gnu gpl version 3", "gpl v3", "gpl 3 0"),
    "ISC": ("isc license",),
    "LGPL-2.0": ("gnu library general public license version 2",),
    "LGPL-2.1": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl version 2 1", "lgpl v2 1", "lgpl 2 1"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "gnu lesser general public license v3 0", "gnu lgpl version 3", "lgpl v3", "lgpl 3 0"),
    "MIT": ("mit license", "mit licence", "expat license"),
    "MPL-1.1": ("mozilla public license version 1 1", "mozilla public license 1 1"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0"),
    "MS-PL": ("microsoft public license",),
    "NCSA": ("university of illinois ncsa open source license", "ncsa license"),
    "OFL-1.1": ("sil open font license version 1 1", "sil open font license 1 1"),
    "OSL-3.0": ("open software license version 3 0", "open software license v3 0"),
    "PostgreSQL": ("postgresql license",),
    "PSF-2.0": ("python software foundation license version 2", "python software foundation license"),
    "Ruby": ("ruby license",),
    "Unlicense": ("unlicense",),
    "UPL-1.0": ("universal permissive license version 1 0", "universal permissive license v 1 0"),
    "Vim": ("vim license",),
    "WTFPL": ("wtfpl", "do what the fuck you want to public license"),
    "X11": ("x11 license",),
    "Zlib": ("zlib license",),
    "ZPL-2.1": ("zope public license version 2 1", "zope public license 2 1"),
}
for _terms, _words in (("BY", "attribution"), ("BY-SA", "attribution sharealike"), ("BY-NC", "attribution noncommercial"), ("BY-ND", "attribution noderivatives"), ("BY-NC-SA", "attribution noncommercial sharealike"), ("BY-NC-ND", "attribution noncommercial noderivatives")):
    for _version, _port in (("2.0", "generic"), ("3.0", "unported"), ("4.0", "international")):
        _v = _version.replace(".", " ")
        NAMES[f"CC-{_terms}-{_version}"] = (f"cc {_terms.lower().replace('-', ' ')} {_v}", f"creative commons {_words} {_v} {_port} license", f"creative commons {_words} {_v} license")

# How a reference leads up to a name, which may have an article; what stands before that, and behind the name,
# is left out first (see _BEFORE_VERB and TAIL).
LEADS = ("licensed under", "released under", "distributed under", "available under", "made available under", "published under", "provided under", "covered by", "dual licensed under", "licensed under either of", "license", "licence")

# Public wording of licence texts and notices, normalised.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0 the license": "apache-head",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-asis",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-implied",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "ncsa-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-asis",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers": "ncsa-source",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies": "postgresql-grant",
    "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted": "hpnd-grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-head",
    "the contents of this file are subject to the mozilla public license version 1 1 the license": "mpl11-head",
    "the contents of this file are subject to the terms of the common development and distribution license the license": "cddl-head",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0": "epl2-head",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-head",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0": "epl1-head",
    "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0": "epl1-head",
    "this is free and unencumbered software released into the public domain": "unlicense-head",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-free",
    "this software is provided as is without any express or implied warranty": "zlib-asis",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "the origin of this software must not be misrepresented": "zlib-origin",
    "the origin of this software must not be misrepresented you must not claim that you wrote the original software": "zlib-origin",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib-altered",
    "distributed under the boost software license version 1 0": "boost-head",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost-grant",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "wtfpl-copy",
    "you just do what the fuck you want to": "wtfpl-do",
    "you can redistribute it and or modify it under the same terms as perl itself": "perl-terms",
    "it is free software you can redistribute it and or modify it under the same terms as perl itself": "perl-terms",
    "this font software is licensed under the sil open font license version 1 1": "ofl-head",
    "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl": "eupl-head",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-waiver",
    "all rights reserved": "reserved",
    "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document": "apache-body",
    "the gnu general public license is a free copyleft license for software and other kinds of works": "gpl3-body",
    "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software": "agpl3-body",
    "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below": "lgpl3-body",
    "covered software is provided under this license on an as is basis without warranty of any kind either expressed implied or statutory including without limitation warranties that the covered software is free of defects merchantable fit for a particular purpose or non infringing": "mpl-body",
    "the accompanying program is provided under the terms of this eclipse public license agreement": "epl-body",
}
# Headings of licence texts, with the dates that stand there, beside the names themselves.
HEADINGS: dict[str, tuple[str, ...]] = {
    "AFL-3.0": ("academic free license v 3 0",),
    "AGPL-3.0": ("gnu affero general public license version 3 19 november 2007",),
    "Apache-2.0": ("apache license version 2 0 january 2004",),
    "BSL-1.0": ("boost software license version 1 0 august 17th 2003",),
    "CC0-1.0": ("cc0 1 0 universal", "creative commons cc0 1 0 universal"),
    "CDDL-1.0": ("common development and distribution license cddl version 1 0",),
    "EPL-1.0": ("eclipse public license v 1 0",),
    "EPL-2.0": ("eclipse public license v 2 0",),
    "EUPL-1.2": ("european union public licence v 1 2",),
    "GFDL-1.2": ("gnu free documentation license version 1 2 november 2002",),
    "GFDL-1.3": ("gnu free documentation license version 1 3 3 november 2008",),
    "GPL-1.0": ("gnu general public license version 1 february 1989",),
    "GPL-2.0": ("gnu general public license version 2 june 1991",),
    "GPL-3.0": ("gnu general public license version 3 29 june 2007",),
    "LGPL-2.0": ("gnu library general public license version 2 june 1991",),
    "LGPL-2.1": ("gnu lesser general public license version 2 1 february 1999",),
    "LGPL-3.0": ("gnu lesser general public license version 3 29 june 2007",),
    "MS-PL": ("microsoft public license ms pl",),
    "OFL-1.1": ("sil open font license version 1 1 26 february 2007",),
    "OSL-3.0": ("open software license v 3 0",),
    "UPL-1.0": ("the universal permissive license upl version 1 0",),
    "WTFPL": ("do what the fuck you want to public license version 2 december 2004",),
    "ZPL-2.1": ("zope public license zpl version 2 1",),
}
# Whose names clause three of the BSD licence protects.
for _holder in ("copyright holder", "copyright holders", "university", "author", "project", "company", "organization", "foundation", "regents"):
    for _others in ("nor the names of its contributors", "nor the names of their contributors", "nor the names of contributors"):
        SENTENCES[f"neither the name of the {_holder} {_others} may be used to endorse or promote products derived from this software without specific prior written permission"] = "bsd-names"
# The grants of the GNU licences, by licence, version and what they are about.
for _family, _name, _versions in (("GPL", "gnu general public license", ("2", "3")), ("LGPL", "gnu lesser general public license", ("2 1", "3")), ("AGPL", "gnu affero general public license", ("3",))):
    for _of in ("program", "library", "software", "file"):
        for _v in _versions:
            _id = f"{_family.lower()}{_v.replace(' ', '.')}"
            _begin = f"this {_of} is free software you can redistribute it and or modify it under the terms of the {_name}"
            SENTENCES[f"{_begin} as published by the free software foundation either version {_v} of the license or at your option any later version"] = f"{_id}-grant"
            SENTENCES[f"{_begin} version {_v} as published by the free software foundation"] = f"{_id}-only"
            SENTENCES[f"{_begin} as published by the free software foundation version {_v} of the license"] = f"{_id}-only"
        SENTENCES[f"this {_of} is distributed in the hope that it will be useful but without any warranty"] = "gpl-hope"


def plain(identifier: str) -> str:
    return identifier.lower().replace("-", " ").replace(".", " ")


#: All names by which a reference may call a licence, its own identifier among them.
CALLED: dict[str, str] = {}
for _licence, _names in NAMES.items():
    for _s in (_licence, f"{_licence}-only", f"{_licence}-or-later"):
        if _s == _licence or "GPL" in _licence:
            CALLED[plain(_s)] = _s.removesuffix("-only")
    CALLED |= {n: _licence for n in _names}
for _name, _licence in CALLED.items():
    SENTENCES |= {s: f"ref-{_licence}" for lead in LEADS for s in (f"{lead} {_name}", f"{lead} the {_name}") if s not in SENTENCES}
    SENTENCES[f"spdx license identifier {_name}"] = f"ref-{_licence}"
# Licences so short that their own words must follow a heading, which alone says nothing.
SHORT = ("0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "MIT", "NCSA", "PostgreSQL", "X11", "Zlib")
for _licence, _names in ((k, v) for k, v in NAMES.items() if k not in SHORT):
    _whole = [n for n in _names if "licen" in n and len(n) > 8 and " " in n]
    SENTENCES |= {s: f"head-{_licence}" for n in (*_whole, *HEADINGS.get(_licence, ())) for s in (n, f"the {n}") if s not in SENTENCES}

# A licence, and the identifiers that stand for it in this order. Others may lie between them.
RULES: list[tuple[str, list[str]]] = [
    ("0BSD", ["0bsd-grant"]),
    ("Apache-2.0", ["apache-head", "apache-comply", "apache-asis"]),
    ("Artistic-1.0-Perl", ["perl-terms"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names"]),
    ("BSL-1.0", ["boost-grant"]),
    ("BSL-1.0", ["boost-head"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("CDDL-1.0", ["cddl-head"]),
    ("EPL-1.0", ["epl1-head"]),
    ("EPL-2.0", ["epl2-head"]),
    ("EUPL-1.2", ["eupl-head"]),
    ("HPND", ["hpnd-grant"]),
    ("ISC", ["isc-grant"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MPL-1.1", ["mpl11-head"]),
    ("MPL-2.0", ["mpl-head"]),
    ("NCSA", ["ncsa-grant", "ncsa-source"]),
    ("OFL-1.1", ["ofl-head"]),
    ("PostgreSQL", ["postgresql-grant"]),
    ("Unlicense", ["unlicense-head"]),
    ("WTFPL", ["wtfpl-copy", "wtfpl-do"]),
    ("Zlib", ["zlib-asis", "zlib-grant", "zlib-origin"]),
    ("Apache-2.0", ["apache-body"]),
    ("AGPL-3.0", ["agpl3-body"]),
    ("EPL-2.0", ["epl-body"]),
    ("GPL-3.0", ["gpl3-body"]),
    ("LGPL-3.0", ["lgpl3-body"]),
    ("MPL-2.0", ["mpl-body"]),
    ("proprietary", ["reserved"]),
]
for _id in sorted({v for v in SENTENCES.values() if v.endswith(("gpl2-grant", "gpl3-grant", "gpl2.1-grant", "gpl2-only", "gpl3-only", "gpl2.1-only"))}):
    _family, _v = _id.rsplit("-", 1)[0].upper().split("GPL")
    _licence = f"{_family}GPL-{_v if '.' in _v else _v + '.0'}"
    RULES.append((f"{_licence}-or-later", [_id, "gpl-hope"]) if _id.endswith("grant") else (_licence, [_id]))
RULES += [(v.split("-", 1)[1], [v]) for v in sorted(set(SENTENCES.values())) if v.startswith(("ref-", "head-"))]

#: A rule that another rule of more sentences contains gives way to it where both match.
GIVES_WAY = {"BSD-2-Clause": ("BSD-3-Clause", "BSD-4-Clause"), "BSD-3-Clause": ("BSD-4-Clause",)} | {f"{_l}": (f"{_l}-or-later",) for _l in NAMES if "GPL" in _l}
#: What stands above most free licences as well, and so gives way to all others.
LAST = "proprietary"
#: Each sentence holds one of these: a text without them needs no closer look.
ANCHORS = ("licen", "cc0", "released", "covered", "published", "provided", "eclipse", "distribut", "available", "permission", "permitted", "warrant", "reserved", "copyright", "misrepresented", "advertising", "fuck", "perl")
BREAK = r"[.!?;:][\x09-\x0D\x20]+"
#: At the beginning of a sentence: who or what is licensed, before the verb; and behind a reference, where to look.
_VERB = "(?:dual{b})?(?:licensed|released|distributed|available|made{b}available|published|provided|covered){b}(?:under|by){b}"
_BEFORE_VERB = "(?:this|the|our|all)(?:{b}[a-z0-9]+){{1,3}}{b}(?:is|are){b}(?:also{b})?(?=" + _VERB + ")"
_BEFORE_UNDER = "we{b}release{b}(?:this|the|our)(?:{b}[a-z0-9]+){{1,3}}{b}(?=under{b})"
TAIL = "(?:{b}see{b}(?:the{b})?(?:license|licence|copying)(?:{b}file)?(?:{b}for{b}(?:more{b})?(?:details|information))?|{b}at{b}your{b}option)"


def normalised(text: Column) -> Column:
    """Lower case, words parted by one blank; a line end where a line ends, \\x01 where a sentence may end and at both ends."""
    pieces = F.regexp_replace(F.lower(F.translate(text, "\x01", " ")), BREAK, "\x01")
    words = F.regexp_replace(pieces, "[^a-z0-9\n\x01]+", " ")
    lines = F.concat(F.lit("\x01"), F.regexp_replace(words, " ?\n[ \n]*+", "\n"), F.lit("\x01"))
    led = F.regexp_replace(lines, "([\n\x01]) ?(?:" + _BEFORE_UNDER.format(b="[ \n]+") + ")", "$1released ")
    led = F.regexp_replace(led, "([\n\x01]) ?(?:" + _BEFORE_VERB.format(b="[ \n]+") + ")", "$1")
    return F.regexp_replace(led, TAIL.format(b="[ \n]+") + " ?(?=[\n\x01])", "")


def any_of(sentences, gap: str) -> str:
    """A pattern of all sentences, as a tree of their words, so that few of them are tried. The shorter come first."""
    tree: dict = {}
    for sentence in sentences:
        node = tree
        for word in sentence.split(" "):
            node = node.setdefault(word, {})
        node[""] = {}

    def drawn(node: dict) -> str:
        ends, more = "" in node, [w + (drawn(node[w]) if node[w].keys() == {""} else after(node[w])) for w in sorted(node) if w]
        return ("(?:" + "|".join(more) + ")") if len(more) > 1 else more[0] if more else ""

    def after(node: dict) -> str:
        rest = gap + drawn(node)
        return f"(?:|{rest})" if "" in node else rest

    return drawn(tree)


#: Further licences of one reference.
_GAP = "[ \n\x01]++"
CHOICE = f"(?:{_GAP}(?:or|and){_GAP}(?:the{_GAP})?" + any_of(CALLED, _GAP) + "){0,5}"
#: A sentence between ends of lines or sentences, whatever such ends are in it. The shorter are tried first.
KNOWN = "[\n\x01] ?(" + any_of(SENTENCES, _GAP) + CHOICE + ")(?= ?[\n\x01])"
#: A line that is also, but for line ends, all between two ends of sentences counts as both.
BOTH = "\x01 ?(?:\n ?(" + any_of(SENTENCES, " ") + ")[ \n]*+|(" + any_of(SENTENCES, " ") + ") ?\n[ \n]*+)(?=\x01)"


def in_order(ids: Column, sequence: list[str]) -> Column:
    """Whether these identifiers stand in this order, with or without others between them: each is looked for behind the
    first place of the one before, so that no place is tried twice."""
    at = F.array_position(ids, F.lit(sequence[0]))
    if len(sequence) == 1:
        return at > 0
    return let(at, lambda p: (p > 0) & in_order(F.slice(ids, (p + 1).cast("int"), F.size(ids)), sequence[1:]))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the licence sentences of a text in order.

    A sentence begins and ends where a line or a sentence of the text does. It may be wrapped over lines with comment
    marks, have headings before it, and hold colons, semicolons and full stops itself.
    """
    table = F.from_json(F.lit(json.dumps(SENTENCES)), "map<string,string>")  # one constant
    units = F.regexp_replace(normalised(text), BOTH, "\x01$1$2\x01$1$2")
    one = lambda s: F.try_element_at(table, s)

    def each(s: Column) -> Column:
        """One identifier, or those of all licences that a reference names."""
        named = let(F.split(s, " (?:or|and) (?!later|distribution)(?:the )?"), lambda parts: F.transform(parts, lambda p, i: F.when(i == 0, one(p)).otherwise(one(F.concat(F.lit("licensed under "), p)))))
        return let(one(s), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(F.array_compact(named)))

    found = F.flatten(F.transform(F.transform(F.regexp_extract_all(units, F.lit(KNOWN), F.lit(1)), lambda s: F.regexp_replace(s, "[ \n\x01]+", " ")), each))
    anchored = let(F.lower(text), lambda t: functools.reduce(operator.or_, [F.contains(t, F.lit(a)) for a in ANCHORS]))
    return F.when(anchored, found).otherwise(F.array().cast("array<string>"))


def licences(ids: Column) -> Column:
    """The licences whose rules the identifiers of a text match, in order of name."""
    single = F.create_map(*[F.lit(x) for name, sequence in RULES if len(sequence) == 1 for x in (sequence[0], name)])
    several = F.array(*[F.when(in_order(ids, sequence), F.lit(name)) for name, sequence in RULES if len(sequence) > 1])
    names = F.array_distinct(F.array_compact(F.concat(F.transform(ids, lambda i: F.try_element_at(single, i)), several)))

    def settled(names: Column) -> Column:
        less = F.array_compact(F.array(*[F.when(F.arrays_overlap(names, F.array(*map(F.lit, more))), F.lit(name)) for name, more in GIVES_WAY.items()], F.when(F.size(names) > 1, F.lit(LAST))))
        return F.array_sort(F.array_except(names, less))

    return F.when(F.size(ids) == 0, F.array().cast("array<string>")).otherwise(let(names, settled))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentences (identifiers in order, joined by blanks), licenses (sorted, comma-joined) and n_licenses, for every row.

    Null and empty texts, and texts without licence sentences, have "" and 0. Repeated rows give repeated rows; other
    columns are left out; an empty table gives an empty result. A rule matches if its identifiers stand in its order;
    "all rights reserved" counts only where no other rule matches.
    """
    ids = docs.select("doc_id", sentence_ids(F.coalesce("text", F.lit(""))).alias("ids"))
    named = ids.select("doc_id", F.array_join("ids", " ").alias("sentences"), licences(F.col("ids")).alias("names"))
    return named.select("doc_id", "sentences", F.array_join("names", ",").alias("licenses"), F.size("names").cast("long").alias("n_licenses"))


def scan_sql() -> str:
    """The scan in DuckDB's SQL, for sentences that are a line or end with the only full stop, colon or semicolon in them."""
    table = "map {" + ", ".join(f"'{s}': '{i}'" for s, i in SENTENCES.items()) + "}"
    # no look ahead there: what is looked for is put back
    under = _BEFORE_UNDER.format(b=" ").replace("(?=under )", "under ")
    verb = _BEFORE_VERB.format(b=" ").replace("(?=", "(", 1)
    cases: dict[str, str] = {}
    for licence, sequence in RULES:
        test = f"regexp_matches(padded, ' {'(?: .*)? '.join(sequence)} ')"
        cases[licence] = f"{cases[licence]} OR {test}" if licence in cases else test
    met = dict(cases)
    for less, more in GIVES_WAY.items():
        cases[less] = " AND NOT ".join(f"({met[name]})" for name in (less, *more))
    cases[LAST] = f"({cases[LAST]}) AND NOT ({' OR '.join(v for k, v in met.items() if k != LAST)})"
    names = ", ".join(f"CASE WHEN {cases[name]} THEN '{name}' END" for name in sorted(cases))
    return f"""
WITH s AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[\\x09-\\x0D\\x20]+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
b AS (SELECT doc_id, flatten(list_transform(parts, lambda p: CASE WHEN contains(p, chr(10)) THEN list_concat([p], string_split(p, chr(10))) ELSE [p] END)) AS units FROM s),
t AS (SELECT doc_id, list_transform(units, lambda u: trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g')), '^{under}', 'released under '), '^{verb}', '\\1'), '{TAIL.format(b=" ")}$', ''))) AS plain FROM b),
k AS (SELECT doc_id, list_filter(plain, lambda u: map_contains({table}, u)) AS known FROM t),
i AS (SELECT doc_id, array_to_string(list_transform(known, lambda u: element_at({table}, u)[1]), ' ') AS sentences FROM k),
p AS (SELECT doc_id, sentences, ' ' || sentences || ' ' AS padded FROM i),
n AS (SELECT doc_id, sentences, list_filter([{names}], lambda x: x IS NOT NULL) AS names FROM p WHERE sentences <> ''
  UNION ALL SELECT doc_id, sentences, []::VARCHAR[] FROM p WHERE coalesce(sentences, '') = '')
SELECT doc_id, coalesce(sentences, '') AS sentences, array_to_string(names, ',') AS licenses, CAST(len(names) AS BIGINT) AS n_licenses FROM n"""
