"""License scans with ordered signature rules.

Each rule is a regular expression with a label, a priority and keywords. One Aho-Corasick pass over the lower-cased text
finds the keywords; only rules whose keyword occurs run. Overlapping detections are resolved by priority (smaller first)
and then length: a detection whose interval lies inside one already accepted is suppressed, so "gpl" inside "lgpl
version 2.1" or a name inside an SPDX tag gives one detection.

Rules of three kinds, a few hundred: signatures of the license texts and notices themselves, written one by one
(SIGNATURES); statements without a family (PLAIN); and names, written per license family with their versions and
identifier (FAMILIES), for each form of statement (identifier tag, grant, full name, link, file mention).

Base phrases are places where given words stand consecutively; their labels are always reported.

Nulls: a null text is empty: no words, no labels, score 0; a null doc_id stays null. Repeated rows are scanned each. An
empty table gives no row. Other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .util import lower_ascii, pieces, text_column

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label: (identifier without version, names as patterns, versions, links). Public license names.
FAMILIES = {
    "agpl": ("agpl", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[sc]e", ("1.0", "3.0"), "gnu.org/licenses/agpl"),
    "lgpl": ("lgpl", r"(?:gnu\s+)?(?:lesser|library)\s+general\s+public\s+licen[sc]e", ("2.0", "2.1", "3.0"), "gnu.org/licenses/lgpl"),
    "gpl": ("gpl", r"(?:gnu\s+)?general\s+public\s+licen[sc]e", ("1.0", "2.0", "3.0"), "gnu.org/licenses/gpl"),
    "gfdl": ("gfdl", r"(?:gnu\s+)?free\s+documentation\s+licen[sc]e", ("1.1", "1.2", "1.3"), "gnu.org/licenses/fdl"),
    "apache": ("apache", r"apache\s+(?:software\s+)?licen[sc]e", ("1.0", "1.1", "2.0"), "apache.org/licenses"),
    "mit": ("mit", r"(?:mit|expat|x11)\s+licen[sc]e", (), "opensource.org/licenses/mit"),
    "bsd": ("bsd", r"(?:new\s+|simplified\s+|modified\s+)?bsd\s+licen[sc]e", ("2-clause", "3-clause", "4-clause"), "opensource.org/licenses/bsd"),
    "mpl": ("mpl", r"mozilla\s+public\s+licen[sc]e", ("1.0", "1.1", "2.0"), "mozilla.org/mpl"),
    "epl": ("epl", r"eclipse\s+public\s+licen[sc]e", ("1.0", "2.0"), "eclipse.org/legal/epl"),
    "cddl": ("cddl", r"common\s+development\s+and\s+distribution\s+licen[sc]e", ("1.0", "1.1"), "opensource.org/licenses/cddl"),
    "cpl": ("cpl", r"common\s+public\s+licen[sc]e", ("1.0",), "opensource.org/licenses/cpl"),
    "eupl": ("eupl", r"european\s+union\s+public\s+licen[sc]e", ("1.0", "1.1", "1.2"), "joinup.ec.europa.eu/collection/eupl"),
    "isc": ("isc", r"isc\s+licen[sc]e", (), "opensource.org/licenses/isc"),
    "zlib": ("zlib", r"zlib(?:/libpng)?\s+licen[sc]e", (), "opensource.org/licenses/zlib"),
    "artistic": ("artistic", r"artistic\s+licen[sc]e", ("1.0", "2.0"), "opensource.org/licenses/artistic"),
    "boost": ("bsl", r"boost\s+software\s+licen[sc]e", ("1.0",), "boost.org/license_1_0"),
    "unlicense": ("unlicense", r"(?:the\s+)?unlicense", (), "unlicense.org"),
    "wtfpl": ("wtfpl", r"do\s+what\s+the\s+fuck\s+you\s+want\s+to\s+public\s+licen[sc]e", ("2.0",), "wtfpl.net"),
    "ofl": ("ofl", r"(?:sil\s+)?open\s+font\s+licen[sc]e", ("1.0", "1.1"), "scripts.sil.org/ofl"),
    "odbl": ("odbl", r"open\s+(?:data\s+commons\s+)?(?:open\s+)?database\s+licen[sc]e", ("1.0",), "opendatacommons.org/licenses/odbl"),
    "python": ("psf", r"python\s+software\s+foundation\s+licen[sc]e", ("2.0",), "docs.python.org/license"),
    "cc0": ("cc0", r"cc0|creative\s+commons\s+zero", ("1.0",), "creativecommons.org/publicdomain/zero"),
    "cc-by-nc-nd": ("cc-by-nc-nd", r"(?:cc|creative\s+commons)[\s-]+(?:by|attribution)[\s-]+(?:nc|noncommercial|non-commercial)[\s-]+(?:nd|noderivatives|noderivs)", ("2.0", "2.5", "3.0", "4.0"), "creativecommons.org/licenses/by-nc-nd"),
    "cc-by-nc-sa": ("cc-by-nc-sa", r"(?:cc|creative\s+commons)[\s-]+(?:by|attribution)[\s-]+(?:nc|noncommercial|non-commercial)[\s-]+(?:sa|sharealike|share-alike)", ("2.0", "2.5", "3.0", "4.0"), "creativecommons.org/licenses/by-nc-sa"),
    "cc-by-nc": ("cc-by-nc", r"(?:cc|creative\s+commons)[\s-]+(?:by|attribution)[\s-]+(?:nc|noncommercial|non-commercial)", ("2.0", "2.5", "3.0", "4.0"), "creativecommons.org/licenses/by-nc/"),
    "cc-by-nd": ("cc-by-nd", r"(?:cc|creative\s+commons)[\s-]+(?:by|attribution)[\s-]+(?:nd|noderivatives|noderivs)", ("2.0", "2.5", "3.0", "4.0"), "creativecommons.org/licenses/by-nd"),
    "cc-by-sa": ("cc-by-sa", r"(?:cc|creative\s+commons)[\s-]+(?:by|attribution)[\s-]+(?:sa|sharealike|share-alike)", ("2.0", "2.5", "3.0", "4.0"), "creativecommons.org/licenses/by-sa"),
    "cc-by": ("cc-by", r"(?:cc|creative\s+commons)[\s-]+(?:by|attribution)", ("2.0", "2.5", "3.0", "4.0"), "creativecommons.org/licenses/by/"),
}
#: Words of a name by which its rules are gated, single ones, as blanks of a text may be wrapped. Fixed values, read with FAMILIES.
GATES = {
    "agpl": "affero", "lgpl": "general", "gpl": "general", "gfdl": "documentation", "apache": "apache", "mit": "mit\texpat\tx11", "bsd": "bsd", "mpl": "mozilla", "epl": "eclipse", "cddl": "development",
    "cpl": "common", "eupl": "european", "isc": "isc", "zlib": "zlib", "artistic": "artistic", "boost": "boost", "unlicense": "unlicense", "wtfpl": "fuck", "ofl": "font", "odbl": "database", "python": "python", "cc0": "cc0\tzero",
}
#: Statements without a family: label, pattern, keyword, score.
PLAIN = [
    ("all-rights-reserved", r"\ball\s+rights\s+reserved\b", "rights", 0.6),
    ("public-domain", r"\b(?:released|dedicated|placed)\s+(?:in|in?to)\s+the\s+public\s+domain\b", "public", 0.9),
    ("copyright", r"(?:\bcopyright\b|\(c\)|©)\s*+(?:(?:\(c\)|©)\s*+)?(?:19|20)\d\d\b", "copyright\t(c)\t©", 0.5),
    ("proprietary", r"\bproprietary\s+and\s+confidential\b", "proprietary", 0.8),
    ("permissive-grant", r"\bpermission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge\b", "permission", 0.9),
    ("redistribution", r"\bredistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms\b", "redistribution", 0.9),
    ("as-is", r"\bprovided\s+[\"“]?as[\s-]+is[\"”]?,?\s+without\s+warranty\b", "warranty", 0.4),
]


#: Signatures of license texts and of the notices that go with them: label, pattern, keyword, score. A blank stands for
#: white space and the marks that begin lines of a comment. Wording of the public licenses.
SIGNATURES = [
    ("mit", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of this software and associated documentation files", "associated", 0.95),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial", 0.9),
    ("mit", r"to deal in the software without restriction,? including without limitation the rights to use,? copy,? modify,? merge", "merge", 0.85),
    ("mit-0", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of this software .{0,400}?subject to no further conditions", "further", 0.6),
    ("x11", r"except as contained in this notice,? the name of .{1,80}? shall not be used in advertising or otherwise to promote", "advertising", 0.85),
    ("isc", r"permission to use,? copy,? modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted", "fee", 0.95),
    ("0bsd", r"permission to use,? copy,? modify,? and/or distribute this software for any purpose with or without fee is hereby granted\. the software is provided", "fee", 0.9),
    ("bsd", r"redistributions of source code must retain the above copyright notice,? this list of conditions and the following disclaimer", "redistributions", 0.9),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice,? this list of conditions and the following disclaimer", "redistributions", 0.9),
    ("bsd-3-clause", r"neither the names? of .{1,120}? nor the names of (?:its|their|any) contributors may be used to endorse or promote products", "endorse", 0.95),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising", 0.95),
    ("bsd-2-clause", r"the views and conclusions contained in the software and documentation are those of the authors", "conclusions", 0.85),
    ("gpl", r"this program is free software[;:,]? you can redistribute it and/or modify it under the terms of the gnu general public license", "redistribute", 0.95),
    ("gpl-2.0", r"either version 2 of the license,? or \(at your option\) any later version", "option", 0.85),
    ("gpl-3.0", r"either version 3 of the license,? or \(at your option\) any later version", "option", 0.85),
    ("gpl", r"you should have received a copy of the gnu general public license along with this program", "received", 0.9),
    ("gpl", r"the gnu general public license is a free,? copyleft license for software and other kinds of works", "copyleft", 0.95),
    ("gpl-2.0", r"the licenses for most software are designed to take away your freedom to share and change it", "freedom", 0.9),
    ("gpl-3.0", r"the licenses for most software and other practical works are designed to take away your freedom", "freedom", 0.95),
    ("gpl", r"this program is distributed in the hope that it will be useful,? but without any warranty", "hope", 0.8),
    ("lgpl", r"this library is free software[;:,]? you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license", "redistribute", 0.95),
    ("lgpl-2.1", r"either version 2\.1 of the license,? or \(at your option\) any later version", "option", 0.9),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this library", "received", 0.9),
    ("lgpl-3.0", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3", "incorporates", 0.95),
    ("agpl", r"you should have received a copy of the gnu affero general public license along with this program", "received", 0.95),
    ("agpl-3.0", r"your modified version must prominently offer all users interacting with it remotely through a computer network", "remotely", 0.95),
    ("agpl", r"the gnu affero general public license is a free,? copyleft license for software and other kinds of works,? specifically designed", "copyleft", 0.95),
    ("gpl-classpath-exception", r"as a special exception,? the copyright holders of this library give you permission to link this library with independent modules", "exception", 0.9),
    ("gpl-font-exception", r"as a special exception,? if you create a document which uses this font,? and embed this font", "exception", 0.9),
    ("gfdl", r"permission is granted to copy,? distribute and/or modify this document under the terms of the gnu free documentation license", "document", 0.95),
    ("gfdl", r"with no invariant sections,? (?:with )?no front-cover texts,? and (?:with )?no back-cover texts", "invariant", 0.85),
    ("apache-2.0", r"licensed under the apache license,? version 2\.0 \(the [\"“”']?license[\"“”']?\)[;,]? you may not use this file except in compliance", "compliance", 0.98),
    ("apache-2.0", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements", "contributor", 0.95),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing,? software distributed under the license is distributed on an [\"“”']?as is[\"“”']? basis", "applicable", 0.85),
    ("apache-2.0", r"each contributor hereby grants to you a perpetual,? worldwide,? non-exclusive,? no-charge,? royalty-free,? irrevocable (?:copyright|\(except as stated in this section\) patent) license", "irrevocable", 0.95),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "developed", 0.8),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license,? v\. 2\.0", "mozilla", 0.98),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1\.1", "mozilla", 0.98),
    ("mpl-2.0", r"incompatible with secondary licenses,? as defined by the mozilla public license", "secondary", 0.9),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license", "accompanying", 0.95),
    ("epl", r"the accompanying program is provided under the terms of this eclipse public license", "accompanying", 0.95),
    ("cpl-1.0", r"the accompanying program is provided under the terms of this common public license", "accompanying", 0.95),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", "development", 0.95),
    ("cddl", r"when distributing covered code,? include this cddl header in each file", "cddl", 0.9),
    ("eupl", r"licensed under the eupl,? version 1\.[0-9]", "eupl", 0.95),
    ("zlib", r"this software is provided [\"“”']?as-is[\"“”']?,? without any express or implied warranty\. in no event will the authors be held liable", "held", 0.9),
    ("zlib", r"altered source versions must be plainly marked as such,? and must not be misrepresented", "altered", 0.9),
    ("zlib", r"the origin of this software must not be misrepresented", "misrepresented", 0.85),
    ("boost-1.0", r"permission is hereby granted,? free of charge,? to any person or organization obtaining a copy of the software and accompanying documentation", "accompanying", 0.95),
    ("boost-1.0", r"distributed under the boost software license,? version 1\.0", "boost", 0.98),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 0.98),
    ("unlicense", r"anyone is free to copy,? modify,? publish,? use,? compile,? sell,? or distribute this software", "compile", 0.9),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document,? and changing it is allowed as long as the name is changed", "verbatim", 0.9),
    ("ofl-1.1", r"this font software is licensed under the sil open font license,? version 1\.1", "font", 0.98),
    ("ofl", r"the fonts and derivatives,? however,? cannot be released under any other type of license", "derivatives", 0.85),
    ("artistic-2.0", r"you may distribute your modified version as source \(either gratis or for a distributor fee", "gratis", 0.85),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied", "intent", 0.9),
    ("perl", r"you can redistribute it and/or modify it under the same terms as perl itself", "perl", 0.9),
    ("python-2.0", r"this license agreement is between the python software foundation \([\"“”']?psf[\"“”']?\)", "python", 0.95),
    ("ruby", r"you (?:can|may) redistribute it and/or modify it under either the terms of the (?:2-clause )?bsdl?", "redistribute", 0.8),
    ("php-3.01", r"this source file is subject to version 3\.01 of the php license", "php", 0.95),
    ("php", r"this product includes php(?: software)?,? freely available from", "php", 0.85),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", "openssl", 0.95),
    ("ncsa", r"permission is hereby granted,? free of charge.{0,200}?to deal with the software without restriction", "deal", 0.7),
    ("postgresql", r"permission to use,? copy,? modify,? and distribute this software and its documentation for any purpose,? without fee,? and without a written agreement", "written", 0.95),
    ("hpnd", r"permission to use,? copy,? modify,? and distribute this software and its documentation for any purpose and without fee is hereby granted,? provided", "fee", 0.85),
    ("curl", r"permission to use,? copy,? modify,? and distribute this software for any purpose with or without fee is hereby granted,? provided that the above copyright notice", "fee", 0.85),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", "jpeg", 0.95),
    ("libpng", r"the png reference library is supplied [\"“”']?as is", "png", 0.9),
    ("ftl", r"portions of this software are copyright .{0,40}? the freetype project", "freetype", 0.9),
    ("unicode", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of (?:the )?(?:unicode )?data files", "data", 0.9),
    ("w3c", r"this (?:software|work) .{0,60}?is being provided by the copyright holders under the following license", "holders", 0.8),
    ("vim", r"you must make your changes available to the maintainer .{0,80}?vim", "maintainer", 0.7),
    ("json", r"the software shall be used for good,? not evil", "evil", 0.98),
    ("beerware", r"if we meet some day,? and you think this stuff is worth it,? you can buy me a beer", "beer", 0.98),
    ("ms-pl", r"this license governs use of the accompanying software\. if you use the software,? you accept this license", "governs", 0.9),
    ("bsl", r"the licensor hereby grants you the right to copy,? modify,? create derivative works,? redistribute,? and make non-production use of the licensed work", "licensor", 0.95),
    ("sspl", r"if you make the functionality of the program or a modified version available to third parties as a service", "functionality", 0.95),
    ("elastic", r"you may not provide the (?:software|products) to third parties as a hosted or managed service", "hosted", 0.95),
    ("commons-clause", r"the grant of rights under the license will not include,? and the license does not grant to you,? the right to sell the software", "grant", 0.95),
    ("cc-by-4.0", r"creative commons attribution 4\.0 international public license", "creative", 0.95),
    ("cc-by-sa-4.0", r"creative commons attribution-sharealike 4\.0 international public license", "creative", 0.95),
    ("cc-by-nc-4.0", r"creative commons attribution-noncommercial 4\.0 international public license", "creative", 0.95),
    ("cc0-1.0", r"the person who associated a work with this deed has dedicated the work to the public domain", "deed", 0.95),
    ("cc0-1.0", r"affirmer hereby overtly,? fully,? permanently,? irrevocably and unconditionally waives", "affirmer", 0.95),
    ("cc-by", r"this work is licensed under a creative commons attribution", "creative", 0.9),
    ("cc-by-sa", r"text (?:of this page )?is available under the creative commons attribution-sharealike license", "creative", 0.9),
    ("odbl-1.0", r"this .{1,60}? is made available under the open database license", "database", 0.95),
    ("odc-by", r"made available under the open data commons attribution license", "commons", 0.95),
    ("pddl", r"made available under the public domain dedication and license", "dedication", 0.95),
    ("ogl-uk", r"contains public sector information licensed under the open government licence", "sector", 0.95),
    ("llama", r"(?:llama|meta) .{0,20}?community license", "community", 0.7),
    ("openrail", r"use-based restrictions as referenced in paragraph [0-9]", "restrictions", 0.85),
    ("no-derivatives", r"no part of this (?:publication|book|work|document) may be reproduced,? stored in a retrieval system,? or transmitted", "reproduced", 0.8),
    ("no-redistribution", r"(?:may not|must not|cannot) be (?:reproduced|redistributed|republished|rewritten)(?:,? or (?:reproduced|redistributed|republished))? without (?:the )?(?:prior |express |written )*(?:permission|consent)", "without", 0.75),
    ("non-commercial", r"for (?:personal|private|educational|academic),? (?:and |or )?non-?commercial use only", "use", 0.75),
]
#: What a blank of SIGNATURES stands for.
GAP = r"[\s*#/;>|%-]+"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    score: float
    keywords: tuple[str, ...]
    pattern: re.Pattern


def build_rules() -> list[Rule]:
    """All rules in order of priority: the forms that say most come first, and versions before bare names."""
    out = []
    for label, (ident, name, versions, link) in FAMILIES.items():
        name, gate = f"(?:{name})", tuple(GATES.get(label, "cc\tcreative").split("\t"))
        number = [(v, re.escape(v.removesuffix(".0")) + r"(?:\.0)?(?![\d.]*\d)" if v[-1].isdigit() else re.escape(v).replace("\\-", r"[\s-]")) for v in versions]
        joined = r",?\s*+(?:(?:-|version|v\.?)\s*+)?"  # no blank can be taken by either, so a long run is gone through once
        for v, pattern in number:
            one = f"{label}-{v}"
            out += [
                Rule(one, 10, 1.0, ("spdx",), re.compile(rf"spdx-license-identifier:\s*{re.escape(ident)}-{pattern}(?:-only|-or-later|\+)?")),
                Rule(one, 20, 0.95, gate, re.compile(rf"\b(?:licensed|released|distributed|available|published)\s+under\s+(?:the\s+)?(?:terms\s+of\s+the\s+)?{name}{joined}{pattern}")),
                Rule(one, 30, 0.9, gate, re.compile(rf"\b{name}{joined}{pattern}")),
                Rule(one, 50, 0.7, (ident,), re.compile(rf"\b{re.escape(ident)}[\s-]*v?{pattern}")),
            ]
        out += [
            Rule(label, 11, 1.0, ("spdx",), re.compile(rf"spdx-license-identifier:\s*{re.escape(ident)}\b(?!-)")),
            Rule(label, 25, 0.9, gate, re.compile(rf"\b(?:licensed|released|distributed|available|published)\s+under\s+(?:the\s+|an?\s+)?(?:terms\s+of\s+the\s+)?{name}\b")),
            Rule(label, 40, 0.8, gate, re.compile(rf"\b{name}\b")),
            Rule(label, 45, 0.85, (link,), re.compile(re.escape(link))),
            Rule(label, 60, 0.6, (ident,), re.compile(rf"\b(?:under|licen[sc]e:)\s+(?:the\s+)?{re.escape(ident)}\b")),
        ]
    out += [Rule(label, 35, score, (gate,), re.compile(rf"\b{p.replace(' ', GAP)}", re.DOTALL)) for label, p, gate, score in SIGNATURES]
    out += [Rule(label, 70, score, tuple(gate.split("\t")), re.compile(p)) for label, p, gate, score in PLAIN]
    return sorted(out, key=lambda r: r.priority)


class Scanner:
    def __init__(self, rules: list[Rule] | None = None):
        import ahocorasick

        self.rules = build_rules() if rules is None else rules
        by: dict[str, set[int]] = {}
        for k, r in enumerate(self.rules):
            for w in r.keywords:
                by.setdefault(w, set()).add(k)
        self.gates = ahocorasick.Automaton()
        for w, ks in by.items():
            self.gates.add_word(w, frozenset(ks))
        self.gates.make_automaton()
        self.base = {tuple(p.split(" ")): label for p, label in BASE.items()}

    def detections(self, lower: str) -> list[tuple[int, int, Rule]]:
        """Accepted (begin, end, rule) in reading order; intervals inside an accepted one are suppressed."""
        gated = {k for _, ks in self.gates.iter(lower) for k in ks}
        found = [(r.priority, m.start() - m.end(), m.start(), m.end(), k) for k in sorted(gated) for r in [self.rules[k]] for m in r.pattern.finditer(lower)]
        starts = sorted({x[2] for x in found})
        at, reach = {b: i for i, b in enumerate(starts, 1)}, [0] * (len(starts) + 1)  # reach: a Fenwick tree over starts of the largest end accepted
        taken: list[tuple[int, int, Rule]] = []
        for _, _, b, e, k in sorted(found):
            i, furthest = at[b], 0
            while i:
                furthest = max(furthest, reach[i])
                i &= i - 1
            if furthest >= e:
                continue
            taken.append((b, e, self.rules[k]))
            i = at[b]
            while i <= len(starts):
                reach[i] = max(reach[i], e)
                i += i & -i
        return sorted(taken, key=lambda x: x[:2])

    def scan(self, text: str) -> tuple:
        lower = lower_ascii(text)
        n_words = len(WORDS.findall(lower))
        places, labels = [], set()
        for phrase, label in self.base.items():
            if phrase[-1] not in lower or phrase[0] not in lower:
                continue
            words = WORDS.findall(lower)
            last = len(words) - len(phrase)
            hits, at = [], -1
            while True:
                try:
                    at = words.index(phrase[0], at + 1)
                except ValueError:
                    break
                if at <= last and tuple(words[at : at + len(phrase)]) == phrase:
                    hits.append(at)
            if hits:
                places += hits
                labels.add(label)
        found = self.detections(lower)
        every = labels | {r.label for _, _, r in found}
        score = max([r.score for _, _, r in found] + [0.8] * bool(places), default=0.0)
        spans = [{"begin": b, "end": e, "label": r.label, "priority": r.priority} for b, e, r in found]
        return n_words, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score, spans


SCANS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<begin:long,end:long,label:string,priority:long>>"
_SCANNER: list[Scanner] = []


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row of SCANS for each of ``docs(doc_id, text)``; spans are characters of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int64())]))]
        for b in pieces(batches, "text"):
            rows = [_SCANNER[0].scan(t) for t in text_column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], names=[x.split()[0] for x in SCANS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCANS)
