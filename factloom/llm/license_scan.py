"""License scan: ordered signature rules over normalised words, gated by keywords, with overlaps suppressed.

A text is reduced to its words (A-Z lowered; letters, digits and anything outside ASCII), joined by single spaces. Rules
are regular expressions over that form, written below as license names with their wordings and as sentence frames that
take a name. Each rule has a keyword that every match of it holds; a rule runs only on texts that hold its keyword. A detection is suppressed if a
detection of higher priority, or an equal one that is longer or declared earlier, spans all its words.

The base phrases (MIT, Apache, GPL) are found by a plain scan for consecutive words and always count.

Defined results: null or empty text has no words, no detections, labels '' and score 0; repeated documents are scanned
one by one; only the id and text columns are read, so other columns can't clash; any length of text is scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import alnum_words, prepare, table

#: Phrases of the base labels.
BASE = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))
#: label, SPDX-style identifiers, name wordings; every wording is a regular expression over normalised words.
LICENSES = (
    ("mit", ("mit",), ("mit(?: x11)? licen[sc]e", "massachusetts institute of technology licen[sc]e", "expat licen[sc]e")),
    ("mit-0", ("mit 0",), ("mit no attribution licen[sc]e",)),
    ("apache-2.0", ("apache 2 0",), ("apache(?: software)? licen[sc]e(?: version)? 2(?: 0)?", "asl 2 0")),
    ("apache-1.1", ("apache 1 1",), ("apache(?: software)? licen[sc]e(?: version)? 1 1",)),
    ("gpl-1.0", ("gpl 1 0(?: only| or later)?",), ("(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version)? 1(?: 0)?", "gpl ?v1")),
    ("gpl-2.0", ("gpl 2 0(?: only| or later)?",), ("(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version)? 2(?: 0)?", "gpl ?v2")),
    ("gpl-3.0", ("gpl 3 0(?: only| or later)?",), ("(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version)? 3(?: 0)?", "gpl ?v3")),
    ("lgpl-2.0", ("lgpl 2 0(?: only| or later)?",), ("(?:gnu )?(?:lesser|library) general public licen[sc]e(?: version)? 2(?: 0)?",)),
    ("lgpl-2.1", ("lgpl 2 1(?: only| or later)?",), ("(?:gnu )?lesser general public licen[sc]e(?: version)? 2 1",)),
    ("lgpl-3.0", ("lgpl 3 0(?: only| or later)?",), ("(?:gnu )?lesser general public licen[sc]e(?: version)? 3(?: 0)?",)),
    ("agpl-3.0", ("agpl 3 0(?: only| or later)?",), ("(?:gnu )?affero general public licen[sc]e(?: version)?(?: 3)?(?: 0)?",)),
    ("gfdl", ("gfdl 1 [123](?: only| or later)?",), ("(?:gnu )?free documentation licen[sc]e",)),
    ("bsd-2-clause", ("bsd 2 clause",), ("(?:2|two) clause bsd licen[sc]e", "simplified bsd licen[sc]e", "freebsd licen[sc]e")),
    ("bsd-3-clause", ("bsd 3 clause",), ("(?:3|three) clause bsd licen[sc]e", "(?:modified|revised|new) bsd licen[sc]e")),
    ("bsd-4-clause", ("bsd 4 clause",), ("(?:4|four) clause bsd licen[sc]e", "original bsd licen[sc]e")),
    ("bsd", ("0bsd",), ("bsd licen[sc]e", "berkeley software distribution licen[sc]e")),
    ("isc", ("isc",), ("isc licen[sc]e", "internet systems consortium licen[sc]e")),
    ("mpl-1.1", ("mpl 1 1",), ("mozilla public licen[sc]e(?: version)? 1 1",)),
    ("mpl-2.0", ("mpl 2 0",), ("mozilla public licen[sc]e(?: version)?(?: 2 0)?",)),
    ("epl-1.0", ("epl 1 0",), ("eclipse public licen[sc]e(?: version)?(?: v)? 1(?: 0)?",)),
    ("epl-2.0", ("epl 2 0",), ("eclipse public licen[sc]e(?: version)?(?: v)? 2(?: 0)?",)),
    ("cddl-1.0", ("cddl 1 [01]",), ("common development and distribution licen[sc]e",)),
    ("cpl-1.0", ("cpl 1 0",), ("common public licen[sc]e",)),
    ("eupl", ("eupl 1 [012]",), ("european union public licen[sc]e",)),
    ("artistic", ("artistic [12] 0",), ("(?:perl )?artistic licen[sc]e(?: version)?(?: [12] 0)?",)),
    ("bsl-1.0", ("bsl 1 0",), ("boost software licen[sc]e",)),
    ("busl", ("busl 1 1",), ("business source licen[sc]e",)),
    ("sspl", ("sspl 1 0",), ("server side public licen[sc]e",)),
    ("elastic", ("elastic 2 0",), ("elastic licen[sc]e(?: 2 0)?",)),
    ("zlib", ("zlib",), ("zlib(?: libpng)? licen[sc]e",)),
    ("libpng", ("libpng",), ("libpng licen[sc]e",)),
    ("openssl", ("openssl",), ("openssl licen[sc]e",)),
    ("python", ("psf 2 0", "python 2 0"), ("python software foundation licen[sc]e",)),
    ("php", ("php 3 0[01]?",), ("php licen[sc]e(?: version)?(?: 3 0[01]?)?",)),
    ("ruby", ("ruby",), ("ruby licen[sc]e",)),
    ("unlicense", ("unlicense",), ("the unlicense", "this is free and unencumbered software released into the public domain")),
    ("wtfpl", ("wtfpl",), ("do what the fuck you want to public licen[sc]e",)),
    ("cc0-1.0", ("cc0 1 0",), ("cc0 1 0 universal", "creative commons(?: zero| cc0)(?: 1 0)?")),
    ("cc-by", ("cc by [1234] [05]",), ("(?:creative commons|cc)(?: by)? attribution(?: [1234] [05])?(?: international| unported)?(?: licen[sc]e)?", "cc by [1234] [05]")),
    ("cc-by-sa", ("cc by sa [1234] [05]",), ("(?:creative commons|cc) attribution share ?alike(?: [1234] [05])?(?: international| unported)?(?: licen[sc]e)?", "cc by sa [1234] [05]")),
    ("cc-by-nc", ("cc by nc [1234] [05]",), ("(?:creative commons|cc) attribution non ?commercial(?: [1234] [05])?", "cc by nc [1234] [05]")),
    ("cc-by-nc-sa", ("cc by nc sa [1234] [05]",), ("(?:creative commons|cc) attribution non ?commercial share ?alike", "cc by nc sa [1234] [05]")),
    ("cc-by-nd", ("cc by nd [1234] [05]",), ("(?:creative commons|cc) attribution no ?deriv(?:s|atives)", "cc by nd [1234] [05]")),
    ("cc-by-nc-nd", ("cc by nc nd [1234] [05]",), ("(?:creative commons|cc) attribution non ?commercial no ?deriv(?:s|atives)", "cc by nc nd [1234] [05]")),
    ("cc", (), ("creative commons licen[sc]e",)),
    ("odbl", ("odbl 1 0",), ("open (?:data commons open )?database licen[sc]e",)),
    ("odc-by", ("odc by 1 0",), ("open data commons attribution licen[sc]e",)),
    ("pddl", ("pddl 1 0",), ("public domain dedication and licen[sc]e",)),
    ("ofl", ("ofl 1 [01]",), ("sil open font licen[sc]e", "open font licen[sc]e")),
    ("ms-pl", ("ms pl",), ("microsoft public licen[sc]e",)),
    ("ms-rl", ("ms rl",), ("microsoft reciprocal licen[sc]e",)),
    ("afl", ("afl [123] [01]",), ("academic free licen[sc]e",)),
    ("osl", ("osl [123] [01]",), ("open software licen[sc]e",)),
    ("ncsa", ("ncsa",), ("university of illinois(?: ncsa)? open source licen[sc]e",)),
    ("upl", ("upl 1 0",), ("universal permissive licen[sc]e",)),
    ("vim", ("vim",), ("vim licen[sc]e",)),
    ("w3c", ("w3c",), ("w3c software(?: notice and)? licen[sc]e",)),
    ("x11", ("x11",), ("x11 licen[sc]e", "x consortium licen[sc]e")),
    ("qpl", ("qpl 1 0",), ("q public licen[sc]e",)),
    ("lppl", ("lppl 1 [0123][ac]?",), ("latex project public licen[sc]e",)),
    ("postgresql", ("postgresql",), ("postgresql licen[sc]e",)),
    ("beerware", ("beerware",), ("beerware licen[sc]e", "the beer ware licen[sc]e")),
    ("openrail", ("openrail",), ("(?:creativeml )?open ?rail(?: m)? licen[sc]e", "responsible ai licen[sc]e")),
    ("llama", ("llama",), ("llama(?: [234])?(?: [0-9])? community licen[sc]e",)),
)

#: priority, score, sentence frame around a name wording; the keyword all of them need is that of the name.
FRAMES = (
    (3, 0.95, "(?:is |are |was |been )?(?:re ?)?licen[sc]ed under (?:the |a )?(?:terms of the )?{}"),
    (3, 0.95, "(?:distributed|released|available|published|provided|made available) under (?:the |a )?(?:terms of the )?{}"),
    (3, 0.9, "(?:subject to|under) the terms (?:and conditions )?of the {}"),
    (2, 0.85, "{}"),
)

#: label, priority, score, keyword, regular expression: passages of license texts and notices.
PASSAGES = (
    ("mit", 4, 0.95, "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", 4, 0.9, "permission to use copy", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 4, 0.85, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 5, 0.9, "neither the name of", "neither the name of (?:\\S+ ){1,12}may be used to endorse or promote products derived"),
    ("gpl", 4, 0.9, "you can redistribute it", "you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl", 4, 0.8, "implied warranty", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("public-domain", 3, 0.8, "public domain", "(?:dedicated|released|placed|published) (?:in|into|to) the public domain"),
    ("public-domain", 1, 0.5, "public domain", "(?:is|are) in the public domain"),
    ("proprietary", 2, 0.7, "all rights reserved", "all rights reserved"),
    ("proprietary", 3, 0.8, "licen", "proprietary licen[sc]e"),
    ("commercial", 2, 0.6, "licen", "commercial licen[sc]e"),
    ("copyleft", 1, 0.4, "copyleft", "copyleft"),
    ("copyright-notice", 1, 0.4, "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}"),
    ("mit", 4, 0.8, "shall be included in all copies", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 3, 0.6, "sublicense and or sell copies", "to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit-0", 4, 0.8, "to whom the software is furnished to do so", "permit persons to whom the software is furnished to do so the software is provided"),
    ("permissive", 2, 0.5, "without warranty of any kind", "the software is provided as is without warranty of any kind express or implied"),
    ("permissive", 2, 0.5, "liable for any claim damages", "in no event shall the (?:authors?|copyright holders?|authors or copyright holders) be liable for any claim damages or other liability"),
    ("isc", 4, 0.7, "disclaims all warranties with regard to this software", "the author disclaims all warranties with regard to this software"),
    ("0bsd", 4, 0.8, "for any purpose with or without fee", "use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software"),
    ("bsd", 4, 0.8, "must retain the above copyright notice", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 4, 0.8, "must reproduce the above copyright notice", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-4-clause", 5, 0.9, "mentioning features or use of this software", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("bsd", 3, 0.6, "by the copyright holders and contributors as is", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("apache-1.1", 4, 0.8, "developed by the apache software foundation", "this product includes software developed by the apache software foundation"),
    ("apache-2.0", 5, 0.95, "licensed under the apache license version 2 0 the license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", 4, 0.7, "not use this file except in compliance with the license", "you may not use this file except in compliance with the license"),
    ("apache-2.0", 4, 0.7, "unless required by applicable law or agreed to in writing", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", 4, 0.8, "grant of patent license", "grant of patent license subject to the terms and conditions of this license each contributor hereby grants"),
    ("apache-2.0", 4, 0.8, "grant of copyright license", "grant of copyright license subject to the terms and conditions of this license each contributor hereby grants"),
    ("gpl", 4, 0.85, "free software you can redistribute it", "this (?:program|library|file|package) is free software you can redistribute it"),
    ("gpl", 4, 0.8, "should have received a copy of the gnu", "you should have received a copy of the gnu general public license"),
    ("lgpl", 5, 0.85, "should have received a copy of the gnu lesser", "you should have received a copy of the gnu lesser general public license"),
    ("lgpl", 5, 0.85, "should have received a copy of the gnu library", "you should have received a copy of the gnu library general public license"),
    ("agpl", 5, 0.85, "should have received a copy of the gnu affero", "you should have received a copy of the gnu affero general public license"),
    ("gpl-2.0", 4, 0.7, "either version 2 of the license", "either version 2 of the license or at your option any later version"),
    ("gpl-3.0", 4, 0.7, "either version 3 of the license", "either version 3 of the license or at your option any later version"),
    ("lgpl-2.1", 4, 0.75, "either version 2 1 of the license", "either version 2 1 of the license or at your option any later version"),
    ("gpl", 4, 0.8, "everyone is permitted to copy and distribute verbatim copies", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", 3, 0.7, "designed to take away your freedom", "the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change"),
    ("gpl", 3, 0.6, "free software foundation inc", "free software foundation inc (?:51 franklin|59 temple|675 mass)"),
    ("agpl-3.0", 4, 0.8, "remote network interaction", "remote network interaction use with the gnu general public license"),
    ("gfdl", 4, 0.85, "permission is granted to copy distribute and or modify this document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", 3, 0.7, "with no invariant sections", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", 5, 0.95, "this source code form is subject to the terms of the mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", 4, 0.8, "incompatible with secondary licenses", "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-1.1", 4, 0.8, "are subject to the mozilla public license", "the contents of this file are subject to the mozilla public license"),
    ("cddl-1.0", 4, 0.8, "subject to the terms of the common development and distribution license", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl-1.0", 4, 0.8, "made available under the terms of the eclipse public license v1", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", 4, 0.8, "made available under the terms of the eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("eupl", 4, 0.8, "subject to the following eupl", "licensed under the eupl subject to the following eupl conditions"),
    ("artistic", 4, 0.8, "the copyright holder maintains some semblance of artistic control", "the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("bsl-1.0", 4, 0.85, "obtaining a copy of the software and accompanying documentation", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("busl", 4, 0.8, "non production use", "licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("sspl", 4, 0.8, "make the functionality of the program or a modified version available to third parties as a service", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic", 4, 0.8, "hosted or managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("zlib", 4, 0.85, "must not be misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 4, 0.8, "altered source versions must be plainly marked", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("openssl", 4, 0.85, "for use in the openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("python", 4, 0.8, "python software foundation psf", "this license agreement is between the python software foundation psf"),
    ("php", 4, 0.8, "products derived from this software may not be called php", "products derived from this software may not be called php nor may php appear in their name"),
    ("unlicense", 4, 0.85, "anyone is free to copy modify publish use compile sell", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", 3, 0.7, "dedicate any and all copyright interest", "(?:we|i|the author or authors of this software) dedicate any and all copyright interest in the software to the public domain"),
    ("wtfpl", 4, 0.85, "you just do what the fuck you want to", "you just do what the fuck you want to"),
    ("cc0-1.0", 4, 0.85, "waived all copyright and related", "has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", 4, 0.8, "irrevocably and unconditionally waives", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("cc", 3, 0.6, "licensed under a creative commons", "(?:this work|this content|this document|content) is licensed under a creative commons"),
    ("cc-by", 3, 0.7, "you must give appropriate credit", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", 4, 0.75, "distribute your contributions under the same license", "if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by-nc", 4, 0.75, "may not use the material for commercial purposes", "you may not use the material for commercial purposes"),
    ("cc-by-nd", 4, 0.75, "may not distribute the modified material", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("odbl", 4, 0.8, "made available under the open database license", "this [a-z ]{1,60} is made available under the open database license"),
    ("ofl", 4, 0.85, "sold by itself", "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("ofl", 3, 0.7, "reserved font name", "with reserved font name"),
    ("ms-pl", 4, 0.8, "if you use the software you accept this license", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("ncsa", 4, 0.8, "deal with the software without restriction", "to deal with the software without restriction including without limitation the rights to use copy"),
    ("postgresql", 4, 0.85, "without a written agreement is hereby granted", "for any purpose without fee and without a written agreement is hereby granted"),
    ("lppl", 4, 0.8, "distributed and or modified under the conditions of the latex project public license", "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("beerware", 4, 0.85, "buy me a beer", "if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("openrail", 4, 0.8, "use based restrictions", "use based restrictions as referenced in"),
    ("proprietary", 3, 0.75, "confidential and proprietary", "(?:this (?:file|document|software) is |is )?confidential and proprietary"),
    ("proprietary", 3, 0.7, "unauthorized copying of this file", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", 3, 0.7, "may not be reproduced", "may not be reproduced (?:or distributed |distributed or transmitted )?(?:in any form )?without (?:the )?prior written permission"),
    ("proprietary", 3, 0.75, "end user license agreement", "end user license agreement"),
    ("commercial", 2, 0.6, "for personal use only", "for personal use only"),
    ("non-commercial", 2, 0.6, "for non commercial use only", "for non commercial use only"),
    ("non-commercial", 2, 0.6, "research purposes only", "for (?:academic |non commercial )?research purposes only"),
    ("public-domain", 3, 0.8, "no copyright", "(?:there is |has )?no copyright (?:restrictions|protection|is claimed)"),
    ("public-domain", 3, 0.7, "work of the united states government", "(?:is a |this )work of the united states government"),
    ("dual", 3, 0.7, "dual licensed under", "dual licensed under"),
    ("dual", 3, 0.6, "at your option", "under either (?:of )?[a-z0-9 ]{1,120} at your option"),
    ("permissive", 1, 0.4, "see the license file", "see the license file"),
    ("permissive", 2, 0.5, "freely distributable", "(?:this software is |is )?freely distributable"),
)


class Rule(NamedTuple):
    label: str
    priority: int
    score: float
    keyword: str
    pattern: re.Pattern


def _keyword(name: str) -> str:
    """The longest text that every match of a name wording holds: what no group, class or question mark touches."""
    last = None
    while name != last:
        last, name = name, re.sub(r"\(\?:[^()]*\)\??", "|", name)
    return max(re.sub(r"\[[^]]*\]\??|[^|]\?", "|", name).split("|"), key=len)


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: identifiers, names in sentence frames, passages."""
    found = []

    def add(label: str, priority: int, score: float, keyword: str, body: str) -> None:
        found.append(Rule(label, priority, score, keyword, re.compile(rf"(?<![^ ])(?:{body})(?![^ ])")))

    for label, ids, names in LICENSES:
        for x in ids:
            add(label, 5, 1.0, "spdx", f"spdx licen[sc]e identifier {x}")
            add(label, 3, 0.9, "licen", f"licen[sc]ed? (?:is |under (?:the )?)?{x}")
        for name in names:
            for priority, score, frame in FRAMES:
                add(label, priority, score, _keyword(name), frame.format(f"(?:{name})"))
    for label, priority, score, keyword, body in PASSAGES:
        add(label, priority, score, keyword, body)
    return tuple(found)


@cache
def keywords() -> tuple[str, ...]:
    return tuple(sorted({r.keyword for r in rules()}))


class Detection(NamedTuple):
    start: int
    end: int
    label: str
    priority: int
    score: float
    order: int


def suppressed(found: list[Detection]) -> list[Detection]:
    """found without what a stronger detection contains; O(n log n) for the few priorities there are."""
    kept, reach = [], {}
    for d in sorted(found, key=lambda d: (d.start, -d.end, -d.priority, d.order)):
        if not any(p >= d.priority and end >= d.end for p, end in reach.items()):
            kept.append(d)
        reach[d.priority] = max(reach.get(d.priority, 0), d.end)
    return kept


def _places(norm: str, at: list[int]) -> list[int]:
    """The word numbers of ascending character offsets in norm."""
    out, last, count = [], 0, 0
    for x in at:
        count += norm.count(" ", last, x)
        last = x
        out.append(count)
    return out


def detect(text: str | None, gated: bool = True) -> tuple[int, list[tuple[int, str]], list[Detection]]:
    """Number of words; (first word, label) of each base phrase; detections with word intervals [start, end)."""
    words = alnum_words(text.encode()) if text else []
    if not words:
        return 0, [], []
    joined = b" ".join(words)
    padded = b" " + joined + b" "
    base = []
    for phrase, label in BASE:
        at, last, count = padded.find(b" " + phrase + b" "), 0, 0
        while at >= 0:
            count += padded.count(b" ", last, at)
            last = at
            base.append((count, label))
            at = padded.find(b" " + phrase + b" ", at + 1)
    norm = joined.decode()
    present = {k for k in keywords() if not gated or k in norm}
    found: list[Detection] = []
    if present:
        raw = [(m.start(), m.end(), k) for k, r in enumerate(rules()) if r.keyword in present for m in r.pattern.finditer(norm)]
        if raw:
            place = dict(zip(at := sorted({x for s, e, _ in raw for x in (s, e)}), _places(norm, at), strict=True))
            for s, e, k in raw:
                r = rules()[k]
                found.append(Detection(place[s], place[e] + 1, r.label, r.priority, r.score, k))
    return len(words), sorted(base), suppressed(found)


_OUT = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("detections", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("priority", pa.int32()), ("score", pa.float64())]))),
    ]
)
_DDL = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:int,end:int,label:string,priority:int,score:double>>"


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: base phrases, labels, score and the detections left after suppression."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                n, base, found = detect(text)
                of_base = {x for _, x in base}
                rows.append(
                    {
                        "n_words": n,
                        "n_base": len(base),
                        "first_word": base[0][0] if base else None,
                        "last_word": base[-1][0] if base else None,
                        "base_labels": ",".join(sorted(of_base)),
                        "labels": ",".join(sorted(of_base | {d.label for d in found})),
                        "score": max([0.0, *(0.9 for _ in of_base), *(d.score for d in found)]),
                        "detections": [{"start": d.start, "end": d.end, "label": d.label, "priority": d.priority, "score": d.score} for d in found],
                    }
                )
            out = pa.RecordBatch.from_pylist(rows, schema=_OUT)
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns], names=["_id", *_OUT.names])

    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"_id {kind}, {_DDL}").withColumnRenamed("_id", id_col)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")
