"""License scans: ordered signature rules behind a keyword gate.

Rules are regular expressions over the lower-cased text with single spaces and without comment marks, so that headers of
source files match whatever comments them out. Each has a label, a priority and the keywords
without which it cannot match; keywords are words, found for all texts at once, and a rule runs on the texts that have all
of its keywords only. Overlapping detections are resolved by containment: a detection inside another one of the same or a
higher priority is suppressed. The base phrases are found on word numbers alone and their labels always stay.

Results: one row per input row. A null or empty text has no words, null first_word and last_word, empty labels and score 0.
Repeated rows give repeated results; other columns, also those of clashing names, are ignored. No rows give no rows. Whole texts
are scanned, whatever their length. A text with several licenses has all their labels; exceptions and offers of a choice have
labels of their own.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, LOWER, Block, map_blocks, rolling, words

SEED = 2
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label; the name as a pattern; keywords of the name, all needed; identifiers; addresses.
FAMILIES = [
    ("gpl", r"gnu general public licen[sc]e", "gnu general public", r"gpl-[123]\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("lgpl", r"gnu (?:lesser|library) general public licen[sc]e", "gnu general public", r"lgpl-[23]\.[01](?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("agpl", r"gnu affero general public licen[sc]e", "gnu affero public", r"agpl-[13]\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl"),
    ("gfdl", r"gnu free documentation licen[sc]e", "gnu free documentation", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu\.org/licenses/fdl"),
    ("apache", r"apache (?:software )?licen[sc]e", "apache", r"apache-[12]\.[01]", r"apache\.org/licenses"),
    ("mit", r"(?:mit|expat|x11) licen[sc]e", "license", r"mit(?:-0)?", r"opensource\.org/licenses?/mit"),
    ("bsd", r"(?:[234]-clause |new |simplified |modified |original )?bsd licen[sc]e", "bsd", r"(?:0bsd|bsd-[1234]-clause(?:-patent)?)", r"opensource\.org/licenses?/bsd"),
    ("isc", r"isc licen[sc]e", "isc", r"isc", r"opensource\.org/licenses?/isc"),
    ("mpl", r"mozilla public licen[sc]e", "mozilla", r"mpl-[12]\.[01]", r"mozilla\.org/mpl"),
    ("epl", r"eclipse public licen[sc]e", "eclipse", r"epl-[12]\.0", r"eclipse\.org/(?:legal/)?epl"),
    ("cddl", r"common development and distribution licen[sc]e", "common development distribution", r"cddl-1\.[01]", r"opensource\.org/licenses?/cddl"),
    ("cpl", r"common public licen[sc]e", "common public", r"cpl-1\.0", r"opensource\.org/licenses?/cpl"),
    ("eupl", r"european union public licen[sc]e", "european union public", r"eupl-1\.[012]", r"joinup\.ec\.europa\.eu/[^ ]{0,80}eupl"),
    ("cecill", r"cecill(?:-[abc])?(?: free software)? licen[sc]e", "cecill", r"cecill-(?:[abc]|[12]\.[01])", r"cecill\.info/licen[cs]es"),
    ("artistic", r"artistic licen[sc]e", "artistic", r"artistic-[12]\.0", r"opensource\.org/licenses?/artistic"),
    ("bsl", r"boost software licen[sc]e", "boost", r"bsl-1\.0", r"boost\.org/license"),
    ("busl", r"business source licen[sc]e", "business source", r"busl-1\.1", r"mariadb\.com/bsl"),
    ("zlib", r"zlib(?:/libpng)? licen[sc]e", "zlib", r"zlib(?:-acknowledgement)?", r"opensource\.org/licenses?/zlib"),
    ("unlicense", r"the unlicense", "unlicense", r"unlicense", r"unlicense\.org"),
    ("wtfpl", r"do what the fuck you want to public licen[sc]e", "public fuck", r"wtfpl", r"wtfpl\.net"),
    ("postgresql", r"postgresql licen[sc]e", "postgresql", r"postgresql", r"postgresql\.org/about/licen[cs]e"),
    ("python", r"python software foundation licen[sc]e", "python foundation", r"(?:psf-2\.0|python-2\.0)", r"python\.org/psf/license"),
    ("php", r"php licen[sc]e", "php", r"php-3\.0[1]?", r"php\.net/license"),
    ("ruby", r"ruby licen[sc]e", "ruby", r"ruby", r"ruby-lang\.org/[^ ]{0,40}license"),
    ("perl", r"same terms as perl(?: itself)?", "perl terms", r"perl-5", r"dev\.perl\.org/licenses"),
    ("openssl", r"openssl licen[sc]e", "openssl", r"openssl", r"openssl\.org/source/license"),
    ("ofl", r"sil open font licen[sc]e", "sil font", r"ofl-1\.[01]", r"scripts\.sil\.org/ofl"),
    ("odbl", r"open (?:data ?commons open )?database licen[sc]e", "open database", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("ms-pl", r"microsoft public licen[sc]e", "microsoft public", r"ms-pl", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", "microsoft reciprocal", r"ms-rl", r"opensource\.org/licenses?/ms-rl"),
    ("nasa", r"nasa open source agreement", "nasa agreement", r"nasa-1\.3", r"opensource\.org/licenses?/nasa"),
    ("osl", r"open software licen[sc]e", "open software", r"osl-[123]\.[012]", r"opensource\.org/licenses?/osl"),
    ("afl", r"academic free licen[sc]e", "academic free", r"afl-[123]\.[012]", r"opensource\.org/licenses?/afl"),
    ("upl", r"universal permissive licen[sc]e", "universal permissive", r"upl-1\.0", r"oss\.oracle\.com/licenses/upl"),
    ("vim", r"vim licen[sc]e", "vim", r"vim", r"vimhelp\.org/uganda"),
    ("w3c", r"w3c software (?:notice and )?licen[sc]e", "w3c", r"w3c(?:-\d{8})?", r"w3\.org/consortium/legal"),
    ("ncsa", r"(?:university of illinois/)?ncsa open source licen[sc]e", "ncsa", r"ncsa", r"opensource\.org/licenses?/ncsa"),
    ("sspl", r"server side public licen[sc]e", "server side public", r"sspl-1\.0", r"mongodb\.com/licensing/server-side"),
    ("elastic", r"elastic licen[sc]e", "elastic", r"elastic-2\.0", r"elastic\.co/licensing"),
    ("cc0", r"(?:cc0|creative commons zero)", "", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by", r"(?:cc[ -]by|creative commons attribution)", "", r"cc-by-[1234]\.[05]", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", r"(?:cc[ -]by[ -]sa|creative commons attribution[ -]share ?alike)", "", r"cc-by-sa-[1234]\.[05]", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by-nd", r"(?:cc[ -]by[ -]nd|creative commons attribution[ -]no ?deriv(?:ative)?s?)", "", r"cc-by-nd-[1234]\.[05]", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-nc", r"(?:cc[ -]by[ -]nc|creative commons attribution[ -]non ?commercial)", "", r"cc-by-nc-[1234]\.[05]", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nc-sa", r"(?:cc[ -]by[ -]nc[ -]sa|creative commons attribution[ -]non ?commercial[ -]share ?alike)", "", r"cc-by-nc-sa-[1234]\.[05]", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc-nd", r"(?:cc[ -]by[ -]nc[ -]nd|creative commons attribution[ -]non ?commercial[ -]no ?deriv(?:ative)?s?)", "", r"cc-by-nc-nd-[1234]\.[05]", r"creativecommons\.org/licenses/by-nc-nd"),
    ("public-domain", r"public domain", "public domain", r"(?:pddl-1\.0|licenseref-public-domain)", r"creativecommons\.org/publicdomain/mark"),
    ("proprietary", r"all rights reserved", "all rights reserved", r"licenseref-(?:proprietary|commercial)", r"microsoft\.com/[^ ]{0,60}eula"),
]
#: Permission texts that name no license.
TEXTS = [
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy", "permission hereby granted"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all", "permission notice included"),
    ("isc", r"permission to use, copy, modify, and/or distribute this software for any purpose", "permission modify distribute"),
    ("bsd", r"redistribution and use in source and binary forms, with or without modification", "redistribution binary forms"),
    ("bsd", r"neither the name of .{0,80}? nor the names of its contributors", "neither names contributors"),
    ("gpl", r"you can redistribute it and/or modify it under the terms of the gnu general public", "redistribute gnu public"),
    ("lgpl", r"you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library)", "redistribute gnu terms"),
    ("apache", r"you may not use this file except in compliance with the license", "compliance except file"),
    ("mpl", r"this source code form is subject to the terms of the mozilla public", "mozilla subject terms"),
    ("zlib", r"this software is provided 'as-is', without any express or implied warranty", "software provided warranty"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered public domain"),
    ("cc0", r"to the extent possible under law, .{0,80}? has waived all copyright", "waived copyright extent"),
    ("mit", r"the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability", "software provided merchantability"),
    ("mit-0", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software .{0,300}? to do so\. the software is provided", "permission hereby granted provided"),
    ("x11", r"shall not be used in advertising or otherwise to promote the sale, use or other dealings in this software", "advertising promote dealings"),
    ("isc", r"permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "permission fee granted appear"),
    ("0bsd", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software is provided", "permission modify distribute fee"),
    ("hpnd", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose", "permission modify distribute documentation"),
    ("bsd-2-clause", r"redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "redistributions retain disclaimer"),
    ("bsd-3-clause", r"may be used to endorse or promote products derived from this software without specific prior written permission", "endorse promote derived prior"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledgement", "advertising materials acknowledgement"),
    ("bsd", r"use of this source code is governed by a bsd-style license", "governed bsd style"),
    ("mit", r"use of this source code is governed by an mit-style license", "governed mit style"),
    ("apache", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"?as is\"? basis", "applicable distributed basis"),
    ("apache", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements", "apache foundation contributor"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "includes developed apache"),
    ("gpl", r"this program is free software[:;] you can redistribute it and/or modify it", "free redistribute modify"),
    ("gpl-2.0", r"either version 2 of the license, or \(at your option\) any later version", "version option later"),
    ("gpl-3.0", r"either version 3 of the license, or \(at your option\) any later version", "version option later"),
    ("lgpl-2.1", r"either version 2\.1 of the license, or \(at your option\) any later version", "version option later"),
    ("gpl-2.0", r"under the terms of (?:the gnu general public license )?version 2 (?:only|as published by the free software foundation)", "terms version"),
    ("gpl", r"you should have received a copy of the gnu general public license along with", "received gnu along"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license along with", "received gnu along"),
    ("agpl", r"you should have received a copy of the gnu affero general public license along with", "received affero along"),
    ("gpl", r"this program is distributed in the hope that it will be useful, but without any warranty", "distributed hope useful"),
    ("gfdl", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation", "permission document gnu documentation"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1\.1", "contents mozilla subject"),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file, you can obtain one at", "mpl distributed obtain"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public", "accompanying materials eclipse"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", "contents development distribution"),
    ("cddl", r"you can obtain a copy of the license at usr/src/opensolaris\.license", "obtain opensolaris"),
    ("zlib", r"altered source versions must be plainly marked as such, and must not be misrepresented as being the original software", "altered plainly misrepresented"),
    ("bsl", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation", "permission organization accompanying"),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", "intent conditions package"),
    ("artistic", r"you may distribute (?:this|it) under the terms of either the gnu general public license or the artistic license", "either gnu artistic"),
    ("perl", r"free software; you can redistribute it and/or modify it under the same terms as perl", "redistribute terms perl"),
    ("unlicense", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "anyone compile sell"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document", "everyone verbatim copies"),
    ("wtfpl", r"you just do what the fuck you want to", "fuck want"),
    ("ofl", r"this font software is licensed under the sil open font license", "font sil"),
    ("postgresql", r"in no event shall the university of california be liable to any party for direct, indirect, special, incidental, or consequential damages", "university california liable"),
    ("python", r"psf is making python available to licensee on an \"as is\" basis", "psf python licensee"),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", "includes openssl toolkit"),
    ("ssleay", r"this product includes cryptographic software written by eric young", "cryptographic eric young"),
    ("jpeg", r"this software is based in part on the work of the independent jpeg group", "independent jpeg group"),
    ("libpng", r"the png reference library is supplied \"as is\"", "png reference supplied"),
    ("curl", r"permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies\. the software is provided \"as is\", without warranty of any kind, express or implied, including .{0,120}? third party rights", "permission appear third party"),
    ("ncsa", r"neither the names of .{0,120}? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission\. the software is provided", "neither contributors endorse"),
    ("afl", r"licensed under the academic free license version", "academic free"),
    ("osl", r"licensed under the open software license version", "open software"),
    ("sspl", r"if you make the functionality of the program or a modified version available to third parties as a service", "functionality third service"),
    ("busl", r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use", "licensor derivative production"),
    ("elastic", r"you may not provide the software to third parties as a hosted or managed service", "hosted managed service"),
    ("commons-clause", r"the license does not grant to you, the right to sell the software", "grant right sell"),
    ("json", r"the software shall be used for good, not evil", "good evil"),
    ("beerware", r"if we meet some ?day, and you think this stuff is worth it, you can buy me a beer", "meet stuff beer"),
    ("public-domain", r"this (?:file|work|code|software|program) (?:is|has been|was) (?:hereby )?(?:placed|put|released|dedicated) (?:in|into|to) the public domain", "public domain"),
    ("cc-by", r"this work is licensed under a creative commons attribution \d", "creative commons attribution"),
    ("cc-by-sa", r"this work is licensed under a creative commons attribution[ -]share ?alike", "creative commons attribution"),
    ("cc-by-nc", r"this work is licensed under a creative commons attribution[ -]non ?commercial \d", "creative commons attribution"),
    ("proprietary", r"(?:confidential and proprietary|proprietary and confidential)", "confidential proprietary"),
    ("proprietary", r"unauthori[sz]ed (?:copying|reproduction|use|distribution) of this (?:file|software|document|program)", "this"),
    ("proprietary", r"this software is the confidential and proprietary information of", "confidential proprietary information"),
]
#: Exceptions and choices that go with a license.
EXCEPTIONS = [
    ("classpath-exception", r"classpath[ -]exception(?:-2\.0)?", "classpath exception"),
    ("classpath-exception", r"linking this library statically or dynamically with other modules is making a combined work", "linking statically combined"),
    ("gcc-exception", r"gcc[ -](?:runtime library )?exception(?:-[23]\.[01])?", "gcc exception"),
    ("autoconf-exception", r"autoconf[ -](?:configure script )?exception(?:-[23]\.0)?", "autoconf exception"),
    ("bison-exception", r"bison[ -](?:parser )?exception(?:-2\.2)?|you may create a larger work that contains part or all of the bison parser skeleton", "bison"),
    ("font-exception", r"font[ -]exception(?:-2\.0)?|if you create a document which uses this font, and embed this font", "font"),
    ("llvm-exception", r"llvm[ -]exceptions?", "llvm"),
    ("linux-syscall-note", r"linux-syscall-note", "linux syscall note"),
    ("linux-syscall-note", r"cover user programs that use kernel services by normal system calls", "cover kernel services"),
    ("openssl-exception", r"(?:permission|exception) to link .{0,80}? with the openssl", "openssl link"),
    ("qt-exception", r"qt (?:company )?(?:gpl |lgpl )?exception", "qt exception"),
    ("universal-foss-exception", r"universal foss exception", "foss exception"),
    ("swift-exception", r"swift[ -]exception", "swift exception"),
    ("swift-exception", r"runtime library exception to the apache", "runtime library apache"),
    ("dual", r"(?:dual|multi|tri)[ -]?licen[sc]ed under", "under"),
    ("dual", r"licen[sc]ed under (?:either|your choice) of", "under"),
]


#: What begins or ends a line of a comment.
COMMENT = re.compile(r"^[ \t]*(?:/\*+|\*+/?|//+!?|#+!?|;+|--+|%+|!+|<!--|dnl\b|@?rem\b|\.\\\")[ \t]?|[ \t]*(?:\*+/|-->)[ \t]*$", re.M)


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    pattern: re.Pattern
    keywords: tuple[str, ...]


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """In order: a family's identifier, address, grant, versioned name and bare name, then the permission texts."""
    out = []
    granted = r"(?:licen[sc]ed|released|distributed|available|provided|published|covered|made available)(?: \w+){0,2}? under(?: the)?(?: terms(?: and conditions)? of(?: the)?)? "
    for label, name, keys, spdx, url in FAMILIES:
        words_ = tuple(keys.split())
        host = tuple(w for w in re.split(r"[^a-z0-9]+", url.split("/")[0].replace("\\", "")) if w)
        add = lambda p, c, text, k: out.append(Rule(label, p, c, re.compile(text), k))  # noqa: B023, E731
        add(5, 0.99, rf"spdx-license-identifier: ?{spdx}(?![\w.-])", ("spdx", "identifier"))
        add(4, 0.95, url, host)
        add(3, 0.95, rf"{granted}{name}(?:,? (?:version |v\.? ?)?\d+(?:\.\d+)*)?", (*words_, "under"))
        add(2, 0.9, rf"(?<![\w]){name}(?: licen[sc]e)?,? ?(?:\(?[a-z0-9-]{{2,10}}\)?,? ?)?(?:version |v\.? ?)?\d+(?:\.\d+)+(?![\w])", words_)
        add(1, 0.8, rf"(?<![\w]){name}(?![\w])", words_)
    out += [Rule(label, 4, 0.95, re.compile(text), tuple(keys.split())) for label, text, keys in TEXTS]
    out += [Rule(label, 3, 0.9, re.compile(text), tuple(keys.split())) for label, text, keys in EXCEPTIONS]
    return tuple(out)


@lru_cache(1)
def keyword_hashes() -> tuple[np.ndarray, list[str]]:
    names = sorted({w for r in rules() for w in r.keywords} | {w for p in BASE for w in p.split()} | {"licence", "cc", "cc0", "creative", "commons"})
    h = hashes_of(names)
    at = np.argsort(h)
    return h[at], [names[i] for i in at]


def hashes_of(names: list[str]) -> np.ndarray:
    r = rolling(SEED)
    out = []
    for w in names:
        b = np.frombuffer(w.encode(), np.uint8)
        out.append(r.of(r.prefix(b), np.array([0]), np.array([len(b)]))[0])
    return np.array(out, np.uint64)


def suppressed(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """Detections (start, end, priority, label, confidence) that lie in no other of the same or a higher priority; of equal
    ones the longest label, as the most special, then the first."""
    found = sorted(set(found), key=lambda x: (x[0], -x[1], -x[2], -len(x[3]), x[3]))
    reach: dict[int, int] = {}
    kept = []
    for d in found:
        if not any(p >= d[2] and end >= d[1] for p, end in reach.items()):
            kept.append(d)
        reach[d[2]] = max(reach.get(d[2], 0), d[1])
    return kept


def plain(text: str) -> str:
    """One line, without the marks that begin the lines of comments."""
    return re.sub(r"\s+", " ", COMMENT.sub(" ", text))


def detect(text: str, have: set[str]) -> list[tuple[int, int, int, str, float]]:
    """Detections in a lower-cased text with single spaces; have: the keywords among its words."""
    gate = have | ({"license"} if "licence" in have else set())
    found = [(m.start(), m.end(), r.priority, r.label, r.confidence) for r in rules() if gate.issuperset(r.keywords) and (r.keywords or have & {"cc", "cc0", "creative"}) for m in r.pattern.finditer(text)]
    return suppressed(found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections."""
    phrases = [(p.split(), label) for p, label in BASE.items()]

    def kernel(block: Block) -> pa.RecordBatch:
        r = rolling(SEED)
        keys, names = keyword_hashes()
        starts, ends, doc = words(block, ALNUM)
        low = LOWER[block.buf]
        number = np.full(len(starts), -1, np.int64)
        if len(starts):
            h = r.of(r.prefix(low), starts, ends)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            number = np.where(keys[k] == h, k, -1)
        n = np.bincount(doc, minlength=block.n)
        first = np.concatenate(([0], np.cumsum(n)))
        n_base, lo, hi = np.zeros(block.n, np.int64), np.full(block.n, -1, np.int64), np.full(block.n, -1, np.int64)
        base: list[set] = [set() for _ in range(block.n)]
        for phrase, label in phrases:
            want = [names.index(w) for w in phrase]
            m = len(starts) - len(want) + 1
            if m <= 0:
                continue
            ok = doc[:m] == doc[len(want) - 1 :]
            for j, w in enumerate(want):
                ok &= number[j : j + m] == w
            for at in np.flatnonzero(ok):
                d, place = doc[at], at - first[doc[at]]
                n_base[d] += 1
                lo[d] = place if lo[d] < 0 else min(lo[d], place)
                hi[d] = max(hi[d], place)
                base[d].add(label)
        on = np.flatnonzero(number >= 0)
        labels, score, count = [""] * block.n, np.zeros(block.n), np.zeros(block.n, np.int64)
        edge = np.flatnonzero(np.concatenate(([True], doc[on][1:] != doc[on][:-1], [True]))) if len(on) else []
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            d = int(doc[on[x]])
            have = {names[k] for k in set(number[on[x:y]].tolist())}
            text = plain(low[block.off[d] : block.off[d + 1]].tobytes().decode())
            found = detect(text, have)
            count[d] = len(found)
            labels[d] = ",".join(sorted(base[d] | {f[3] for f in found}))
            score[d] = max([0.7 * bool(base[d]), *(f[4] for f in found)])
        none = lo < 0
        return pa.RecordBatch.from_arrays(
            [block.rows.column(0), pa.array(n.astype(np.int64)), pa.array(n_base), pa.array(lo, mask=none), pa.array(hi, mask=none), pa.array([",".join(sorted(b)) for b in base], pa.string()), pa.array(labels, pa.string()), pa.array(score), pa.array(count)],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections"],
        )

    return map_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long")
