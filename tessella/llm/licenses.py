"""License scan: ordered signature rules behind a keyword prefilter.

Each rule is a regular expression over the normalised text (lower-cased words of letters,
digits and non-ASCII characters, joined by single spaces) with a label, a priority, a
confidence and one keyword that every match contains. One Aho-Corasick pass over a text finds
the keywords present; only rules of those keywords run. Overlaps are resolved by priority:
detections are taken in order of priority, length and position, and one that lies wholly inside a
detection already taken is suppressed.

Defined cases: null and empty texts have no words, no detections, null first and last word and
score 0. Repeated rows are scanned each on its own. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm.common import raw, slices, table

#: Fixed values of the query's contract: the phrases whose places are counted, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Bytes of words, A-Z lowered; every other ASCII byte separates words.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    confidence: float
    keywords: tuple[str, ...]
    pattern: str


#: label | SPDX words | pattern of the license's name, over normalised words | its keywords,
#: parted by commas: each match contains one of them.
#: Versions are written with the spaces that normalising leaves ("2 0").
FAMILIES = r"""
mit | mit | (?:the )?(?:mit|expat) (?:x11 |open source )?licen[cs]e | mit, expat
mit-0 | mit 0 | mit (?:no attribution|zero attribution) licen[cs]e | attribution
apache-1.1 | apache 1 1 | apache (?:software )?licen[cs]e (?:version |v ?)?1 1 | apache
apache-1.0 | apache 1 0 | apache (?:software )?licen[cs]e (?:version |v ?)?1 0 | apache
apache-2.0 | apache 2 0 | apache (?:software )?licen[cs]e (?:version |v ?)?2(?: 0)? | apache
gpl-1.0 | gpl 1 0 | (?:gnu )?general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v ?)1 | general public
gpl-2.0 | gpl 2 0 | (?:gnu )?general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v ?)2 | general public
gpl-3.0 | gpl 3 0 | (?:gnu )?general public licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version |v ?)3 | general public
lgpl-2.0 | lgpl 2 0 | (?:gnu )?library general public licen[cs]e(?: (?:version |v ?)2)? | library general
lgpl-2.1 | lgpl 2 1 | (?:gnu )?lesser general public licen[cs]e (?:version |v ?)2 1 | lesser general
lgpl-3.0 | lgpl 3 0 | (?:gnu )?lesser general public licen[cs]e (?:version |v ?)3 | lesser general
lgpl | lgpl | (?:gnu )?lesser general public licen[cs]e | lesser general
agpl-1.0 | agpl 1 0 | affero general public licen[cs]e (?:version |v ?)1 | affero
agpl-3.0 | agpl 3 0 | (?:gnu )?affero general public licen[cs]e (?:version |v ?)3 | affero
agpl | agpl | (?:gnu )?affero general public licen[cs]e | affero
gfdl-1.1 | gfdl 1 1 | gnu free documentation licen[cs]e (?:version |v ?)1 1 | free documentation
gfdl-1.2 | gfdl 1 2 | gnu free documentation licen[cs]e (?:version |v ?)1 2 | free documentation
gfdl-1.3 | gfdl 1 3 | gnu free documentation licen[cs]e (?:version |v ?)1 3 | free documentation
gfdl | gfdl | gnu free documentation licen[cs]e | free documentation
bsd-1-clause | bsd 1 clause | (?:bsd (?:1|one) clause|(?:1|one) clause bsd)(?: licen[cs]e)? | clause
bsd-2-clause | bsd 2 clause | (?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: licen[cs]e) | bsd
bsd-3-clause | bsd 3 clause | (?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e) | bsd
bsd-4-clause | bsd 4 clause | (?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: licen[cs]e) | bsd
bsd-0-clause | 0bsd | (?:zero clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)? | bsd
bsd | bsd | bsd (?:style )?licen[cs]e | bsd
isc | isc | isc licen[cs]e | isc licen
mpl-1.0 | mpl 1 0 | mozilla public licen[cs]e (?:version |v ?)?1 0 | mozilla
mpl-1.1 | mpl 1 1 | mozilla public licen[cs]e (?:version |v ?)?1 1 | mozilla
mpl-2.0 | mpl 2 0 | mozilla public licen[cs]e (?:version |v ?)?2(?: 0)? | mozilla
mpl | mpl | mozilla public licen[cs]e | mozilla
epl-1.0 | epl 1 0 | eclipse public licen[cs]e (?:version |v ?)?1(?: 0)? | eclipse
epl-2.0 | epl 2 0 | eclipse public licen[cs]e (?:version |v ?)?2(?: 0)? | eclipse
epl | epl | eclipse public licen[cs]e | eclipse
edl-1.0 | edl 1 0 | eclipse distribution licen[cs]e | eclipse
cddl-1.0 | cddl 1 0 | common development and distribution licen[cs]e(?: (?:version |v ?)?1 0)? | common development
cddl-1.1 | cddl 1 1 | common development and distribution licen[cs]e (?:version |v ?)?1 1 | common development
cpl-1.0 | cpl 1 0 | common public licen[cs]e(?: (?:version |v ?)?1 0)? | common public
ipl-1.0 | ipl 1 0 | ibm public licen[cs]e | ibm public
eupl-1.1 | eupl 1 1 | european union public licen[cs]e (?:version |v ?)?1 1 | european union
eupl-1.2 | eupl 1 2 | european union public licen[cs]e (?:version |v ?)?1 2 | european union
eupl | eupl | european union public licen[cs]e | european union
cecill-1.1 | cecill 1 1 | cecill (?:free software )?licen[cs]e (?:agreement )?(?:version |v ?)?1 1 | cecill
cecill-2.1 | cecill 2 1 | cecill (?:free software )?licen[cs]e (?:agreement )?(?:version |v ?)?2 1 | cecill
cecill-b | cecill b | cecill b | cecill
cecill-c | cecill c | cecill c | cecill
osl-3.0 | osl 3 0 | open software licen[cs]e(?: (?:version |v ?)?3 0)? | open software
afl-3.0 | afl 3 0 | academic free licen[cs]e(?: (?:version |v ?)?3 0)? | academic free
artistic-1.0 | artistic 1 0 | artistic licen[cs]e(?: (?:version |v ?)?1 0)? | artistic
artistic-2.0 | artistic 2 0 | artistic licen[cs]e (?:version |v ?)?2 0 | artistic
bsl-1.0 | bsl 1 0 | boost software licen[cs]e(?: (?:version |v ?)?1 0)? | boost
busl-1.1 | busl 1 1 | business source licen[cs]e(?: 1 1)? | business source
cc0-1.0 | cc0 1 0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)? | cc0
cc-by-2.0 | cc by 2 0 | (?:creative commons attribution|cc by) 2 0 | creative commons attribution, cc by
cc-by-2.5 | cc by 2 5 | (?:creative commons attribution|cc by) 2 5 | creative commons attribution, cc by
cc-by-3.0 | cc by 3 0 | (?:creative commons attribution|cc by) 3 0 | creative commons attribution, cc by
cc-by-4.0 | cc by 4 0 | (?:creative commons attribution|cc by) 4 0 | creative commons attribution, cc by
cc-by-sa-2.0 | cc by sa 2 0 | (?:creative commons attribution share ?alike|cc by sa) 2 0 | creative commons attribution, cc by
cc-by-sa-2.5 | cc by sa 2 5 | (?:creative commons attribution share ?alike|cc by sa) 2 5 | creative commons attribution, cc by
cc-by-sa-3.0 | cc by sa 3 0 | (?:creative commons attribution share ?alike|cc by sa) 3 0 | creative commons attribution, cc by
cc-by-sa-4.0 | cc by sa 4 0 | (?:creative commons attribution share ?alike|cc by sa) 4 0 | creative commons attribution, cc by
cc-by-nc-3.0 | cc by nc 3 0 | (?:creative commons attribution non ?commercial|cc by nc) 3 0 | creative commons attribution, cc by
cc-by-nc-4.0 | cc by nc 4 0 | (?:creative commons attribution non ?commercial|cc by nc) 4 0 | creative commons attribution, cc by
cc-by-nc-sa-3.0 | cc by nc sa 3 0 | (?:creative commons attribution non ?commercial share ?alike|cc by nc sa) 3 0 | creative commons attribution, cc by
cc-by-nc-sa-4.0 | cc by nc sa 4 0 | (?:creative commons attribution non ?commercial share ?alike|cc by nc sa) 4 0 | creative commons attribution, cc by
cc-by-nd-3.0 | cc by nd 3 0 | (?:creative commons attribution no ?deriv(?:ative)?s|cc by nd) 3 0 | creative commons attribution, cc by
cc-by-nd-4.0 | cc by nd 4 0 | (?:creative commons attribution no ?deriv(?:ative)?s|cc by nd) 4 0 | creative commons attribution, cc by
cc-by-nc-nd-3.0 | cc by nc nd 3 0 | (?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd) 3 0 | creative commons attribution, cc by
cc-by-nc-nd-4.0 | cc by nc nd 4 0 | (?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd) 4 0 | creative commons attribution, cc by
cc | cc | creative commons (?:attribution )?licen[cs]e | creative commons
unlicense | unlicense | (?:the )?unlicense | unlicense
wtfpl | wtfpl | (?:do what the fuck you want to public licen[cs]e|wtfpl) | what the fuck, wtfpl
zlib | zlib | zlib (?:libpng )?licen[cs]e | zlib
libpng | libpng | (?:png reference library|libpng) licen[cs]e | png reference, libpng
psf-2.0 | psf 2 0 | python software foundation licen[cs]e | python
python-2.0 | python 2 0 | python licen[cs]e | python
php-3.0 | php 3 0 | php licen[cs]e (?:version |v ?)?3 0 | php
php-3.01 | php 3 01 | php licen[cs]e(?: (?:version |v ?)?3 01)? | php
ruby | ruby | ruby licen[cs]e | ruby
perl | perl | same terms as perl(?: itself)? | perl
openssl | openssl | openssl licen[cs]e | openssl
ssleay | ssleay | ssleay licen[cs]e | ssleay
postgresql | postgresql | postgresql licen[cs]e | postgresql
ofl-1.0 | ofl 1 0 | sil open font licen[cs]e (?:version |v ?)?1 0 | open font
ofl-1.1 | ofl 1 1 | sil open font licen[cs]e(?: (?:version |v ?)?1 1)? | open font
odbl-1.0 | odbl 1 0 | open (?:data commons open )?database licen[cs]e | database
odc-by-1.0 | odc by 1 0 | open data commons attribution licen[cs]e | open data
pddl-1.0 | pddl 1 0 | (?:open data commons )?public domain dedication and licen[cs]e | public domain
ogl-uk-3.0 | ogl uk 3 0 | open government licen[cs]e(?: v?3 ?0)? | open government
ncsa | ncsa | (?:university of illinois |uiuc )?ncsa (?:open source )?licen[cs]e | ncsa
w3c | w3c | w3c (?:software (?:notice and )?)?licen[cs]e | w3c
x11 | x11 | x11 licen[cs]e | x11
xfree86-1.1 | xfree86 1 1 | xfree86 licen[cs]e | xfree86
ms-pl | ms pl | microsoft public licen[cs]e | microsoft
ms-rl | ms rl | microsoft reciprocal licen[cs]e | microsoft
apsl-2.0 | apsl 2 0 | apple public source licen[cs]e | apple
upl-1.0 | upl 1 0 | universal permissive licen[cs]e | universal permissive
nposl-3.0 | nposl 3 0 | non profit open software licen[cs]e | open software
qpl-1.0 | qpl 1 0 | q public licen[cs]e | q public
lppl-1.3c | lppl 1 3c | latex project public licen[cs]e | latex
vim | vim | vim licen[cs]e | vim licen
tcl | tcl | tcl tk licen[cs]e | tcl
curl | curl | curl licen[cs]e | curl
icu | icu | icu licen[cs]e | icu licen
unicode-dfs-2016 | unicode dfs 2016 | unicode (?:inc )?licen[cs]e(?: agreement)?(?: data files and software)? | unicode
ecl-2.0 | ecl 2 0 | educational community licen[cs]e | educational
efl-2.0 | efl 2 0 | eiffel forum licen[cs]e | eiffel
entessa | entessa | entessa public licen[cs]e | entessa
fair | fair | fair licen[cs]e | fair licen
frameworx-1.0 | frameworx 1 0 | frameworx open licen[cs]e | frameworx
mulanpsl-2.0 | mulanpsl 2 0 | mulan (?:permissive software licen[cs]e|psl)(?: v?2)? | mulan
naumen | naumen | naumen public licen[cs]e | naumen
nokia | nokia | nokia open source licen[cs]e | nokia
oclc-2.0 | oclc 2 0 | oclc research public licen[cs]e | oclc
rpl-1.5 | rpl 1 5 | reciprocal public licen[cs]e | reciprocal
rpsl-1.0 | rpsl 1 0 | realnetworks public source licen[cs]e | realnetworks
simpl-2.0 | simpl 2 0 | simple public licen[cs]e | simple public
sissl | sissl | sun industry standards source licen[cs]e | sun industry
sleepycat | sleepycat | sleepycat licen[cs]e | sleepycat
spl-1.0 | spl 1 0 | sun public licen[cs]e | sun public
sspl-1.0 | sspl 1 0 | server side public licen[cs]e | server side
elastic-2.0 | elastic 2 0 | elastic licen[cs]e(?: 2 0)? | elastic
commons-clause | commons clause | commons clause(?: licen[cs]e condition)? | commons clause
watcom-1.0 | watcom 1 0 | (?:sybase )?open watcom public licen[cs]e | watcom
zpl-2.1 | zpl 2 1 | zope public licen[cs]e | zope
beerware | beerware | (?:the )?beer ?ware licen[cs]e | beer
json | json | json licen[cs]e | json
blueoak-1.0.0 | blueoak 1 0 0 | blue oak model licen[cs]e | blue oak
hippocratic-2.1 | hippocratic 2 1 | hippocratic licen[cs]e | hippocratic
openrail | openrail | (?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[cs]e)? | rail
proprietary | proprietary | (?:proprietary|commercial) licen[cs]e(?: agreement)? | proprietary, commercial
"""

#: name | label | priority | confidence | keywords | pattern: texts and notices that name no license,
#: grants, and generic mentions of the base families. A lower number is a higher priority.
NOTICES = r"""
mit-grant | mit | 20 | 0.95 | hereby granted | permission is hereby granted free of charge to any person obtaining a copy
mit-notice | mit | 25 | 0.8 | permission notice | the above copyright notice and this permission notice shall be included
isc-grant | isc | 20 | 0.9 | permission to use | permission to use copy modify and (?:or )?distribute this software for any purpose
bsd-grant | bsd | 20 | 0.9 | redistribution | redistribution and use in source and binary forms with or without modification
bsd-3-endorse | bsd-3-clause | 15 | 0.9 | endorse | neither the name of .{1,80}? may be used to endorse or promote products
bsd-4-advert | bsd-4-clause | 15 | 0.9 | advertising | all advertising materials mentioning features or use of this software
apache-grant | apache-2.0 | 15 | 0.95 | apache | licensed under the apache license version 2 0
apache-url | apache-2.0 | 15 | 0.95 | apache | (?:www )?apache org licenses license 2 0
gpl-grant | gpl | 20 | 0.9 | free software | this program is free software you can redistribute it and or modify
gpl-later | gpl-or-later | 15 | 0.9 | later version | either version \d(?: \d)? of the license or (?:at your option )?any later version
gpl-copy | gpl | 25 | 0.8 | general public | you should have received a copy of the gnu general public license
gpl-url | gpl | 25 | 0.9 | gnu org | (?:www )?gnu org licenses (?:old licenses )?a?l?gpl
lgpl-grant | lgpl | 18 | 0.9 | free software | this library is free software you can redistribute it and or modify
mpl-grant | mpl-2.0 | 15 | 0.95 | source code form | this source code form is subject to the terms of the mozilla public license
cc0-grant | cc0-1.0 | 20 | 0.9 | waived | has waived all copyright and related
cc-url | cc | 20 | 0.9 | creativecommons | creativecommons org (?:licenses|publicdomain)
boost-grant | bsl-1.0 | 20 | 0.9 | accompanying | accompanying documentation covered by this license
zlib-grant | zlib | 20 | 0.9 | express or implied | this software is provided as is without any express or implied warranty
unlicense-grant | unlicense | 20 | 0.95 | unencumbered | this is free and unencumbered software released into the public domain
wtfpl-grant | wtfpl | 20 | 0.95 | what the fuck | you just do what the fuck you want to
public-domain | public-domain | 40 | 0.6 | public domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
all-rights | all-rights-reserved | 40 | 0.5 | rights reserved | all rights reserved
copyright-year | copyright | 60 | 0.3 | copyright | copyright (?:c )?(?:19|20)\d\d
see-license | license-reference | 55 | 0.3 | licen | see (?:the )?(?:accompanying |attached )?licen[cs]e(?: file| txt| md)?
dual | dual-license | 30 | 0.7 | dual | dual(?:ly)? licen[cs]ed
mit-mention | mit | 50 | 0.7 | mit | mit licen[cs]ed?
apache-mention | apache | 50 | 0.7 | apache | apache licen[cs]ed?
gpl-mention | gpl | 50 | 0.7 | general public | general public licen[cs]e
mit-conditions | mit | 25 | 0.85 | without restriction | to deal in the software without restriction including without limitation the rights to use
mit-warranty | mit | 28 | 0.8 | warranties of merchantability | the warranties of merchantability fitness for a particular purpose and non ?infringement in no event shall the authors
mit-liability | mit | 28 | 0.75 | dealings in the software | out of or in connection with the software or the use or other dealings in the software
mit-0-grant | mit-0 | 18 | 0.7 | hereby granted | permission is hereby granted free of charge .{1,200}? to permit persons to whom the software is furnished to do so the software is provided as is
isc-notice | isc | 24 | 0.85 | with or without fee | for any purpose with or without fee is hereby granted provided that the above copyright notice
isc-warranty | isc | 28 | 0.75 | special direct indirect | in no event shall the author be liable for any special direct indirect or consequential damages
bsd-source | bsd | 24 | 0.85 | source code must retain | redistributions of source code must retain the above copyright notice
bsd-binary | bsd | 24 | 0.85 | binary form must | redistributions in binary form must reproduce the above copyright notice
bsd-warranty | bsd | 28 | 0.8 | copyright holders and contributors | this software is provided by the copyright holders and contributors as is
bsd-regents | bsd-3-clause | 18 | 0.8 | regents | (?:the )?regents of the university of california
bsd-acknowledge | bsd-4-clause | 18 | 0.85 | acknowledg | must display the following acknowledg(?:e)?ment
bsd-views | bsd-2-clause | 18 | 0.85 | freebsd project | views and conclusions .{1,160}? should not be interpreted as representing official policies .{1,40}? freebsd project
bsd-patent | bsd-2-clause-patent | 14 | 0.85 | patent rights | no express or implied licenses to any party s patent rights are granted by this license
apache-basis | apache-2.0 | 20 | 0.85 | as is basis | distributed on an as is basis without warranties or conditions of any kind
apache-terms | apache-2.0 | 20 | 0.9 | terms and conditions for use | terms and conditions for use reproduction and distribution
apache-contribution | apache-2.0 | 25 | 0.85 | contribution shall mean | contribution shall mean any work of authorship including the original version
apache-except | apache-2.0 | 25 | 0.7 | except in compliance | you may not use this file except in compliance with the license
apache-1.1-ack | apache-1.1 | 18 | 0.9 | developed by the apache | this product includes software developed by the apache (?:software foundation|group)
gpl-hope | gpl | 25 | 0.85 | in the hope | distributed in the hope that it will be useful but without any warranty
gpl-merchant | gpl | 28 | 0.75 | implied warranty | without even the implied warranty of merchantability or fitness for a particular purpose
gpl-preamble | gpl | 22 | 0.85 | freedom to share | (?:licenses|agreements) for most software .{1,60}? are designed to take away your freedom to share
gpl-3-only | gpl-3.0 | 15 | 0.9 | version 3 | general public license as published by the free software foundation version 3 of the license
gpl-2-only | gpl-2.0 | 15 | 0.9 | version 2 | general public license version 2 as published by the free software foundation
gpl-franklin | gpl | 30 | 0.7 | free software foundation | free software foundation inc (?:51 franklin|59 temple|675 mass)
gpl-classpath | gpl-classpath | 14 | 0.9 | exception | as a special exception .{1,120}? permission to link this (?:library|code) with independent modules
gpl-font | gpl-font | 14 | 0.85 | uses this font | if you create a document which uses this font
gpl-bison | gpl-bison | 14 | 0.85 | bison | you may create a larger work that contains part or all of the bison parser skeleton
lgpl-hope | lgpl | 24 | 0.8 | this library is distributed | this library is distributed in the hope that it will be useful
lgpl-link | lgpl | 26 | 0.8 | designed to work with the library | a program that contains no derivative of any portion of the library but is designed to work with the library
agpl-network | agpl-3.0 | 18 | 0.9 | remotely | users interacting with it remotely through a computer network
gfdl-invariant | gfdl | 18 | 0.9 | invariant sections | with (?:no|the) invariant sections .{0,80}? (?:no )?front cover texts
mpl-notice | mpl-2.0 | 18 | 0.9 | mozilla org mpl | (?:you can obtain one at )?(?:https? )?(?:www )?mozilla org mpl 2 0
mpl-1-notice | mpl-1.1 | 16 | 0.9 | mozilla public | the contents of this file are subject to the mozilla public license version 1 1
mpl-incompatible | mpl-2.0-no-copyleft | 14 | 0.85 | incompatible with secondary | this source code form is incompatible with secondary licenses
epl-notice | epl | 18 | 0.9 | accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse public license
epl-url | epl | 20 | 0.9 | eclipse org | (?:www )?eclipse org legal epl
cddl-notice | cddl-1.0 | 18 | 0.9 | common development | the contents of this file are subject to the terms of the common development and distribution license
cpl-notice | cpl-1.0 | 18 | 0.85 | common public | the accompanying program is provided under the terms of this common public license
eupl-notice | eupl | 18 | 0.9 | eupl | licensed under the eupl
artistic-intent | artistic-1.0 | 18 | 0.9 | artistic control | state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
boost-hereby | bsl-1.0 | 16 | 0.9 | execute and transmit | to use reproduce display distribute execute and transmit the software
zlib-altered | zlib | 22 | 0.9 | altered source | altered source versions must be plainly marked as such
zlib-origin | zlib | 22 | 0.9 | misrepresented | the origin of this software must not be misrepresented
cc-by-share | cc-by-sa | 24 | 0.8 | share alike, sharealike | (?:attribution|by) (?:non ?commercial )?share ?alike (?:international|unported|generic)
cc-legal | cc | 24 | 0.85 | creative commons | creative commons corporation is not a law firm and does not provide legal services
cc0-dedicate | cc0-1.0 | 20 | 0.9 | cc0, associated a work | the person who associated a work with this deed has dedicated the work to the public domain|cc0 is a public domain dedication
unlicense-dedicate | unlicense | 20 | 0.9 | dedicate any and all, make this dedication | we make this dedication for the benefit of the public at large|dedicate any and all copyright interest in the software to the public domain
ofl-reserved | ofl-1.1 | 18 | 0.9 | reserved font | reserved font name
odbl-notice | odbl-1.0 | 18 | 0.9 | opendatacommons | (?:www )?opendatacommons org licenses odbl
ms-pl-notice | ms-pl | 18 | 0.85 | accept the license | if you use the software you accept this license if you do not accept the license do not use the software
wtfpl-terms | wtfpl | 18 | 0.9 | everyone is permitted | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed
beerware-terms | beerware | 18 | 0.95 | buy me a beer | you can buy me a beer in return
json-evil | json | 16 | 0.95 | good not evil | the software shall be used for good not evil
sspl-service | sspl-1.0 | 18 | 0.85 | service source code | service source code
commons-sell | commons-clause | 16 | 0.9 | right to sell | does not grant to you the right to sell the software
busl-change | busl-1.1 | 16 | 0.85 | change date | (?:on|after) the change date .{1,80}? change license
elastic-hosted | elastic-2.0 | 16 | 0.85 | hosted or managed | may not provide the software to third parties as a hosted or managed service
openrail-use | openrail | 20 | 0.85 | use based restrictions | use based restrictions
ncsa-grant | ncsa | 18 | 0.9 | deal with the software | to deal with the software without restriction including without limitation the rights
postgresql-grant | postgresql | 18 | 0.85 | written agreement | without fee and without a written agreement is hereby granted
psf-grant | psf-2.0 | 18 | 0.9 | python software foundation | the python software foundation (?:psf )?(?:and|hereby grants|is making)
openssl-ack | openssl | 18 | 0.9 | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay-ack | ssleay | 18 | 0.9 | eric young | this product includes cryptographic software written by eric young
curl-notice | curl | 18 | 0.85 | name of a copyright holder | except as contained in this notice the name of a copyright holder shall not be used in advertising
x11-notice | x11 | 18 | 0.85 | name of the x consortium | the name of the x consortium shall not be used in advertising
no-warranty | no-warranty | 60 | 0.3 | no warranty | (?:comes with|there is) (?:absolutely )?no warranty
non-commercial | non-commercial | 40 | 0.5 | commercial | for (?:personal and )?non ?commercial (?:use|purposes) only
no-redistribution | proprietary | 40 | 0.6 | prior written | (?:may not be|no part .{1,60}? may be) (?:copied|reproduced|distributed|redistributed) .{0,80}? without (?:the )?prior written (?:permission|consent)
confidential | proprietary | 40 | 0.6 | confidential | (?:proprietary and confidential|confidential and proprietary)
eula | proprietary | 35 | 0.7 | end user | end user licen[cs]e agreement
gpl-short | gpl | 50 | 0.6 | gpl | gpl ?v?[123]?
lgpl-short | lgpl | 48 | 0.6 | gpl | lgpl ?v?[23]?(?: 1)?
agpl-short | agpl | 48 | 0.6 | gpl | agpl ?v?[3]?
"""


def rules() -> list[Rule]:
    """The signature rules in order: SPDX tags, grants by name, names, then notices and mentions."""
    out = []
    for line in FAMILIES.strip().splitlines():
        label, spdx, name, keywords = (x.strip() for x in line.split(" | "))
        versioned = bool(re.search(r"\d", label))
        grant = rf"(?:licen[cs]ed|released|distributed|available|published|covered|provided|used) (?:only )?(?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}"
        out.append(Rule(f"{label}.spdx", label, 5, 0.99, ("spdx",), rf"spdx licen[cs]e identifier {spdx}(?: only| or later)?"))
        out.append(Rule(f"{label}.grant", label, 10 if versioned else 30, 0.95, tuple(keywords.split(", ")), grant))
        out.append(Rule(f"{label}.name", label, 35 if versioned else 45, 0.8, tuple(keywords.split(", ")), name))
    for line in NOTICES.strip().splitlines():
        name, label, priority, confidence, keywords, pattern = (x.strip() for x in line.split(" | "))
        out.append(Rule(name, label, int(priority), float(confidence), tuple(keywords.split(", ")), pattern))
    return out


class Scanner:
    """Compiled rules. Texts are normalised bytes read as Latin-1, so places are byte places."""

    def __init__(self, given: list[Rule] | None = None) -> None:
        self.rules = rules() if given is None else given
        self.compiled = [re.compile(rf"(?<![^ ])(?:{r.pattern})(?![^ ])") for r in self.rules]
        self.of_keyword: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            for k in r.keywords:
                self.of_keyword.setdefault(k, []).append(i)
        self.keywords = ahocorasick.Automaton()
        for k in self.of_keyword:
            self.keywords.add_word(k, k)
        self.keywords.make_automaton()

    def detections(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, rule) of what stays after suppression, by place."""
        present = {k for _, k in self.keywords.iter(text)}
        found = [(m.start(), m.end(), i) for i in sorted({i for k in present for i in self.of_keyword[k]}) for m in self.compiled[i].finditer(text)]
        found.sort(key=lambda d: (self.rules[d[2]].priority, d[0] - d[1], d[0], d[2]))
        kept: list[tuple[int, int, int]] = []
        reach: list[tuple[int, int]] = []  # kept intervals by start; none contains another, so ends ascend as well
        for d in found:
            at = bisect_right(reach, (d[0], 1 << 60))
            if at and reach[at - 1][1] >= d[1]:
                continue
            kept.append(d)
            while at < len(reach) and reach[at][1] <= d[1]:
                del reach[at]
            insort(reach, (d[0], d[1]))
        return sorted(kept)


@lru_cache(maxsize=1)
def _scanner() -> Scanner:
    return Scanner()


def word_places(norm: bytes, *places: list[int]) -> list[list[int]]:
    """The numbers of the words at places of a text of words with one blank between; blanks are found once."""
    if not any(places):
        return [[] for _ in places]
    blanks = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    return [np.searchsorted(blanks, at).tolist() for at in places]


SCAN_SCHEMA = (
    "n_words long, base array<struct<phrase:int,word:long>>,"
    " found array<struct<rule:string,label:string,confidence:double,word:long,end_word:long>>"
)


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: word count, places of the base phrases, and resolved detections.

    Word places count from 0; `end_word` is exclusive. Purely row-local: no shuffle.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = docs.select(key).schema[0].dataType.simpleString()
    plain = [p.encode() for p, _ in PHRASES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner()
        base_type = pa.list_(pa.struct([("phrase", pa.int32()), ("word", pa.int64())]))
        found_type = pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("confidence", pa.float64()), ("word", pa.int64()), ("end_word", pa.int64())]))
        for batch in slices(batches):
            counts, bases, founds = [], [], []
            for t in raw(batch.column("text")):
                words = t.translate(WORD_BYTES).split()
                counts.append(len(words))
                norm = b" ".join(words)
                base: list[tuple[int, int]] = []
                for i, phrase in enumerate(plain):
                    at = norm.find(phrase)
                    while at >= 0:
                        end = at + len(phrase)
                        if (not at or norm[at - 1] == 32) and (end == len(norm) or norm[end] == 32):
                            base.append((i, at))
                        at = norm.find(phrase, at + 1)
                found = scanner.detections(norm.decode("latin-1"))
                at_base, at_start, at_end = word_places(norm, [at for _, at in base], [a for a, _, _ in found], [b for _, b, _ in found])
                bases.append([{"phrase": i, "word": w} for (i, _), w in zip(base, at_base)])
                founds.append([
                    {"rule": scanner.rules[i].name, "label": scanner.rules[i].label, "confidence": scanner.rules[i].confidence, "word": a, "end_word": b + 1}
                    for (_, _, i), a, b in zip(found, at_start, at_end)
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(counts, pa.int64()), pa.array(bases, base_type), pa.array(founds, found_type)],
                names=["key", "n_words", "base", "found"],
            )

    return source.mapInArrow(run, f"key {kind}, {SCAN_SCHEMA}").withColumnRenamed("key", key)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document; see the module for nulls, empties and ties."""
    got = scan_licenses(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(label) for _, label in PHRASES])
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda x: F.element_at(names, x["phrase"] + 1))))
    labels = F.array_sort(F.array_union(base_labels, F.transform("found", lambda x: x["label"])))
    miss = F.aggregate("found", F.lit(1.0), lambda acc, x: acc * (1 - x["confidence"]))
    return got.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["word"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        (1 - miss * F.when(F.size("base") > 0, 0.3).otherwise(1.0)).alias("score"),
        F.size("found").cast("long").alias("n_found"),
    )
