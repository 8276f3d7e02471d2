"""Hand-written signature rules of the license scan.

A line of a table is ``label: pattern``. Patterns are over words, lower case, one
space between words; they hold literal words, ``(?:a|b)`` of whole words and optional
groups that begin with their space. Longer names and notices stand above the short ones that they
contain; the tables' order is the order of the rules.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Phrases of the base labels.
BASE = """
gpl: gnu general public license
apache: apache license
cc-by: cc by
mit: mit license
"""

#: Sentences by which a text grants or declares a license.
NOTICES = """
gpl-3.0-or-later: gnu general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
gpl-2.0-or-later: gnu general public license as published by the free software foundation either version 2 of the license or(?: at your option)? any later version
gpl-2.0-only: gnu general public license version 2 as published by the free software foundation
gpl-3.0-only: gnu general public license version 3 as published by the free software foundation
lgpl-2.1-or-later: gnu lesser general public license as published by the free software foundation either version 2 1 of the license or(?: at your option)? any later version
lgpl-3.0-or-later: gnu lesser general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
agpl-3.0-or-later: gnu affero general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
apache-2.0: licensed under the apache license version 2 0(?: the license)? you may not use this file except in compliance with the license
apache-2.0: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
mit: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
mit-0: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
isc: permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
0bsd: permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties
bsd-2-clause: redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause: neither the name of(?: the)?(?: \\S{1,40}){1,8} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission redistribution
bsd-3-clause: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer(?: \\S{1,40}){1,60} nor the names of its contributors
bsd-4-clause: all advertising materials mentioning features or use of this software must display the following acknowledgement(?: \\S{1,40}){0,40} redistribution
zlib: this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
bsl-1.0: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
mpl-2.0: this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1: the contents of this file are subject to the mozilla public license version 1 1
epl-1.0: this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0: this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? 2 0
cddl-1.0: subject to the terms of the common development and distribution license
wtfpl: do what the fuck you want to public license
unlicense: this is free and unencumbered software released into the public domain
cc0-1.0: to the extent possible under law(?: \\S{1,40}){1,8} has waived all copyright and related or neighboring rights
ofl-1.1: this font software is licensed under the sil open font license version 1 1
postgresql: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice
x11: except as contained in this notice the name of(?: the)?(?: \\S{1,40}){1,6} shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization(?: \\S{1,40}){0,6} copyright
beerware: as long as you retain this notice you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can buy me a beer(?: \\S{1,40}){0,4} license
artistic-2.0: this package is licensed under the terms of the artistic license 2 0
python-2.0: psf grants licensee a nonexclusive royalty free world wide license
ms-pl: this license governs use of the accompanying software if you use the software you accept this license
proprietary: this software is confidential and proprietary(?: \\S{1,40}){0,20} license
proprietary: unauthorized copying of this file via any medium is strictly prohibited(?: \\S{1,40}){0,12} copyright
proprietary: no part of this publication may be reproduced(?: \\S{1,40}){1,30} copyright
public-domain: this work is(?: hereby)? released into the public domain
public-domain: (?:dedicated|placed|released) (?:to|in|into) the public domain
cc-by-4.0: this work is licensed under a creative commons attribution 4 0 international license
cc-by-sa-4.0: this work is licensed under a creative commons attribution sharealike 4 0 international license
cc-by-nc-4.0: this work is licensed under a creative commons attribution noncommercial 4 0 international license
cc-by-nd-4.0: this work is licensed under a creative commons attribution noderivatives 4 0 international license
cc-by-nc-sa-4.0: this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license
cc-by-nc-nd-4.0: this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license
"""

#: Full names, with versions where there are several.
TITLES = """
gpl-1.0: gnu general public license(?: version| v)? 1
gpl-2.0: gnu general public license(?: gpl)?(?: version| v)? 2
gpl-2.0: gnu general public license v2
gpl-3.0: gnu general public license(?: gpl)?(?: version| v)? 3
gpl-3.0: gnu general public license v3
gpl-2.0-or-later: gnu general public license(?: version| v)? 2 or(?: any)? later
gpl-3.0-or-later: gnu general public license(?: version| v)? 3 or(?: any)? later
lgpl-2.0: gnu library general public license
lgpl-2.1: gnu lesser general public license(?: version| v)? 2 1
lgpl-3.0: gnu lesser general public license(?: version| v)? 3
lgpl: gnu lesser general public license
agpl-3.0: gnu affero general public license(?: version| v)? 3
agpl: gnu affero general public license
gfdl-1.1: gnu free documentation license version 1 1
gfdl-1.2: gnu free documentation license version 1 2
gfdl-1.3: gnu free documentation license version 1 3
gfdl: gnu free documentation license
apache-1.0: apache(?: software)? license(?: version| v)? 1 0
apache-1.1: apache(?: software)? license(?: version| v)? 1 1
apache-2.0: apache(?: software)? license(?: version| v)? 2(?: 0)?
apache-2.0: apache license v2(?: 0)?
bsd-2-clause: (?:simplified|freebsd) bsd license
bsd-2-clause: bsd 2 clause(?: simplified)? license
bsd-2-clause: 2 clause bsd license
bsd-3-clause: (?:new|modified|revised) bsd license
bsd-3-clause: bsd 3 clause(?: new)? license
bsd-3-clause: 3 clause bsd license
bsd-4-clause: (?:original|old) bsd license
bsd-4-clause: bsd 4 clause(?: original)? license
0bsd: (?:zero clause|0 clause) bsd license
mit-0: mit no attribution license
x11: x11 license
isc: isc license
ncsa: university of illinois(?: ncsa)? open source license
zlib: zlib(?: libpng)? license
libpng: libpng license
bsl-1.0: boost software license(?: version| v)?(?: 1 0)?
mpl-1.0: mozilla public license(?: version| v)? 1 0
mpl-1.1: mozilla public license(?: version| v)? 1 1
mpl-2.0: mozilla public license(?: version| v)? 2 0
mpl: mozilla public license
epl-1.0: eclipse public license(?: version| v)? 1 0
epl-2.0: eclipse public license(?: version| v)? 2 0
epl: eclipse public license
edl-1.0: eclipse distribution license
cpl-1.0: common public license(?: version| v)?(?: 1 0)?
ipl-1.0: ibm public license
cddl-1.0: common development and distribution license(?: version| v)? 1 0
cddl-1.1: common development and distribution license(?: version| v)? 1 1
cddl: common development and distribution license
eupl-1.1: european union public licence(?: version| v)? 1 1
eupl-1.2: european union public licence(?: version| v)? 1 2
eupl: european union public licence
cecill: cecill(?: free software)? license
cecill: licence(?: de)?(?: logiciel)?(?: libre)? cecill
artistic-1.0: artistic license(?: version| v)? 1 0
artistic-2.0: artistic license(?: version| v)? 2 0
artistic: artistic license
clarified-artistic: clarified artistic license
perl: same terms as perl itself(?: \\S{1,40}){0,10} license
python-2.0: python software foundation license
python-2.0: psf license
php-3.01: php license(?: version| v)?(?: 3 01)?
ruby: ruby license
lua: lua license
tcl: tcl tk license
postgresql: postgresql license
openssl: openssl license
ssleay: original ssleay license
vim: vim license
w3c: w3c software(?: notice and)? license
unicode: unicode(?: data files and software)? license
icu: icu license
ofl-1.0: sil open font license(?: version| v)? 1 0
ofl-1.1: sil open font license(?: version| v)? 1 1
ofl: sil open font license
ubuntu-font: ubuntu font licence
afl-3.0: academic free license(?: version| v)?(?: 3 0)?
osl-3.0: open software license(?: version| v)?(?: 3 0)?
ecl-2.0: educational community license(?: version| v)?(?: 2 0)?
apsl-2.0: apple public source license(?: version| v)?(?: 2 0)?
ms-pl: microsoft public license
ms-rl: microsoft reciprocal license
mulan-2.0: mulan permissive software license(?: version| v)?(?: 2)?
upl-1.0: universal permissive license(?: version| v)?(?: 1 0)?
vsl-1.0: vovida software license
zpl-2.1: zope public license
qpl-1.0: q public license
sleepycat: sleepycat license
sspl-1.0: server side public license
busl-1.1: business source license
elastic-2.0: elastic license(?: version| v)?(?: 2 0)?
polyform: polyform(?: \\S{1,40}){1,2} license
commons-clause: commons clause license condition
fair: fair license
wtfpl: wtfpl license
beerware: beer ware license
json: json license
curl: curl license
ftl: freetype(?: project)? license
ijg: independent jpeg group license
imagemagick: imagemagick license
miros: miros licence
nokia: nokia open source license
osetpl: open ldap public license
openldap-2.8: openldap public license
odbl-1.0: open database license
odc-by-1.0: open data commons attribution license
pddl-1.0: open data commons public domain dedication
ogl-uk-3.0: open government licence(?: version| v)?(?: 3 0)?
etalab-2.0: licence ouverte(?: etalab)?
dl-de-by-2.0: datenlizenz deutschland(?: namensnennung)?(?: \\S{1,40}){0,3} license
cdla-permissive: community data license agreement permissive
cdla-sharing: community data license agreement sharing
openrail: (?:open rail|openrail)(?: m)? license
openrail: responsible ai license
llama: llama(?: 2| 3)? community license
gemma: gemma(?: \\S{1,40}){0,2} license
cc0-1.0: cc0(?: 1 0)?(?: universal)?
cc0-1.0: creative commons zero
cc-by-4.0: creative commons attribution 4 0
cc-by-3.0: creative commons attribution 3 0
cc-by-2.5: creative commons attribution 2 5
cc-by-2.0: creative commons attribution 2 0
cc-by: creative commons attribution
cc-by-sa: creative commons attribution (?:sharealike|share alike)
cc-by-sa-4.0: creative commons attribution (?:sharealike|share alike) 4 0
cc-by-sa-3.0: creative commons attribution (?:sharealike|share alike) 3 0
cc-by-nc: creative commons attribution (?:noncommercial|non commercial)
cc-by-nc-4.0: creative commons attribution (?:noncommercial|non commercial) 4 0
cc-by-nd: creative commons attribution (?:noderivatives|no derivatives|noderivs)
cc-by-nc-sa: creative commons attribution (?:noncommercial|non commercial) (?:sharealike|share alike)
cc-by-nc-nd: creative commons attribution (?:noncommercial|non commercial) (?:noderivatives|no derivatives|noderivs)
"""

#: Short names and references.
SHORT = """
cc-by-4.0: cc by 4 0
cc-by-3.0: cc by 3 0
cc-by-2.5: cc by 2 5
cc-by-2.0: cc by 2 0
cc-by-sa: cc by sa
cc-by-sa-4.0: cc by sa 4 0
cc-by-sa-3.0: cc by sa 3 0
cc-by-nc: cc by nc
cc-by-nc-4.0: cc by nc 4 0
cc-by-nc-sa: cc by nc sa
cc-by-nc-sa-4.0: cc by nc sa 4 0
cc-by-nc-nd: cc by nc nd
cc-by-nc-nd-4.0: cc by nc nd 4 0
cc-by-nd: cc by nd
cc-by-nd-4.0: cc by nd 4 0
gpl-2.0: gplv2
gpl-3.0: gplv3
gpl-2.0: gpl(?: version| v)? 2(?: 0)?
gpl-3.0: gpl(?: version| v)? 3(?: 0)?
lgpl-2.1: lgplv2 1
lgpl-3.0: lgplv3
lgpl: gnu lgpl
agpl-3.0: agplv3
gpl: gnu gpl
mit: mit licensed
mit: licensed under(?: the)? mit
bsd: bsd licensed
bsd: bsd licenses
bsd: bsd style license
apache-2.0: licensed under(?: the)? apache 2 0
apache: licensed under(?: the)? apache
gpl: licensed under(?: the)? gpl
isc: licensed under(?: the)? isc
mpl-2.0: licensed under(?: the)? mpl 2 0
cc-by: creativecommons org licenses by
cc-by-4.0: creativecommons org licenses by 4 0
cc-by-sa: creativecommons org licenses by sa
cc-by-sa-4.0: creativecommons org licenses by sa 4 0
cc-by-nc: creativecommons org licenses by nc
cc-by-nc-sa: creativecommons org licenses by nc sa
cc-by-nc-nd: creativecommons org licenses by nc nd
cc-by-nd: creativecommons org licenses by nd
cc0-1.0: creativecommons org publicdomain zero 1 0(?: \\S{1,40}){0,4} license
apache-2.0: apache org licenses license 2 0
gpl: gnu org licenses gpl
gpl-2.0: gnu org licenses(?: old licenses)? gpl 2 0
gpl-3.0: gnu org licenses gpl 3 0
lgpl: gnu org licenses lgpl
agpl: gnu org licenses agpl
mit: opensource org licenses mit license
public-domain: (?:in|into) the public domain
"""

#: Weak signs, which any other detection around them replaces.
GENERIC = """
all-rights-reserved: all rights reserved
copyleft: copyleft license
proprietary: proprietary license
commercial: commercial license
open-source: open source license
license-file: see(?: the)? license file
license-file: license txt
notice: copyright notice
"""

#: Identifiers with tag rules ("SPDX-License-Identifier: ..."), and page rules ("opensource.org/licenses/...").
IDENTIFIERS = """
0bsd afl-3.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 bsd-2-clause
bsd-3-clause bsd-4-clause bsl-1.0 busl-1.1 cc0-1.0 cc-by-3.0 cc-by-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-4.0 cc-by-nc-sa-4.0
cc-by-nc-nd-4.0 cc-by-nd-4.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3 gpl-1.0
gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later isc lgpl-2.0 lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later
lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later mit mit-0 mpl-1.1 mpl-2.0 ms-pl ms-rl ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.01
postgresql python-2.0 ruby sspl-1.0 unlicense upl-1.0 vim wtfpl x11 zlib zpl-2.1
"""

#: Substrings that every rule's certain words hold one of; texts with none of them are not looked at.
GATES = ("licens", "licenc", "copyright", "copyleft", " cc", "gpl", "spdx", "domain", "commons", "redistribut", "warrant", "rights")
_COMMON = frozenset("the of or and as is in to this license licensed licenses licence public software general version open source free org".split())


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    priority: int
    confidence: float
    base: bool = False
    needs: str = ""  # a word of the text beside the pattern's own

    @property
    def regex(self) -> str:
        """Over a text whose words are led and followed by two spaces: takes one on either side."""
        return f" {self.pattern.replace(' ', '  ')} "

    def certain(self) -> list[str]:
        """The runs of literal words that every match holds."""
        text, was = f" {self.pattern} ", None
        while text != was:  # groups, innermost first
            was, text = text, re.sub(r"\((?:\?:)?[^()]*\)(?:[?*+]|\{[^}]*\})?", "\n", text)
        text = re.sub(r".[?*]|\\S\{[^}]*\}", "\n", text)
        return [run.replace(" ", "  ") for run in text.split("\n") if run.strip()]

    @property
    def keyword(self) -> str:
        """The longest certain word that is not common, or the needed one."""
        if self.needs:
            return f" {self.needs} "
        words = [w for run in self.certain() for w in run.split()]
        rare = [w for w in words if w not in _COMMON]
        return f" {max(rare or words, key=len)} "

    @property
    def gate(self) -> str:
        for gate in GATES:
            if any(gate in run for run in (self.needs and [f" {self.needs} "]) or self.certain()):
                return gate
        raise ValueError(f"no gate holds for: {self.pattern}")


def _table(lines: str) -> list[tuple[str, str]]:
    return [tuple(line.split(": ", 1)) for line in lines.replace("\\\\", "\\").strip().splitlines()]


def default_rules() -> list[Rule]:
    """All rules, in order; a higher priority wins over a lower one that it covers."""
    ids = [(i, re.sub(r"[-.]", " ", i)) for i in IDENTIFIERS.split()]
    tags = [(i, f"spdx license identifier {w}") for i, w in ids]
    operands = [(i, f"(?:or|and) {w}") for i, w in ids]  # of a tag's expression
    pages = [(i, rf"opensource org licenses {w}") for i, w in ids]
    out = [Rule(label, p, 1, 0.5, True) for label, p in _table(BASE)]
    for lines, priority, confidence in (
        (tags, 4, 1.0), (_table(NOTICES), 4, 1.0), (_table(TITLES), 3, 0.95), (pages, 2, 0.9), (_table(SHORT), 2, 0.8), (_table(GENERIC), 1, 0.3),
    ):
        out += [Rule(label, p, priority, confidence) for label, p in lines]
    return out + [Rule(label, p, 2, 0.8, needs="spdx") for label, p in operands]
