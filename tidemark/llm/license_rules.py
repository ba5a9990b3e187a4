"""Signature rules for licence statements, in order of priority: an earlier rule beats a later one.

A rule is ``label | strength | keywords | pattern``. Patterns are matched against a text's words,
lower-cased and joined by one space (so ``v2.0`` is ``v2 0``), and begin and end between words. A
rule is only tried on texts that have one of its keywords as a word. Label ``-`` marks a guard:
it detects what is no licence of the text, and so takes what lies inside it from later rules.
Fragments: ``{L}`` licence, ``{V}`` an optional word for version before a number, ``{U}`` being
placed under a licence, ``{W}`` one to six words of any kind.
"""

FRAGMENTS = {
    "L": "licen[sc]e",
    "V": "(?:version |ver |v )?v?",
    "U": "(?:licen[sc]ed|released|distributed|published|available|provided|covered|offered|shared|governed|dual licen[sc]ed) (?:to you )?(?:under|by|according to) (?:the )?(?:terms of )?(?:the )?",
    "W": r"(?:[^ ]+ ){1,6}",
}

#: The phrases whose places are counted, and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

RULES = r"""
- | 0.0 | compatible,incompatible | (?:in)?compatible with (?:version \d )?(?:of )?(?:the )?(?:gnu )?(?:a|l)?gpl(?: {V}\d)?
- | 0.0 | compatible,incompatible | (?:in)?compatible with (?:the )?(?:gnu general public|apache|mit|bsd|mozilla public) {L}
- | 0.0 | not | not (?:be )?(?:licen[sc]ed|released|distributed) under (?:the )?(?:gnu general public|gpl|apache|mit|bsd|creative commons)(?: {L})?
- | 0.0 | unlike | unlike (?:the )?(?:gnu general public|gpl|apache|mit|bsd)(?: {L})?
- | 0.0 | choosing,choose,comparison | (?:choosing|choose|comparison of) (?:a|an|open source|software) {L}s?
- | 0.0 | driver,drivers | driver(?: s)? {L}s?
- | 0.0 | fishing,hunting,marriage,pilot,liquor | (?:fishing|hunting|marriage|pilot|liquor) {L}s?
agpl-3.0-only | 0.97 | spdx | spdx {L} identifier agpl 3 0(?: only)?
agpl-3.0-or-later | 0.97 | spdx | spdx {L} identifier agpl 3 0 or later
lgpl-2.1-or-later | 0.97 | spdx | spdx {L} identifier lgpl 2 1 or later
lgpl-2.1-only | 0.97 | spdx | spdx {L} identifier lgpl 2 1(?: only)?
lgpl-3.0-or-later | 0.97 | spdx | spdx {L} identifier lgpl 3 0 or later
lgpl-3.0-only | 0.97 | spdx | spdx {L} identifier lgpl 3 0(?: only)?
lgpl-2.0-only | 0.97 | spdx | spdx {L} identifier lgpl 2 0(?: only)?
gpl-3.0-or-later | 0.97 | spdx | spdx {L} identifier gpl 3 0 or later
gpl-3.0-only | 0.97 | spdx | spdx {L} identifier gpl 3 0(?: only)?
gpl-2.0-or-later | 0.97 | spdx | spdx {L} identifier gpl 2 0 or later
gpl-2.0-with-classpath-exception | 0.97 | spdx | spdx {L} identifier gpl 2 0(?: only)? with classpath exception 2 0
gpl-2.0-with-linux-syscall-note | 0.97 | spdx | spdx {L} identifier gpl 2 0(?: only)? with linux syscall note
gpl-2.0-only | 0.97 | spdx | spdx {L} identifier gpl 2 0(?: only)?
gpl-1.0-or-later | 0.97 | spdx | spdx {L} identifier gpl 1 0(?: or later)?
apache-2.0-with-llvm-exception | 0.97 | spdx | spdx {L} identifier apache 2 0 with llvm exception
apache-2.0 | 0.97 | spdx | spdx {L} identifier apache 2 0
apache-1.1 | 0.97 | spdx | spdx {L} identifier apache 1 1
mit-0 | 0.97 | spdx | spdx {L} identifier mit 0
mit | 0.97 | spdx | spdx {L} identifier mit
bsd-2-clause-patent | 0.97 | spdx | spdx {L} identifier bsd 2 clause patent
bsd-2-clause | 0.97 | spdx | spdx {L} identifier bsd 2 clause
bsd-3-clause-clear | 0.97 | spdx | spdx {L} identifier bsd 3 clause clear
bsd-3-clause | 0.97 | spdx | spdx {L} identifier bsd 3 clause
bsd-4-clause | 0.97 | spdx | spdx {L} identifier bsd 4 clause
0bsd | 0.97 | spdx | spdx {L} identifier 0bsd
isc | 0.97 | spdx | spdx {L} identifier isc
zlib | 0.97 | spdx | spdx {L} identifier zlib
bsl-1.0 | 0.97 | spdx | spdx {L} identifier bsl 1 0
mpl-2.0 | 0.97 | spdx | spdx {L} identifier mpl 2 0
mpl-1.1 | 0.97 | spdx | spdx {L} identifier mpl 1 1
epl-2.0 | 0.97 | spdx | spdx {L} identifier epl 2 0
epl-1.0 | 0.97 | spdx | spdx {L} identifier epl 1 0
eupl-1.2 | 0.97 | spdx | spdx {L} identifier eupl 1 2
cddl-1.0 | 0.97 | spdx | spdx {L} identifier cddl 1 0
cc0-1.0 | 0.97 | spdx | spdx {L} identifier cc0 1 0
cc-by-4.0 | 0.97 | spdx | spdx {L} identifier cc by 4 0
cc-by-sa-4.0 | 0.97 | spdx | spdx {L} identifier cc by sa 4 0
cc-by-nc-4.0 | 0.97 | spdx | spdx {L} identifier cc by nc 4 0
unlicense | 0.97 | spdx | spdx {L} identifier unlicense
wtfpl | 0.97 | spdx | spdx {L} identifier wtfpl
artistic-2.0 | 0.97 | spdx | spdx {L} identifier artistic 2 0
psf-2.0 | 0.97 | spdx | spdx {L} identifier psf 2 0
ofl-1.1 | 0.97 | spdx | spdx {L} identifier ofl 1 1
spdx-other | 0.8 | spdx | spdx {L} identifier [^ ]+
mit | 0.99 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit-0 | 0.99 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit | 0.9 | copyright | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc | 0.99 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd | 0.95 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd | 0.95 | permission | permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted
bsd-3-clause | 0.99 | endorse | neither the name of {W}nor the names of (?:its|the) contributors may be used to endorse or promote products derived from this software
bsd-4-clause | 0.99 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause | 0.9 | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause | 0.9 | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd | 0.8 | redistribution | redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?
zlib | 0.98 | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 0.95 | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
bsl-1.0 | 0.98 | accompanying | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this {L}
unlicense | 0.98 | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 0.98 | want | you just do what the fuck you want to
cc0-1.0 | 0.95 | waived | to the extent possible under law {W}has waived all copyright and related or neighboring rights
apache-2.0 | 0.98 | except | you may not use this file except in compliance with the {L}
apache-2.0 | 0.9 | warranties | distributed on an as is basis without warranties or conditions of any kind either express or implied
gpl-2.0-or-later | 0.99 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public {L} as published by the free software foundation either {V}2 of the {L} or at your option any later version
gpl-3.0-or-later | 0.99 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public {L} as published by the free software foundation either {V}3 of the {L} or at your option any later version
gpl-2.0-only | 0.98 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public {L} {V}2 as published by the free software foundation
gpl-3.0-only | 0.98 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public {L} {V}3 as published by the free software foundation
lgpl-2.1-or-later | 0.99 | redistribute | you can redistribute it and or modify it under the terms of the gnu lesser general public {L} as published by the free software foundation either {V}2 1 of the {L} or at your option any later version
lgpl-3.0-or-later | 0.99 | redistribute | you can redistribute it and or modify it under the terms of the gnu lesser general public {L} as published by the free software foundation either {V}3 of the {L} or at your option any later version
lgpl-2.0-or-later | 0.99 | redistribute | you can redistribute it and or modify it under the terms of the gnu library general public {L} as published by the free software foundation either {V}2 of the {L} or at your option any later version
agpl-3.0-or-later | 0.99 | redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public {L} as published by the free software foundation either {V}3 of the {L} or at your option any later version
gpl | 0.85 | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public {L} for more details
lgpl | 0.85 | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public {L} for more details
agpl | 0.85 | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public {L} for more details
gpl | 0.9 | received | you should have received a copy of the gnu general public {L} along with this program
lgpl | 0.9 | received | you should have received a copy of the gnu (?:lesser|library) general public {L} along with this (?:library|program)
agpl | 0.9 | received | you should have received a copy of the gnu affero general public {L} along with this program
gpl-3.0 | 0.98 | copyleft | the gnu general public {L} is a free copyleft {L} for software and other kinds of works
agpl-3.0 | 0.98 | copyleft | the gnu affero general public {L} is a free copyleft {L} for software and other kinds of works
mpl-2.0 | 0.99 | source | this source code form is subject to the terms of the mozilla public {L} {V}2 0
mpl-1.1 | 0.98 | contents | the contents of this file are subject to the mozilla public {L} {V}1 1
mpl-1.0 | 0.98 | contents | the contents of this file are subject to the mozilla public {L} {V}1 0
npl-1.1 | 0.98 | contents | the contents of this file are subject to the netscape public {L} {V}1 1
cddl-1.0 | 0.98 | contents | the contents of this file are subject to the terms of (?:either )?{W}common development and distribution {L}
epl-2.0 | 0.98 | eclipse | made available under the terms of the eclipse public {L} (?:{V})?2 0
epl-1.0 | 0.98 | eclipse | made available under the terms of the eclipse public {L} {V}1 0
cpl-1.0 | 0.95 | common | made available under the terms of the common public {L} {V}1 0
artistic-1.0 | 0.9 | perl | (?:can redistribute it and or modify it )?under the same terms as perl(?: itself)?
php-3.01 | 0.95 | php | this source file is subject to {V}3 01 of the php {L}
ruby | 0.9 | ruby | (?:redistribute it and or modify it )?under the same terms as ruby(?: itself)?
openssl | 0.95 | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
psf-2.0 | 0.95 | python | python software foundation {L} {V}2
ofl-1.1 | 0.98 | font | this font software is licen[sc]ed under the sil open font {L} {V}1 1
json | 0.98 | evil | the software shall be used for good not evil
beerware | 0.98 | beer | you can buy me a beer in return
all-rights-reserved | 0.5 | rights | copyright (?:c )?{W}all rights reserved
mit-or-apache-2.0 | 0.95 | mit | {U}(?:either )?mit(?: {L})? (?:or|and) (?:the )?apache(?: {L})?(?: {V}2(?: 0)?)?
mit-or-apache-2.0 | 0.95 | mit | {U}(?:either )?(?:the )?apache(?: {L})?(?: {V}2(?: 0)?)? (?:or|and) (?:the )?mit(?: {L})?
mit-or-gpl | 0.95 | mit | dual licen[sc]ed under (?:the )?mit (?:or|and) (?:the )?gpl(?: {L}s?)?
agpl-3.0-or-later | 0.95 | affero | gnu affero general public {L} {V}3(?: 0)? or (?:any )?later(?: version)?
agpl-3.0 | 0.93 | affero | (?:gnu )?affero general public {L} {V}3(?: 0)?
agpl | 0.85 | affero | (?:gnu )?affero (?:general public )?{L}
lgpl-2.1-or-later | 0.95 | lesser | gnu lesser general public {L} {V}2 1 or (?:any )?later(?: version)?
lgpl-2.1 | 0.93 | lesser | (?:gnu )?lesser general public {L} {V}2 1
lgpl-3.0-or-later | 0.95 | lesser | gnu lesser general public {L} {V}3(?: 0)? or (?:any )?later(?: version)?
lgpl-3.0 | 0.93 | lesser | (?:gnu )?lesser general public {L} {V}3(?: 0)?
lgpl-2.0 | 0.93 | library | (?:gnu )?library general public {L}(?: {V}2(?: 0)?)?
lgpl | 0.85 | lesser | (?:gnu )?lesser general public {L}
gpl-3.0-or-later | 0.95 | general | gnu general public {L} {V}3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl-2.0-or-later | 0.95 | general | gnu general public {L} {V}2(?: 0)? or (?:any )?later(?: version)?
gpl-3.0 | 0.93 | general | (?:gnu )?general public {L} {V}3(?: 0)?
gpl-2.0 | 0.93 | general | (?:gnu )?general public {L} {V}2(?: 0)?
gpl-1.0 | 0.93 | general | gnu general public {L} {V}1(?: 0)?
gpl-3.0 | 0.9 | gpl | (?:gnu )?gpl {V}3(?: 0)?
gpl-3.0 | 0.9 | gplv3 | (?:gnu )?gplv3
gpl-2.0 | 0.9 | gpl | (?:gnu )?gpl {V}2(?: 0)?
gpl-2.0 | 0.9 | gplv2 | (?:gnu )?gplv2
gpl-3.0-or-later | 0.92 | gplv3 | gplv3 or later
gpl-2.0-or-later | 0.92 | gplv2 | gplv2 or later
lgpl-3.0 | 0.9 | lgplv3 | (?:gnu )?lgplv3
lgpl-2.1 | 0.9 | lgpl,lgplv2 | (?:gnu )?(?:lgpl {V}2 1|lgplv2 1)
lgpl-3.0 | 0.9 | lgpl | (?:gnu )?lgpl {V}3(?: 0)?
agpl-3.0 | 0.9 | agpl,agplv3 | (?:gnu )?(?:agpl {V}3(?: 0)?|agplv3)
gfdl-1.3 | 0.93 | documentation | gnu free documentation {L} {V}1 3
gfdl-1.2 | 0.93 | documentation | gnu free documentation {L} {V}1 2
gfdl | 0.85 | documentation | (?:gnu )?free documentation {L}
apache-2.0 | 0.97 | apache | {U}apache {L} {V}2(?: 0)?
apache-2.0 | 0.95 | apache | apache {L} {V}2(?: 0)?
apache-2.0 | 0.9 | apache | apache {V}2(?: 0)? {L}
apache-2.0 | 0.85 | apache | apache 2 0
apache-1.1 | 0.93 | apache | apache (?:software )?{L} {V}1 1
apache-1.0 | 0.93 | apache | apache (?:software )?{L} {V}1 0
apache-2.0 | 0.88 | asl,al2 | (?:asl 2 0|al2(?: 0)?)
cc-by-nc-nd-4.0 | 0.97 | cc | {U}(?:a )?cc by nc nd {V}4(?: 0)?(?: international)?(?: {L})?
cc-by-nc-sa-4.0 | 0.97 | cc | {U}(?:a )?cc by nc sa {V}4(?: 0)?(?: international)?(?: {L})?
cc-by-nc-4.0 | 0.97 | cc | {U}(?:a )?cc by nc {V}4(?: 0)?(?: international)?(?: {L})?
cc-by-sa-4.0 | 0.97 | cc | {U}(?:a )?cc by sa {V}4(?: 0)?(?: international)?(?: {L})?
cc-by-nd-4.0 | 0.97 | cc | {U}(?:a )?cc by nd {V}4(?: 0)?(?: international)?(?: {L})?
cc-by-4.0 | 0.97 | cc | {U}(?:a )?cc by {V}4(?: 0)?(?: international)?(?: {L})?
cc-by-nc-nd-4.0 | 0.93 | cc | cc by nc nd {V}4(?: 0)?
cc-by-nc-nd-3.0 | 0.93 | cc | cc by nc nd {V}3(?: 0)?
cc-by-nc-sa-4.0 | 0.93 | cc | cc by nc sa {V}4(?: 0)?
cc-by-nc-sa-3.0 | 0.93 | cc | cc by nc sa {V}3(?: 0)?
cc-by-nc-sa-2.0 | 0.93 | cc | cc by nc sa {V}2(?: [05])?
cc-by-nc-4.0 | 0.93 | cc | cc by nc {V}4(?: 0)?
cc-by-nc-3.0 | 0.93 | cc | cc by nc {V}3(?: 0)?
cc-by-nc-2.0 | 0.93 | cc | cc by nc {V}2(?: [05])?
cc-by-sa-4.0 | 0.93 | cc | cc by sa {V}4(?: 0)?
cc-by-sa-3.0 | 0.93 | cc | cc by sa {V}3(?: 0)?
cc-by-sa-2.0 | 0.93 | cc | cc by sa {V}2(?: [05])?
cc-by-nd-4.0 | 0.93 | cc | cc by nd {V}4(?: 0)?
cc-by-nd-3.0 | 0.93 | cc | cc by nd {V}3(?: 0)?
cc-by-4.0 | 0.93 | cc | cc by {V}4(?: 0)?
cc-by-3.0 | 0.93 | cc | cc by {V}3(?: 0)?
cc-by-2.0 | 0.93 | cc | cc by {V}2(?: [05])?
cc-by-nc-nd | 0.85 | cc | cc by nc nd
cc-by-nc-sa | 0.85 | cc | cc by nc sa
cc-by-nc | 0.85 | cc | cc by nc
cc-by-sa | 0.85 | cc | cc by sa
cc-by-nd | 0.85 | cc | cc by nd
cc-by | 0.8 | cc | cc by
cc0-1.0 | 0.9 | cc0 | cc0(?: {V}1(?: 0)?)?(?: universal)?
cc-by-nc-nd-4.0 | 0.97 | noncommercial | (?:creative commons )?attribution noncommercial no ?derivatives {V}4 0(?: international)?
cc-by-nc-sa-4.0 | 0.97 | noncommercial | (?:creative commons )?attribution noncommercial share ?alike {V}4 0(?: international)?
cc-by-nc-4.0 | 0.97 | noncommercial | (?:creative commons )?attribution noncommercial {V}4 0(?: international)?
cc-by-nc-nd | 0.9 | attribution | (?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: {V}\d 0)?
cc-by-nc-sa | 0.9 | attribution | (?:creative commons )?attribution non ?commercial share ?alike(?: {V}\d 0)?
cc-by-nc | 0.9 | attribution | creative commons attribution non ?commercial(?: {V}\d 0)?
cc-by-sa-4.0 | 0.97 | attribution | (?:creative commons )?attribution share ?alike {V}4 0(?: international)?
cc-by-sa-3.0 | 0.97 | attribution | (?:creative commons )?attribution share ?alike {V}3 0(?: unported)?
cc-by-sa | 0.9 | attribution | creative commons attribution share ?alike
cc-by-nd | 0.9 | attribution | creative commons attribution no ?deriv(?:ative)?s?
cc-by-4.0 | 0.97 | attribution | creative commons attribution {V}4 0(?: international)?
cc-by-3.0 | 0.97 | attribution | creative commons attribution {V}3 0(?: unported)?
cc-by | 0.88 | attribution | creative commons attribution(?: {L})?
cc-by-nc-nd | 0.9 | creativecommons | creativecommons org licenses by nc nd \d \d
cc-by-nc-sa | 0.9 | creativecommons | creativecommons org licenses by nc sa \d \d
cc-by-nc | 0.9 | creativecommons | creativecommons org licenses by nc \d \d
cc-by-sa | 0.9 | creativecommons | creativecommons org licenses by sa \d \d
cc-by-nd | 0.9 | creativecommons | creativecommons org licenses by nd \d \d
cc-by | 0.9 | creativecommons | creativecommons org licenses by \d \d
cc0-1.0 | 0.9 | creativecommons | creativecommons org publicdomain zero 1 0
public-domain | 0.85 | creativecommons | creativecommons org publicdomain mark 1 0
creative-commons | 0.6 | creative | creative commons(?: {L}s?)?
mit-0 | 0.93 | mit | mit no attribution(?: {L})?
mit | 0.97 | mit | {U}mit(?: x11)? {L}
mit | 0.93 | mit | (?:the )?mit {L} mit
mit | 0.9 | mit | (?:the )?mit(?: x11)? {L}
mit | 0.85 | expat | expat {L}
x11 | 0.85 | x11 | x11 {L}
mit | 0.7 | mit | {L} mit
bsd-4-clause | 0.93 | bsd | (?:original|old|(?:4|four) clause) bsd(?: {L})?
bsd-3-clause | 0.95 | bsd | {U}(?:3|three) clause bsd {L}
bsd-3-clause | 0.93 | bsd | (?:(?:3|three) clause|new|modified|revised) bsd(?: {L})?
bsd-3-clause | 0.9 | bsd | bsd (?:3|three) clause(?: {L})?
bsd-2-clause | 0.95 | bsd | {U}(?:2|two) clause bsd {L}
bsd-2-clause | 0.93 | bsd | (?:(?:2|two) clause|simplified) bsd(?: {L})?
bsd-2-clause | 0.93 | freebsd | freebsd {L}
bsd-2-clause | 0.9 | bsd | bsd (?:2|two) clause(?: {L})?
bsd | 0.9 | bsd | {U}bsd(?: style)? {L}
bsd | 0.8 | bsd | bsd(?: style| type)? {L}
isc | 0.9 | isc | isc {L}
zlib | 0.9 | zlib | zlib(?: libpng)? {L}
libpng | 0.9 | libpng | libpng {L}
bsl-1.0 | 0.93 | boost | boost software {L}(?: {V}1 0)?
busl-1.1 | 0.93 | business | business source {L}(?: {V}1 1)?
sspl-1.0 | 0.93 | server | server side public {L}(?: {V}1)?
elastic-2.0 | 0.93 | elastic | elastic {L}(?: {V}2(?: 0)?)?
mpl-2.0 | 0.95 | mozilla | mozilla public {L} {V}2(?: 0)?
mpl-1.1 | 0.95 | mozilla | mozilla public {L} {V}1 1
mpl | 0.85 | mozilla | mozilla public {L}
mpl-2.0 | 0.88 | mpl | mpl {V}2(?: 0)?
epl-2.0 | 0.95 | eclipse | eclipse public {L} {V}2(?: 0)?
epl-1.0 | 0.95 | eclipse | eclipse public {L} {V}1(?: 0)?
epl | 0.85 | eclipse | eclipse public {L}
edl-1.0 | 0.9 | eclipse | eclipse distribution {L}(?: {V}1 0)?
eupl-1.2 | 0.95 | european | european union public {L} {V}1 2
eupl | 0.85 | european | european union public {L}
cddl-1.1 | 0.93 | cddl | cddl {V}1 1
cddl-1.0 | 0.9 | cddl | cddl(?: {V}1 0)?
cddl | 0.85 | development | common development and distribution {L}
cpl-1.0 | 0.85 | common | common public {L}
ipl-1.0 | 0.85 | ibm | ibm public {L}
artistic-2.0 | 0.93 | artistic | artistic {L} {V}2(?: 0)?
artistic-1.0 | 0.88 | artistic | artistic {L}(?: {V}1(?: 0)?)?
unlicense | 0.9 | unlicense | (?:the )?unlicense
wtfpl | 0.9 | wtfpl | wtfpl(?: {V}2)?
beerware | 0.9 | beerware | beerware {L}
postgresql | 0.9 | postgresql | postgresql {L}
openldap | 0.9 | openldap | openldap public {L}
openssl | 0.88 | openssl | openssl {L}
vim | 0.85 | vim | vim {L}
ncsa | 0.9 | ncsa | (?:university of illinois )?ncsa open source {L}
afl-3.0 | 0.9 | academic | academic free {L}(?: {V}3(?: 0)?)?
osl-3.0 | 0.9 | osl,open | (?:osl|open software {L}) {V}3(?: 0)?
upl-1.0 | 0.9 | universal | universal permissive {L}(?: {V}1(?: 0)?)?
mulan-2.0 | 0.9 | mulan | mulan (?:permissive software {L}|psl)(?: {V}2)?
ms-pl | 0.9 | microsoft | microsoft public {L}
ms-rl | 0.9 | microsoft | microsoft reciprocal {L}
qpl-1.0 | 0.85 | qpl,q | (?:qpl(?: {V}1 0)?|q public {L})
cecill-2.1 | 0.9 | cecill | cecill(?: {V}2 1)?
odbl-1.0 | 0.93 | database | open (?:data commons open )?database {L}(?: {V}1 0)?
odc-by-1.0 | 0.93 | commons | open data commons attribution {L}(?: {V}1 0)?
pddl-1.0 | 0.93 | public | (?:open data commons )?public domain dedication and {L}
ogl-uk-3.0 | 0.93 | government | open government {L} {V}3(?: 0)?
ogl-uk | 0.85 | government | open government {L}
cdla-permissive-2.0 | 0.93 | community | community data {L} agreement permissive(?: {V}2 0)?
openrail-m | 0.9 | rail,openrail | (?:creativeml |bigscience |bigcode )?(?:open ?rail|rail)(?: m)?(?: {L})?
ofl-1.1 | 0.9 | font | (?:sil )?open font {L}(?: {V}1 1)?
psf-2.0 | 0.88 | python | python software foundation {L}
php-3.0 | 0.85 | php | php {L}(?: {V}3 0)?
apache-2.0 | 0.9 | apache | apache org licenses {L} 2 0
gpl | 0.8 | gnu | gnu org (?:licenses|copyleft) gpl(?: [0-9 ]+)?(?: html)?
lgpl | 0.8 | gnu | gnu org (?:licenses|copyleft) lgpl(?: [0-9 ]+)?(?: html)?
agpl | 0.8 | gnu | gnu org licenses agpl(?: [0-9 ]+)?(?: html)?
gfdl | 0.8 | gnu | gnu org (?:licenses|copyleft) fdl(?: [0-9 ]+)?(?: html)?
mit | 0.8 | opensource | opensource org licenses mit(?: {L})?(?: php)?
bsd | 0.8 | opensource | opensource org licenses bsd(?: {L}| 2 clause| 3 clause)?(?: php)?
osi-approved | 0.6 | opensource | opensource org licenses [^ ]+
mpl-2.0 | 0.85 | mozilla | mozilla org mpl 2 0
mpl | 0.8 | mozilla | mozilla org mpl(?: mpl 1 1 html)?
bsl-1.0 | 0.85 | boost | boost org {L} 1 0 txt
unlicense | 0.85 | unlicense | unlicense org
ofl-1.1 | 0.85 | sil | scripts sil org ofl
gpl | 0.9 | gpl | {U}(?:gnu )?gpl(?: {L})?
lgpl | 0.9 | lgpl | {U}(?:gnu )?lgpl(?: {L})?
agpl | 0.9 | agpl | {U}(?:gnu )?agpl(?: {L})?
gpl | 0.8 | general | (?:gnu )?general public {L}
gpl | 0.7 | gpl | (?:gnu )?gpl(?: {L})?
lgpl | 0.7 | lgpl | (?:gnu )?lgpl(?: {L})?
agpl | 0.7 | agpl | (?:gnu )?agpl(?: {L})?
apache | 0.8 | apache | apache (?:software )?{L}
gpl | 0.8 | publique | licence publique générale (?:gnu)?
gpl | 0.8 | pública | licencia pública general(?: de)?(?: gnu)?
gpl | 0.8 | allgemeine | gnu allgemeine öffentliche lizenz
unter-lizenz | 0.5 | lizenziert,lizenz | (?:lizenziert unter|unter der lizenz) {W}
sous-licence | 0.5 | licence | (?:sous|publié sous) licence [^ ]+
bajo-licencia | 0.5 | licencia | bajo (?:la )?licencia [^ ]+
public-domain | 0.85 | domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | 0.6 | domain | (?:is|are) in the public domain
public-domain | 0.4 | domain | public domain
commercial | 0.7 | commercial | (?:a )?commercial {L}(?: agreement)?
proprietary | 0.7 | proprietary | proprietary (?:software|{L}|and confidential)
proprietary | 0.7 | confidential | confidential and proprietary
non-commercial | 0.6 | commercial,noncommercial | (?:(?:for )?non ?|not for )commercial use(?: only)?
research-only | 0.6 | research,academic | for (?:academic|research)(?: and (?:academic|research|educational))? (?:purposes|use) only
end-user-license | 0.7 | eula,end | (?:eula|end user {L} agreement)
all-rights-reserved | 0.4 | rights,rechte,droits,derechos | (?:all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados)
copyright | 0.3 | copyright | copyright (?:c )?(?:19|20)\d\d
licensed-under | 0.3 | licensed,licenced | licen[sc]ed under (?:the )?(?:terms of )?(?:the )?[^ ]+ {L}
see-license-file | 0.3 | license,licence,copying | see (?:the )?(?:{L}|copying)(?: txt| md| file)+(?: for (?:more )?(?:details|information))?
license-file | 0.2 | license,licence | {L} (?:file|agreement|terms|notice)
permissive | 0.2 | permissive | permissive (?:open source )?{L}
copyleft | 0.2 | copyleft | copyleft(?: {L})?
open-source-license | 0.2 | open | (?:an )?open source {L}
"""
