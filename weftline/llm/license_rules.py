"""Signature rules for licenses: label | kind | regex, one a line.

A space in a regex stands for one or more characters that are no word characters, " ?" for any number of them, so that
line breaks, indents and comment marks don't matter. Texts are lower-cased in A-Z before matching. The literals of a
regex outside groups and classes are in every match; they gate it.
"""

#: kind: (priority, confidence)
KINDS = {"spdx": (5, 1.0), "text": (4, 0.95), "notice": (3, 0.9), "url": (2, 0.85), "name": (1, 0.7), "hint": (0, 0.3)}

RULES = r"""
mit | text | permission is hereby granted free of charge to any person obtaining a copy
mit | text | to deal in the software without restriction including without limitation
mit | text | shall be included in all copies or substantial portions of the software
mit | notice | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mit license
mit | notice | the mit license mit
mit | name | \bmit license\b
mit | name | \bexpat license\b
mit | spdx | spdx license identifier mit(?![\w.-])
mit | url | opensource\.org/licenses/mit(?!-)
mit | url | choosealicense\.com/licenses/mit\b
mit-0 | name | \bmit no attribution\b
mit-0 | spdx | spdx license identifier mit 0\b
mit-0 | url | licenses/mit-0\b
x11 | name | \bx11 license\b
x11 | name | \bx consortium license\b
x11 | text | name of the x consortium shall not be used in advertising
apache-2.0 | text | licensed under the apache license version 2 0
apache-2.0 | text | you may not use this file except in compliance with the license
apache-2.0 | text | apache license version 2 0 january 2004
apache-2.0 | name | \bapache license (?:v|version )?2(?: 0)?\b
apache-2.0 | name | \bapache software license (?:v|version )?2(?: 0)?\b
apache-2.0 | spdx | spdx license identifier apache 2 0
apache-2.0 | name | \bapache-2\.0\b
apache-2.0 | url | apache\.org/licenses/license-2\.0
apache-1.1 | name | \bapache software license version 1 1\b
apache-1.1 | url | apache\.org/licenses/license-1\.1
apache-1.0 | name | \bapache license version 1 0\b
apache-1.0 | url | apache\.org/licenses/license-1\.0
apache | name | \bapache license\b
apache | notice | licensed to the apache software foundation asf under one or more
gpl-2.0 | text | gnu general public license version 2 june 1991
gpl-2.0 | name | general public license (?:as published by the free software foundation )?(?:v|version )2(?: 0)?\b
gpl-2.0 | name | \bgplv2\b
gpl-2.0 | name | \bgpl-2\.0(?:-only)?\b
gpl-2.0 | spdx | spdx license identifier gpl 2 0(?: only)?\b
gpl-2.0 | url | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-2.0 | url | gnu\.org/licenses/old-licenses/gpl-2\.0
gpl-2.0-or-later | notice | either version 2 of the license or at your option any later version
gpl-2.0-or-later | spdx | spdx license identifier gpl 2 0 or later
gpl-2.0-or-later | name | \bgpl-2\.0\+
gpl-3.0 | text | gnu general public license version 3 29 june 2007
gpl-3.0 | name | general public license (?:as published by the free software foundation )?(?:v|version )3(?: 0)?\b
gpl-3.0 | name | \bgplv3\b
gpl-3.0 | name | \bgpl-3\.0(?:-only)?\b
gpl-3.0 | spdx | spdx license identifier gpl 3 0(?: only)?\b
gpl-3.0 | url | gnu\.org/licenses/gpl-3\.0
gpl-3.0-or-later | notice | either version 3 of the license or at your option any later version
gpl-3.0-or-later | spdx | spdx license identifier gpl 3 0 or later
gpl-3.0-or-later | name | \bgpl-3\.0\+
gpl | name | \bgeneral public license\b
gpl | notice | redistribute it and or modify it under the terms of the gnu general public license
gpl | url | gnu\.org/licenses/gpl\b
gpl | url | gnu\.org/copyleft/gpl
gpl | name | \bgnu gpl\b
lgpl-2.1 | text | gnu lesser general public license version 2 1 february 1999
lgpl-2.1 | name | lesser general public license (?:v|version )2 1\b
lgpl-2.1 | name | \blgpl-2\.1\b
lgpl-2.1 | name | \blgplv2\.1\b
lgpl-2.1 | spdx | spdx license identifier lgpl 2 1
lgpl-2.1 | url | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-3.0 | name | lesser general public license (?:v|version )3(?: 0)?\b
lgpl-3.0 | name | \blgplv3\b
lgpl-3.0 | name | \blgpl-3\.0\b
lgpl-3.0 | spdx | spdx license identifier lgpl 3 0
lgpl-3.0 | url | gnu\.org/licenses/lgpl-3\.0
lgpl-2.0 | name | \blibrary general public license\b
lgpl-2.0 | spdx | spdx license identifier lgpl 2 0
lgpl | name | \blesser general public license\b
lgpl | name | \bgnu lgpl\b
agpl-3.0 | text | gnu affero general public license version 3 19 november 2007
agpl-3.0 | name | affero general public license (?:v|version )3(?: 0)?\b
agpl-3.0 | name | \bagplv3\b
agpl-3.0 | name | \bagpl-3\.0\b
agpl-3.0 | spdx | spdx license identifier agpl 3 0
agpl-3.0 | url | gnu\.org/licenses/agpl-3\.0
agpl | name | \baffero general public license\b
gfdl | name | \b(?:gnu )?free documentation license\b
gfdl-1.3 | name | free documentation license version 1 3\b
gfdl-1.2 | name | free documentation license version 1 2\b
gfdl | url | gnu\.org/licenses/fdl
gfdl | url | gnu\.org/copyleft/fdl
gfdl-1.3 | spdx | spdx license identifier gfdl 1 3
bsd-2-clause | name | \b2-clause bsd\b
bsd-2-clause | name | \bbsd-2-clause\b
bsd-2-clause | name | \bsimplified bsd license\b
bsd-2-clause | name | \bfreebsd license\b
bsd-2-clause | spdx | spdx license identifier bsd 2 clause
bsd-2-clause | url | opensource\.org/licenses/bsd-2-clause
bsd-3-clause | name | \b3-clause bsd\b
bsd-3-clause | name | \bbsd-3-clause\b
bsd-3-clause | name | \bnew bsd license\b
bsd-3-clause | name | \bmodified bsd license\b
bsd-3-clause | name | \brevised bsd license\b
bsd-3-clause | text | neither the names? of .{1,120}? may be used to endorse or promote products
bsd-3-clause | spdx | spdx license identifier bsd 3 clause
bsd-3-clause | url | opensource\.org/licenses/bsd-3-clause
bsd-4-clause | name | \boriginal bsd license\b
bsd-4-clause | name | \bbsd-4-clause\b
bsd-4-clause | text | all advertising materials mentioning features or use of this software
bsd-4-clause | spdx | spdx license identifier bsd 4 clause
bsd | text | redistribution and use in source and binary forms with or without modification are permitted
bsd | text | redistributions of source code must retain the above copyright notice
bsd | text | redistributions in binary form must reproduce the above copyright notice
bsd | name | \bbsd license\b
bsd | name | \bbsd-style license\b
0bsd | name | \b0bsd\b
0bsd | name | \bzero-clause bsd\b
0bsd | spdx | spdx license identifier 0bsd\b
isc | name | \bisc license\b
isc | text | permission to use copy modify and or distribute this software for any purpose with or without fee
isc | spdx | spdx license identifier isc\b
isc | url | opensource\.org/licenses/isc\b
mpl-2.0 | text | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | name | mozilla public license (?:v|version )? ?2 0\b
mpl-2.0 | name | \bmpl-2\.0\b
mpl-2.0 | name | \bmpl 2 0\b
mpl-2.0 | spdx | spdx license identifier mpl 2 0
mpl-2.0 | url | mozilla\.org/(?:en-us/)?mpl/2\.0
mpl-1.1 | name | mozilla public license version 1 1\b
mpl-1.1 | spdx | spdx license identifier mpl 1 1
mpl-1.1 | url | mozilla\.org/mpl/mpl-1\.1
mpl | name | \bmozilla public license\b
epl-1.0 | name | eclipse public license (?:v|version )?1 0\b
epl-1.0 | url | eclipse\.org/legal/epl-v10
epl-1.0 | spdx | spdx license identifier epl 1 0
epl-2.0 | name | eclipse public license (?:v|version )?2 0\b
epl-2.0 | url | eclipse\.org/legal/epl-2\.0
epl-2.0 | url | eclipse\.org/legal/epl-v20
epl-2.0 | spdx | spdx license identifier epl 2 0
epl | name | \beclipse public license\b
edl-1.0 | name | \beclipse distribution license\b
cddl-1.0 | name | common development and distribution license (?:cddl )?(?:v|version )1 0\b
cddl-1.1 | name | common development and distribution license (?:cddl )?(?:v|version )1 1\b
cddl | name | \bcommon development and distribution license\b
cddl-1.0 | spdx | spdx license identifier cddl 1 0
cpl-1.0 | name | \bcommon public license\b
cpl-1.0 | spdx | spdx license identifier cpl 1 0
ibm-public-1.0 | name | \bibm public license\b
eupl-1.2 | name | european union public licen[cs]e (?:eupl )?(?:v|version )? ?1 2\b
eupl-1.1 | name | european union public licen[cs]e (?:eupl )?(?:v|version )? ?1 1\b
eupl | name | \beuropean union public licen[cs]e\b
eupl-1.2 | spdx | spdx license identifier eupl 1 2
cecill-2.1 | name | \bcecill(?: free software license agreement)? (?:v|version )? ?2 1\b
cecill-b | name | \bcecill-b\b
cecill-c | name | \bcecill-c\b
cecill | name | \bcecill licen[cs]e\b
artistic-2.0 | name | artistic license (?:v|version )? ?2(?: 0)?\b
artistic-1.0 | name | artistic license (?:v|version )? ?1 0\b
artistic | name | \bartistic license\b
artistic-2.0 | spdx | spdx license identifier artistic 2 0
artistic-2.0 | url | licenses/artistic-2\.0
perl | notice | (?:redistribute it and or modify it )?under the same terms as perl itself
bsl-1.0 | name | \bboost software license\b
bsl-1.0 | spdx | spdx license identifier bsl 1 0
bsl-1.0 | url | boost\.org/license_1_0
zlib | text | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | text | altered source versions must be plainly marked as such
zlib | name | \bzlib(?: libpng)? license\b
zlib | spdx | spdx license identifier zlib\b
libpng | name | \blibpng license\b
unlicense | text | this is free and unencumbered software released into the public domain
unlicense | url | \bunlicense\.org\b
unlicense | name | \bthe unlicense\b
unlicense | spdx | spdx license identifier unlicense\b
wtfpl | name | \bwtfpl\b
wtfpl | text | do what the fuck you want to public license
public-domain | notice | (?:dedicated|released|placed|donated) (?:in|to|into) the public domain
public-domain | hint | \bpublic domain\b
cc0-1.0 | url | creativecommons\.org/publicdomain/zero/1\.0
cc0-1.0 | name | \bcc0(?: 1 0)?\b
cc0-1.0 | spdx | spdx license identifier cc0 1 0
cc0-1.0 | text | creative commons legal code cc0 1 0 universal
cc-pdm | url | creativecommons\.org/publicdomain/mark/1\.0
cc-by-4.0 | url | creativecommons\.org/licenses/by/4\.0
cc-by-3.0 | url | creativecommons\.org/licenses/by/3\.0
cc-by-2.5 | url | creativecommons\.org/licenses/by/2\.5
cc-by-2.0 | url | creativecommons\.org/licenses/by/2\.0
cc-by-sa-4.0 | url | creativecommons\.org/licenses/by-sa/4\.0
cc-by-sa-3.0 | url | creativecommons\.org/licenses/by-sa/3\.0
cc-by-sa-2.5 | url | creativecommons\.org/licenses/by-sa/2\.5
cc-by-nc-4.0 | url | creativecommons\.org/licenses/by-nc/4\.0
cc-by-nc-3.0 | url | creativecommons\.org/licenses/by-nc/3\.0
cc-by-nd-4.0 | url | creativecommons\.org/licenses/by-nd/4\.0
cc-by-nc-sa-4.0 | url | creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-sa-3.0 | url | creativecommons\.org/licenses/by-nc-sa/3\.0
cc-by-nc-nd-4.0 | url | creativecommons\.org/licenses/by-nc-nd/4\.0
cc-by-nc-nd-3.0 | url | creativecommons\.org/licenses/by-nc-nd/3\.0
cc-by-4.0 | name | \bcc by 4 0\b
cc-by-4.0 | name | \bcc-by-4\.0\b
cc-by-sa-4.0 | name | \bcc by sa 4 0\b
cc-by-sa-4.0 | name | \bcc-by-sa-4\.0\b
cc-by-sa-3.0 | name | \bcc by sa 3 0\b
cc-by-nc-4.0 | name | \bcc by nc 4 0\b
cc-by-nc-sa-4.0 | name | \bcc by nc sa 4 0\b
cc-by-4.0 | name | creative commons attribution 4 0 international
cc-by-sa-4.0 | name | creative commons attribution sharealike 4 0 international
cc-by-sa-3.0 | name | creative commons attribution sharealike 3 0 unported
cc-by-nc-4.0 | name | creative commons attribution noncommercial 4 0 international
cc-by-nc-sa-4.0 | name | creative commons attribution noncommercial sharealike 4 0 international
cc-by-nd-4.0 | name | creative commons attribution noderivatives 4 0 international
cc | name | \bcreative commons(?: attribution)?(?: [a-z]+)? licen[cs]e\b
cc | hint | \bcreative commons\b
odbl-1.0 | name | \bopen database license\b
odbl-1.0 | url | opendatacommons\.org/licenses/odbl
odc-by-1.0 | name | \bopen data commons attribution license\b
odc-by-1.0 | url | opendatacommons\.org/licenses/by\b
pddl-1.0 | name | \bpublic domain dedication and license\b
pddl-1.0 | url | opendatacommons\.org/licenses/pddl
ogl-uk-3.0 | name | \bopen government licence(?: v3 0)?\b
cdla-permissive-2.0 | name | community data license agreement permissive(?: version)? 2 0\b
cdla-sharing-1.0 | name | community data license agreement sharing\b
psf-2.0 | name | \bpython software foundation license\b
psf-2.0 | spdx | spdx license identifier psf 2 0
php-3.01 | name | \bphp license(?: version 3 01)?\b
php-3.01 | url | php\.net/license/3_01
ruby | name | \bruby license\b
openssl | name | \bopenssl license\b
openssl | text | product includes software developed by the openssl project
curl | name | \bcurl license\b
postgresql | name | \bpostgresql licen[cs]e\b
ncsa | name | \buniversity of illinois ncsa open source license\b
upl-1.0 | name | \buniversal permissive license\b
upl-1.0 | url | oss\.oracle\.com/licenses/upl
afl-3.0 | name | academic free license(?: (?:v|version )? ?3 0)?\b
osl-3.0 | name | open software license (?:v|version )? ?3 0\b
ms-pl | name | \bmicrosoft public license\b
ms-rl | name | \bmicrosoft reciprocal license\b
ofl-1.1 | name | (?:sil )?open font license(?: version 1 1)?\b
ofl-1.1 | url | scripts\.sil\.org/ofl
vim | name | \bvim license\b
w3c | name | \bw3c software(?: notice)?(?: and)?(?: document)? license\b
json | text | the software shall be used for good not evil
beerware | name | \bbeer ware license\b
bsl-1.1 | name | \bbusiness source license(?: 1 1)?\b
sspl-1.0 | name | \bserver side public license\b
elastic-2.0 | name | \belastic license(?: 2 0)?\b
polyform | name | \bpolyform (?:noncommercial|shield|small business|strict|perimeter|internal use)\b
commons-clause | name | \bcommons clause\b
openrail | name | \b(?:bigscience |creativeml )?open ?rail(?: ?[ms]{1,2})?\b
llama-community | name | \bllama (?:\d(?: \d)? )?community license\b
proprietary | notice | \ball rights reserved\b
proprietary | notice | \bproprietary and confidential\b
proprietary | notice | \bunauthorized copying of this file\b
"""
