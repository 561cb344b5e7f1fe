"""Signature rules of the license scan, in order.

Each line has: label, priority, keyword, regular expression.  They match texts
normalised to lower-case words joined by single spaces (punctuation is gone,
so "2.0" is "2 0"); expressions begin and end at word borders.  A rule is tried
only on texts that contain its keyword, which every match contains; only the
sentence of the Apache license, which other licenses have too, has a keyword
from outside of it.  Priorities: 9 identifiers, 7 full names with version, 5
names, 3 sentences of the license text, 1 hints.

One more rule stands first: the SPDX tag, whose label follows from the
identifier that it is with (``IDENTIFIERS``).
"""

from __future__ import annotations

import re

RULES_TEXT = """
mit | 7 | mit license | (?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit license
mit | 7 | opensource org | opensource org licenses mit(?: license)?(?: php)?
mit | 5 | mit license | mit license(?: mit)?
mit | 5 | expat | expat license
mit | 5 | license mit | license mit
mit | 3 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 3 | above copyright notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 3 | as is | the software is provided as is without warranty of any kind express or implied
mit-0 | 7 | mit no attribution | mit no attribution(?: license)?
x11 | 5 | x11 license | x11 license
x11 | 5 | x consortium license | x consortium license
x11 | 3 | x consortium | name of the x consortium shall not be used in advertising
isc | 7 | isc license | (?:released|licensed|distributed) under (?:the )?(?:terms of )?(?:the )?isc license
isc | 5 | isc license | isc license
isc | 3 | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | 5 | zero clause bsd | zero clause bsd(?: license)?
0bsd | 5 | 0bsd | 0bsd(?: license)?
bsd-2-clause | 7 | bsd | (?:bsd 2 clause|2 clause bsd|two clause bsd)(?: license)?
bsd-2-clause | 7 | simplified bsd | simplified bsd(?: license)?
bsd-2-clause | 7 | freebsd license | freebsd license
bsd-3-clause | 7 | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd)(?: license)?
bsd-3-clause | 7 | bsd | (?:new|modified|revised) bsd(?: license)?
bsd-3-clause | 7 | opensource org | opensource org licenses bsd 3 clause
bsd-3-clause | 3 | neither the name | neither the name of (?:the )?[^ ]+(?: [^ ]+){0,6} nor the names of its contributors may be used to endorse
bsd-4-clause | 7 | bsd | (?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?
bsd-4-clause | 3 | advertising materials | all advertising materials mentioning features or use of this software must display
bsd | 5 | bsd license | bsd license
bsd | 5 | bsd | bsd style license
bsd | 3 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd | 3 | redistributions | redistributions of source code must retain the above copyright notice
bsd | 3 | redistributions | redistributions in binary form must reproduce the above copyright notice
apache-2 | 9 | apache org | (?:www )?apache org licenses license 2 0(?: html| txt)?
apache-2 | 7 | apache license | apache license version 2(?: 0)?
apache-2 | 7 | apache | apache (?:software )?(?:license )?(?:v ?2|2 0|v2 0)(?: license)?
apache-2 | 5 | apache | apache 2 license
apache-2 | 3 | licensed under the apache | you may not use this file except in compliance with the license
apache-1.1 | 7 | apache | apache (?:software )?license version 1 1
apache-1.0 | 7 | apache | apache (?:software )?license version 1 0
apache | 5 | apache | apache (?:software )?(?:foundation )?license
gpl-1.0 | 7 | general public license | (?:gnu )?general public license version 1
gpl-2.0 | 9 | gnu org | gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-2.0 | 7 | general public license | (?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) 2(?: of the license)?
gpl-2.0 | 7 | gpl | (?:gnu )?(?:gpl ?v ?2(?: 0)?|gplv2|gpl version 2|gpl 2 0)
gpl-2.0-or-later | 8 | general public license | (?:gnu )?general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0 | 9 | gnu org | gnu org licenses gpl 3 0(?: html| txt)?
gpl-3.0 | 7 | general public license | (?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) 3(?: of the license)?
gpl-3.0 | 7 | gpl | (?:gnu )?(?:gpl ?v ?3(?: 0)?|gplv3|gpl version 3|gpl 3 0)
gpl-3.0-or-later | 8 | general public license | (?:gnu )?general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl | 5 | general public license | (?:gnu )?general public license
gpl | 5 | gpl | (?:released|licensed|distributed) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
gpl | 3 | free software | this program is free software you can redistribute it and or modify it
gpl | 3 | you should have received | you should have received a copy of the gnu general public license
lgpl-2.0 | 7 | library general public | (?:gnu )?library general public license(?: version 2)?
lgpl-2.1 | 9 | gnu org | gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
lgpl-2.1 | 7 | lesser general public | (?:gnu )?lesser general public license (?:version|v) 2 1
lgpl-2.1 | 7 | lgpl | (?:gnu )?(?:lgpl ?v ?2 1|lgplv2 1|lgpl version 2 1)
lgpl-3.0 | 9 | gnu org | gnu org licenses lgpl 3 0(?: html| txt)?
lgpl-3.0 | 7 | lesser general public | (?:gnu )?lesser general public license (?:version|v) 3(?: 0)?
lgpl-3.0 | 7 | lgpl | (?:gnu )?(?:lgpl ?v ?3(?: 0)?|lgplv3|lgpl version 3)
lgpl | 6 | lesser general public | (?:gnu )?lesser general public license
lgpl | 5 | lgpl | (?:under |the )(?:gnu )?lgpl
lgpl | 3 | this library is free | this library is free software you can redistribute it and or modify it
agpl-3.0 | 9 | gnu org | gnu org licenses agpl 3 0(?: html| txt)?
agpl-3.0 | 7 | affero general public | (?:gnu )?affero general public license (?:version|v) 3(?: 0)?
agpl-3.0 | 7 | agpl | (?:gnu )?(?:agpl ?v ?3(?: 0)?|agplv3|agpl version 3)
agpl | 6 | affero general public | (?:gnu )?affero general public license
gfdl-1.2 | 7 | free documentation license | (?:gnu )?free documentation license version 1 2
gfdl-1.3 | 7 | free documentation license | (?:gnu )?free documentation license version 1 3
gfdl | 5 | free documentation license | (?:gnu )?free documentation license
gfdl | 3 | invariant sections | with no invariant sections no front cover texts and no back cover texts
mpl-1.0 | 7 | mozilla public | mozilla public license version 1 0
mpl-1.1 | 7 | mozilla public | mozilla public license version 1 1
mpl-2.0 | 9 | mozilla org | (?:www )?mozilla org (?:en us )?mpl 2 0
mpl-2.0 | 7 | mozilla public | mozilla public license (?:version|v) 2(?: 0)?
mpl-2.0 | 3 | source code form | this source code form is subject to the terms of the mozilla public license
mpl | 5 | mozilla public | mozilla public license
epl-1.0 | 7 | eclipse public | eclipse public license (?:version |v ?)?1 0
epl-2.0 | 7 | eclipse public | eclipse public license (?:version |v ?)?2 0
epl-2.0 | 7 | eclipse org | (?:www )?eclipse org legal epl 2 0
epl | 5 | eclipse public | eclipse public license
cddl | 5 | common development and distribution | common development and distribution license(?: version 1 [01])?
cpl-1.0 | 5 | common public license | common public license(?: version 1 0)?
eupl | 5 | european union public | european union public licen[cs]e(?: version 1 [0-9])?
osl-3.0 | 5 | open software license | open software license(?: version)?(?: 3 0)?
afl-3.0 | 5 | academic free license | academic free license(?: version)?(?: 3 0)?
artistic-2.0 | 7 | artistic license | artistic license (?:version )?2 0
artistic | 5 | artistic license | (?:perl )?artistic license
zlib | 5 | zlib | zlib(?: libpng)? license
zlib | 3 | origin of this software | the origin of this software must not be misrepresented
libpng | 5 | libpng | libpng license
bsl-1.0 | 7 | boost software | boost software license(?: version 1 0)?
bsl-1.0 | 7 | boost org | (?:www )?boost org license 1 0 txt
busl-1.1 | 7 | business source | business source license(?: version)?(?: 1 1)?
sspl-1.0 | 7 | server side public | server side public license(?: version 1)?
elastic-2.0 | 7 | elastic license | elastic license(?: version)?(?: 2 0)?
ncsa | 5 | ncsa | (?:university of illinois )?ncsa (?:open source )?license
postgresql | 5 | postgresql licen | postgresql licen[cs]e
python-2.0 | 5 | python software foundation | python software foundation license(?: version 2)?
php-3.01 | 5 | php license | php license(?: version)?(?: 3 0?1)?
ruby | 5 | ruby license | ruby license
openssl | 5 | openssl license | openssl license
unlicense | 7 | unlicense | (?:released|licensed|dedicated) under the unlicense
unlicense | 7 | unlicense org | (?:www )?unlicense org
unlicense | 5 | the unlicense | the unlicense
unlicense | 3 | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 5 | wtfpl | wtfpl(?: license)?
beerware | 5 | beer ware | beer ware license
cc0-1.0 | 9 | creativecommons org | creativecommons org publicdomain zero 1 0
cc0-1.0 | 7 | cc0 | cc0(?: 1 0)?(?: universal)?(?: license)?
cc0-1.0 | 7 | creative commons zero | creative commons zero(?: license)?
cc-by | 9 | creativecommons org | creativecommons org licenses by [1-4] 0
cc-by | 7 | creative commons attribution | creative commons attribution (?:[1-4] 0 )?(?:international |unported |generic )?(?:public )?license
cc-by | 5 | cc by | (?:licensed |released |under |the )+cc by(?: [1-4] 0)?
cc-by | 4 | cc by | cc by [1-4] 0
cc-by-sa | 9 | creativecommons org | creativecommons org licenses by sa [1-4] 0
cc-by-sa | 7 | creative commons attribution | creative commons attribution share ?alike(?: [1-4] 0)?(?: international| unported)?(?: license)?
cc-by-sa | 7 | cc by sa | cc by sa(?: [1-4] 0)?
cc-by-nc | 9 | creativecommons org | creativecommons org licenses by nc [1-4] 0
cc-by-nc | 7 | creative commons attribution | creative commons attribution non ?commercial(?: [1-4] 0)?(?: international| unported)?(?: license)?
cc-by-nc | 6 | cc by nc | cc by nc(?: [1-4] 0)?
cc-by-nd | 9 | creativecommons org | creativecommons org licenses by nd [1-4] 0
cc-by-nd | 7 | creative commons attribution | creative commons attribution no ?deriv(?:s|atives)(?: [1-4] 0)?(?: license)?
cc-by-nd | 7 | cc by nd | cc by nd(?: [1-4] 0)?
cc-by-nc-sa | 9 | creativecommons org | creativecommons org licenses by nc sa [1-4] 0
cc-by-nc-sa | 8 | creative commons attribution | creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?(?: license)?
cc-by-nc-sa | 8 | cc by nc | cc by nc sa(?: [1-4] 0)?
cc-by-nc-nd | 9 | creativecommons org | creativecommons org licenses by nc nd [1-4] 0
cc-by-nc-nd | 8 | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1-4] 0)?(?: license)?
cc-by-nc-nd | 8 | cc by nc | cc by nc nd(?: [1-4] 0)?
creative-commons | 2 | creative commons | creative commons licen[cs]e
odbl-1.0 | 7 | open database license | open database license(?: odbl)?
odbl-1.0 | 7 | opendatacommons | opendatacommons org licenses odbl
odc-by-1.0 | 7 | open data commons | open data commons attribution license
pddl-1.0 | 7 | public domain dedication | public domain dedication and license
ofl-1.1 | 7 | open font license | (?:sil )?open font license(?: version 1 1)?
ogl-uk-3.0 | 7 | open government licen | open government licen[cs]e(?: v ?3 0)?
ms-pl | 7 | microsoft public | microsoft public license
ms-rl | 7 | microsoft reciprocal | microsoft reciprocal license
ecl-2.0 | 7 | educational community | educational community license(?: version 2 0)?
upl-1.0 | 7 | universal permissive | universal permissive license(?: version)?(?: v ?1 0)?
mulanpsl-2.0 | 7 | mulan psl | mulan psl v ?2
public-domain | 3 | public domain | (?:is |are |placed |released |dedicated )(?:in|into|to) the public domain
vim | 5 | vim license | vim license
w3c | 5 | w3c software | w3c software (?:notice and )?license
ipl-1.0 | 5 | ibm public | ibm public license(?: version 1 0)?
qpl-1.0 | 5 | q public | q public license
apsl-2.0 | 5 | apple public | apple public source license
llama-community | 7 | community license | llama [0-9](?: [0-9])? community license(?: agreement)?
openrail | 7 | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: m| s| d)?(?: license)?
openrail | 7 | open rail | (?:creativeml |bigscience |bigcode )?open rail(?: m| s| d)?(?: license)?
commons-clause | 5 | commons clause | commons clause(?: license)?(?: condition)?
proprietary | 5 | all rights reserved | (?:copyright (?:c )?)?(?:[0-9]{4} )?all rights reserved
proprietary | 3 | confidential | proprietary and confidential
proprietary | 3 | may not be reproduced | may not be reproduced (?:or distributed )?without (?:prior )?(?:written )?permission
proprietary | 3 | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
copyright-notice | 1 | copyright | copyright (?:c )?(?:19|20)[0-9]{2}(?: [^ ]+){0,3}
unknown-license | 1 | licensed under | licensed under (?:the )?(?!(?:gnu |new |simplified |modified )?(?:mit|apache|bsd|isc|x11|gpl|lgpl|agpl|general|lesser|affero|mozilla|eclipse|creative|boost|artistic|zlib|python|php) )[^ ]+(?: [^ ]+)? license
unknown-license | 1 | license for | see (?:the )?license for (?:more )?(?:details|information)
unknown-license | 1 | license file for | see (?:the )?license file for (?:more )?(?:details|information)
mit | 3 | without restriction including | deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | 3 | authors or copyright holders | in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit | 7 | mit license | licensed under either of (?:the )?mit license
isc | 3 | author disclaims all warranties | the software is provided as is and the author disclaims all warranties with regard to this software
bsd-3-clause | 3 | specific prior written permission | endorse or promote products derived from this software without specific prior written permission
bsd | 3 | copyright holders and contributors | this software is provided by the copyright holders and contributors as is and any express or implied warranties
bsd | 3 | or contributors be liable | in no event shall the copyright (?:holder|owner) or contributors be liable
bsd | 5 | license bsd | license bsd
apache-2 | 7 | apache license | licensed under either of (?:the )?apache license version 2 0
apache-2 | 3 | on an as is basis | software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-2 | 3 | governing permissions | see the license for the specific language governing permissions and limitations under the license
apache-2 | 3 | irrevocable copyright license | hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2 | 5 | license apache | license apache(?: software license)?(?: 2 0)?
llvm-exception | 7 | llvm exception | with llvm exceptions?
gpl | 3 | in the hope that it will be useful | this program is distributed in the hope that it will be useful but without any warranty
gpl | 3 | general public license for more details | see the gnu general public license for more details
gpl | 3 | licenses for most software | the licenses for most software are designed to take away your freedom to share and change it
gpl | 5 | license gpl | license gpl
gnu-license-document | 3 | of this license document | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
lgpl | 3 | copy of the gnu lesser general public | you should have received a copy of the gnu lesser general public license
lgpl | 3 | lesser general public license for more details | see the gnu lesser general public license for more details
lgpl | 5 | license lgpl | license lgpl
agpl | 3 | copy of the gnu affero general public | you should have received a copy of the gnu affero general public license
agpl | 3 | interacting with it remotely | must prominently offer all users interacting with it remotely through a computer network
classpath-exception | 7 | classpath exception | classpath exception
classpath-exception | 3 | making a combined work | linking this library statically or dynamically with other modules is making a combined work based on this library
gcc-exception | 7 | gcc runtime library exception | gcc runtime library exception
gfdl | 3 | permission is granted to copy distribute | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2.0 | 3 | copy of the mpl | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2.0 | 3 | incompatible with secondary licenses | this source code form is incompatible with secondary licenses
mpl-1.1 | 8 | subject to the mozilla public | the contents of this file are subject to the mozilla public license version 1 1
epl | 3 | accompanying materials are made available under | this program and the accompanying materials are made available under the terms of the eclipse public license
cddl | 3 | common development and distribution | the contents of this file are subject to the terms of the common development and distribution license
cddl | 3 | cddl header | include this cddl header notice in each file
artistic | 3 | a package may be copied | the conditions under which a package may be copied
zlib | 3 | authors be held liable | in no event will the authors be held liable for any damages arising from the use of this software
zlib | 3 | altered source versions | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | 3 | this notice may not be removed | this notice may not be removed or altered from any source distribution
bsl-1.0 | 3 | any person or organization | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
unlicense | 3 | anyone is free to copy | anyone is free to copy modify publish use compile sell or distribute this software
unlicense | 3 | copyright interest in the software | we dedicate any and all copyright interest in the software to the public domain
cc0-1.0 | 3 | work to the public domain | associated a work with this deed has dedicated the work to the public domain
cc0-1.0 | 3 | related or neighboring rights | waived all copyright and related or neighboring rights
cc-by | 3 | give appropriate credit | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-sa | 3 | under the same license as the original | you must distribute your contributions under the same license as the original
cc-by-nc | 3 | material for commercial purposes | you may not use the material for commercial purposes
cc-by-nd | 3 | distribute the modified material | you may not distribute the modified material
public-domain-mark | 7 | public domain mark | public domain mark(?: 1 0)?
public-domain | 3 | no rights reserved | no rights reserved
public-domain | 3 | not subject to copyright | not subject to copyright protection(?: in the united states)?
wtfpl | 3 | license document and changing it | license document and changing it is allowed as long as the name is changed
beerware | 3 | retain this notice | as long as you retain this notice you can do whatever you want with this stuff
ofl-1.1 | 3 | copy of the font software | permission is hereby granted free of charge to any person obtaining a copy of the font software
ofl-1.1 | 3 | fonts and derivatives however | the fonts and derivatives however cannot be released under any other type of license
odbl-1.0 | 3 | database contents license | any rights in individual contents of the database are licensed under the database contents license
eupl | 5 | eupl | eupl(?: v ?1 [0-9])?
busl-1.1 | 3 | non production use | redistribute and make non production use of the licensed work
busl-1.1 | 3 | publicly available distribution | fourth anniversary of the first publicly available distribution
sspl-1.0 | 3 | third parties as a service | make the functionality of the program or a modified version available to third parties as a service
elastic-2.0 | 3 | hosted or managed service | you may not provide the software to third parties as a hosted or managed service
ms-pl | 3 | this license governs use | this license governs use of the accompanying software
python-2.0 | 3 | psf is making python available | psf is making python available to licensee on an as is basis
openssl | 3 | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
php-3.01 | 3 | includes php software | this product includes php software freely available from
postgresql | 3 | without a written agreement | for any purpose without fee and without a written agreement is hereby granted
w3c | 3 | software or document includes | this software or document includes material copied from or derived from
json | 3 | used for good not evil | the software shall be used for good not evil
cecill | 7 | cecill | cecill(?: b| c)?(?: 2 [01])?(?: free software)? license(?: agreement)?
lppl | 5 | latex project public | latex project public license(?: version 1 [0-9][a-c]?)?
npl-1.1 | 5 | netscape public | netscape public license(?: version 1 [01])?
sissl | 5 | sun industry standards | sun industry standards source license
sleepycat | 5 | sleepycat | sleepycat (?:software )?license
watcom-1.0 | 5 | open watcom public | sybase open watcom public license
nasa-1.3 | 5 | nasa open source agreement | nasa open source agreement
rpl-1.5 | 5 | reciprocal public license | reciprocal public license(?: 1 5)?
opl-1.0 | 5 | open publication license | open publication license
free-art | 5 | free art license | free art license
hippocratic | 5 | hippocratic license | hippocratic license(?: version)?(?: [1-3] [0-9])?
polyform | 5 | polyform | polyform (?:noncommercial|small business|shield|strict|perimeter|internal use) license
parity | 5 | parity public license | parity public license
prosperity | 5 | prosperity public license | prosperity public license
fsl-1.1 | 5 | functional source license | functional source license(?: version)?(?: 1 1)?
confluent | 5 | confluent community license | confluent community license(?: agreement)?
rsal | 5 | redis source available | redis source available license
tsl | 5 | timescale license | timescale license(?: agreement)?
etalab-2.0 | 5 | licence ouverte | licence ouverte(?: open licence)?(?: etalab)?
cdla | 5 | community data license agreement | community data license agreement (?:permissive|sharing)(?: version)?(?: [12] 0)?
gemma | 5 | gemma terms of use | gemma terms of use
acceptable-use | 3 | acceptable use policy | llama [0-9](?: [0-9])? acceptable use policy
proprietary | 3 | may be reproduced | no part of this (?:publication|book|document|work) may be reproduced
proprietary | 3 | proprietary | the (?:confidential and )?proprietary (?:information|property) of
proprietary | 3 | internal use only | for internal use only
proprietary | 3 | evaluation purposes only | for evaluation purposes only
proprietary | 3 | distribution is strictly prohibited | disclosure copying or distribution is strictly prohibited
proprietary | 2 | permission of the publisher | (?:with|without) (?:the )?(?:prior )?(?:written )?permission of the publisher
dual-license | 2 | dual licensed under | dual licensed under
"""

#: label, and the identifier in normalised words.
IDENTIFIERS_TEXT = """
mit | mit
mit-0 | mit 0
x11 | x11
isc | isc
0bsd | 0bsd
bsd-2-clause | bsd 2 clause
bsd-3-clause | bsd 3 clause
bsd-4-clause | bsd 4 clause
apache-2 | apache 2 0
apache-1.1 | apache 1 1
apache-1.0 | apache 1 0
gpl-1.0 | gpl 1 0(?: only| or later)?
gpl-2.0 | gpl 2 0(?: only)?
gpl-2.0-or-later | gpl 2 0 or later
gpl-3.0 | gpl 3 0(?: only)?
gpl-3.0-or-later | gpl 3 0 or later
lgpl-2.0 | lgpl 2 0(?: only| or later)?
lgpl-2.1 | lgpl 2 1(?: only| or later)?
lgpl-3.0 | lgpl 3 0(?: only| or later)?
agpl-1.0 | agpl 1 0(?: only| or later)?
agpl-3.0 | agpl 3 0(?: only| or later)?
gfdl-1.1 | gfdl 1 1(?: only| or later)?
gfdl-1.2 | gfdl 1 2(?: only| or later)?
gfdl-1.3 | gfdl 1 3(?: only| or later)?
mpl-1.0 | mpl 1 0
mpl-1.1 | mpl 1 1
mpl-2.0 | mpl 2 0
epl-1.0 | epl 1 0
epl-2.0 | epl 2 0
cddl-1.0 | cddl 1 0
cddl-1.1 | cddl 1 1
cpl-1.0 | cpl 1 0
eupl-1.1 | eupl 1 1
eupl-1.2 | eupl 1 2
osl-3.0 | osl 3 0
afl-3.0 | afl 3 0
artistic-1.0 | artistic 1 0
artistic-2.0 | artistic 2 0
zlib | zlib
libpng | libpng(?: 2 0)?
bsl-1.0 | bsl 1 0
busl-1.1 | busl 1 1
sspl-1.0 | sspl 1 0
elastic-2.0 | elastic 2 0
ncsa | ncsa
postgresql | postgresql
python-2.0 | (?:python|psf) 2 0
php-3.01 | php 3 0?1
ruby | ruby
openssl | openssl
unlicense | unlicense
wtfpl | wtfpl
beerware | beerware
cc0-1.0 | cc0 1 0
cc-by | cc by [1-4] 0
cc-by-sa | cc by sa [1-4] 0
cc-by-nc | cc by nc [1-4] 0
cc-by-nd | cc by nd [1-4] 0
cc-by-nc-sa | cc by nc sa [1-4] 0
cc-by-nc-nd | cc by nc nd [1-4] 0
odbl-1.0 | odbl 1 0
odc-by-1.0 | odc by 1 0
pddl-1.0 | pddl 1 0
ofl-1.1 | ofl 1 1
ogl-uk-3.0 | ogl uk [1-3] 0
ms-pl | ms pl
ms-rl | ms rl
ecl-2.0 | ecl 2 0
upl-1.0 | upl 1 0
mulanpsl-2.0 | mulanpsl 2 0
vim | vim
w3c | w3c
ipl-1.0 | ipl 1 0
qpl-1.0 | qpl 1 0
apsl-2.0 | apsl 2 0
"""

#: Label of the rule whose matches name their label.
NAMED = "*"
TAG = "spdx license identifier "


def identifiers() -> dict[str, str]:
    """Normalised SPDX identifier -> label."""
    out = {}
    for line in IDENTIFIERS_TEXT.strip().splitlines():
        label, pattern = line.split(" | ", 1)
        for form in _forms(pattern):
            out[form] = label
    return out


def _forms(pattern: str) -> list[str]:
    """The texts of a pattern of optional groups, alternatives and ranges of
    digits, none of them nested."""
    found = re.search(r"\(\?:([^()]*)\)(\??)|\[(\d)-(\d)\]|(\d)\?", pattern)
    if not found:
        return [pattern]
    group, optional, low, high, digit = found.groups()
    parts = group.split("|") if group is not None else list(map(str, range(int(low), int(high) + 1))) if low else [digit]
    if optional or digit:
        parts = [*parts, ""]
    return [x for p in parts for x in _forms(pattern[: found.start()] + p + pattern[found.end() :])]


def rules() -> list[tuple[str, int, str, str]]:
    names = sorted(identifiers(), key=lambda x: (-len(x), x))
    out = [(NAMED, 9, "spdx", TAG + "(?:" + "|".join(names) + ")")]
    for line in RULES_TEXT.strip().splitlines():
        label, priority, keyword, pattern = (x.strip() for x in line.split(" | ", 3))
        out.append((label, int(priority), keyword, pattern))
    return out
