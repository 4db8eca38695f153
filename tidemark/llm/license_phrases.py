"""Hand-written signature phrases of licenses: sentences of their texts, notices, and ways in which people name them.

One line a rule: name; license; priority; keyword; pattern. A blank in a pattern is a gap between words, across line breaks and comment
marks; the rest is a regular expression that ignores case. The keyword, of single blanks, is in every text that the pattern matches.
"""

PHRASES = r"""
mit-notice; MIT; 68; permission notice; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-deal; MIT; 68; to deal in the software; to deal in the software without restriction, including without limitation the rights to use, copy, modify
mit-as-is; MIT; 35; without warranty of any kind; the software is provided ["“']?as is["”']?, without warranty of any kind, express or implied
mit-liability; MIT; 35; authors or copyright holders; in no event shall the authors or copyright holders be liable for any claim, damages or other liability
mit-no-attribution; MIT-0; 72; mit no attribution; \bMIT no attribution\b
mit-terms; MIT; 75; mit license; under the (?:terms|conditions) of the MIT license
mit-file; MIT; 60; mit-license; \bMIT-LICENSE(?:\.txt|\.md)?\b
mit-see; MIT; 62; opensource.org/licenses/mit; https?://(?:www\.)?opensource\.org/licenses/MIT\b
mit-modern; MIT; 55; modern variant; \bMIT license,? modern variant\b
mit-feh; MIT-feh; 66; acknowledgment shall be given; acknowledgment shall be given in the documentation and software packages that this software was used
mit-enna; MIT-enna; 66; copyright notices, manuals; this includes acknowledgments in either copyright notices, manuals, publicity and marketing
mit-cmu; MIT-CMU; 66; permission to use, copy, modify; permission to use, copy, modify,? and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted
hpnd; HPND; 64; copyright holder; that the name of (?:the )?copyright holders? not be used in advertising or publicity pertaining to distribution
hpnd-sell; HPND-sell-variant; 67; distribute, and sell; permission to use, copy, modify, distribute, and sell this software and its documentation
x11-consortium; X11; 70; x consortium; except as contained in this notice, the name of the X consortium shall not be used in advertising
x11-name; X11; 63; except as contained in this notice; except as contained in this notice, the names? of [\s\S]{1,80}? shall not be used in advertising or otherwise to promote
apache-compliance; Apache-2.0; 72; except in compliance with the license; you may not use this file except in compliance with the license
apache-basis; Apache-2.0; 70; unless required by applicable law; unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an
apache-asf; Apache-2.0; 74; apache software foundation; licensed to the apache software foundation \(ASF\) under one or more contributor license agreements
apache-patent; Apache-2.0; 60; patent license to make; grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable [\s\S]{0,60}?patent license to make
apache-notice-file; Apache-2.0; 45; text file as part; if the work includes a ["“]NOTICE["”] text file as part of its distribution
apache-terms; Apache-2.0; 66; terms and conditions for use; terms and conditions for use, reproduction, and distribution
apache-1.1-ack; Apache-1.1; 70; developed by the apache; this product includes software developed by the apache software foundation
apache-1.0-group; Apache-1.0; 70; apache group; this product includes software developed by the apache group for use in the apache http server project
apache-short; Apache-2.0; 58; apache; \bapache(?: |-)2(?:\.0)?(?: licen[sc]ed?)?\b
apache-v2; Apache-2.0; 58; apache v2; \bapache v2(?:\.0)?\b
apache-asl; Apache-2.0; 40; asl 2.0; \bASL 2\.0\b
apache-or-mit; Apache-2.0 OR MIT; 82; apache; \b(?:licensed under|dual(?: |-)licensed under|choose) either of (?:the )?apache licen[sc]e
mit-or-apache; MIT OR Apache-2.0; 82; mit or apache; \bMIT or apache-2\.0\b
bsd-source; BSD; 48; redistributions of source code; redistributions of source code must retain the above copyright notice
bsd-binary; BSD; 48; redistributions in binary form; redistributions in binary form must reproduce the above copyright notice
bsd-as-is; BSD; 40; copyright holders and contributors; this software is provided by the copyright holders and contributors ["“]?as is["”]? and any express or implied warranties
bsd-regents; BSD; 46; regents and contributors; this software is provided by the regents and contributors ["“]?as is["”]?
bsd-no-event; BSD; 38; direct, indirect, incidental; be liable for any direct, indirect, incidental, special, exemplary, or consequential damages
bsd-neither; BSD-3-Clause; 57; neither the name; neither the names? of [\s\S]{1,120}? nor the names of (?:its|their|any) contributors may be used to endorse or promote
bsd-patent; BSD-2-Clause-Patent; 72; subject to the terms and conditions of this license; subject to the terms and conditions of this license, each copyright holder and contributor hereby grants
bsd-nuclear; BSD-3-Clause-No-Nuclear-License; 74; nuclear facility; not designed,? licensed or intended for use in the design, construction, operation or maintenance of any nuclear facility
bsd-lbnl; BSD-3-Clause-LBNL; 74; lawrence berkeley; regents of the university of california, through lawrence berkeley national laboratory
bsd-clear; BSD-3-Clause-Clear; 74; no express or implied licenses; no express or implied licenses to any party's patent rights are granted by this license
bsd-new-name; BSD-3-Clause; 60; new bsd; \bnew BSD licen[sc]e\b
bsd-simplified-name; BSD-2-Clause; 60; simplified bsd; \bsimplified BSD licen[sc]e\b
bsd-see; BSD-3-Clause; 62; opensource.org/licenses/bsd-3; https?://(?:www\.)?opensource\.org/licenses/BSD-3-Clause
bsd2-see; BSD-2-Clause; 62; opensource.org/licenses/bsd-2; https?://(?:www\.)?opensource\.org/licenses/BSD-2-Clause
bsd-terms; BSD; 45; bsd; \bunder (?:the terms of )?(?:the |a )?BSD(?:-style)? licen[sc]e\b
bsd-0-fee; 0BSD; 71; permission to use, copy, modify; permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\.
isc-warranty; ISC; 50; disclaims all warranties; the authors? disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
isc-see; ISC; 62; opensource.org/licenses/isc; https?://(?:www\.)?opensource\.org/licenses/ISC
gpl-free-software; GPL; 32; free software; (?:program|library|software|file) is free software[;:,]? you can redistribute it and/or modify it under the terms of the GNU
gpl-hope; GPL; 31; in the hope that it will be useful; distributed in the hope that it will be useful
gpl-preamble; GPL; 45; licenses for most software; the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change
gpl3-preamble; GPL-3.0; 70; free, copyleft license; the GNU general public license is a free, copyleft license for software and other kinds of works
gpl3-date; GPL-3.0; 72; 29 june 2007; GNU general public license version 3, 29 june 2007
gpl2-date; GPL-2.0; 72; june 1991; GNU general public license version 2, june 1991
gpl1-date; GPL-1.0; 72; february 1989; GNU general public license version 1, february 1989
lgpl3-date; LGPL-3.0; 73; 29 june 2007; GNU lesser general public license version 3, 29 june 2007
lgpl21-date; LGPL-2.1; 73; february 1999; GNU lesser general public license version 2\.1, february 1999
lgpl2-date; LGPL-2.0; 73; june 1991; GNU library general public license version 2, june 1991
agpl3-date; AGPL-3.0; 74; 19 november 2007; GNU affero general public license version 3, 19 november 2007
gpl2-only; GPL-2.0-only; 78; version 2 of the license; under the terms of (?:the GNU general public license as published by the free software foundation[;,] )?version 2 of the license\b(?!,? or)
gpl2-later; GPL-2.0-or-later; 79; general public; GNU general public license as published by the free software foundation[;,] either version 2
gpl3-later; GPL-3.0-or-later; 79; general public; GNU general public license as published by the free software foundation[;,] either version 3
lgpl21-later; LGPL-2.1-or-later; 80; lesser general; GNU lesser general public license as published by the free software foundation[;,] either version 2\.1
lgpl3-later; LGPL-3.0-or-later; 80; lesser general; GNU lesser general public license as published by the free software foundation[;,] either version 3
lgpl2-later; LGPL-2.0-or-later; 80; library general; GNU library general public license as published by the free software foundation[;,] either version 2
agpl3-later; AGPL-3.0-or-later; 80; affero; GNU affero general public license as published by the free software foundation[;,] either version 3
gpl-temple; GPL; 28; 59 temple place; 59 temple place,? suite 330,? boston
gpl-franklin; GPL; 28; 51 franklin; 51 franklin st(?:reet)?,? fifth floor,? boston
gpl-classpath; GPL-2.0-with-classpath-exception; 84; classpath; \bclasspath(?: |-)exception\b
gpl-linking; GPL-with-linking-exception; 76; link this library; the copyright holders of this library give you permission to link this library with independent modules
gpl-autoconf; GPL-with-autoconf-exception; 76; configuration script generated by autoconf; distribute [\s\S]{0,80}?configuration script generated by autoconf
gpl-gcc; GPL-3.0-with-GCC-exception; 84; gcc runtime library exception; \bGCC runtime library exception\b
gpl-bison; GPL-with-bison-exception; 76; bison parser skeleton; as a special exception, you may create a larger work that contains part or all of the bison parser skeleton
gpl-linux-note; GPL-2.0-with-Linux-syscall-note; 84; linux-syscall-note; \blinux-syscall-note\b
gpl-font; GPL-with-font-exception; 84; font exception; \b(?:GPL|general public license) with font exception\b
gpl-abbrev-v2; GPL-2.0; 52; gplv2; \bGPLv2(?:\.0)?\+?(?![\w.])
gpl-abbrev-v3; GPL-3.0; 52; gplv3; \b(?<![AL])GPLv3(?:\.0)?\+?(?![\w.])
lgpl-abbrev-v21; LGPL-2.1; 53; lgplv2.1; \bLGPLv2\.1\+?(?![\w.])
lgpl-abbrev-v3; LGPL-3.0; 53; lgplv3; \bLGPLv3(?:\.0)?\+?(?![\w.])
agpl-abbrev-v3; AGPL-3.0; 53; agplv3; \bAGPLv3(?:\.0)?\+?(?![\w.])
gpl-version-word; GPL; 34; gpl; \b(?:under|of) the GPL\b(?! ?v?\d)
lgpl-version-word; LGPL; 36; lgpl; \b(?:under|of) the LGPL\b(?! ?v?\d)
agpl-version-word; AGPL; 36; agpl; \b(?:under|of) the AGPL\b(?! ?v?\d)
agpl-network; AGPL-3.0; 60; interacting with it remotely; prominently offer all users interacting with it remotely through a computer network
lgpl-combined; LGPL-3.0; 58; combined work; a ["“]combined work["”] is a work produced by combining or linking an application with the library
gfdl-invariant; GFDL; 66; invariant sections; with no invariant sections, no front-cover texts,? and no back-cover texts
gfdl-permission; GFDL; 68; free documentation; permission is granted to copy, distribute and/or modify this document under the terms of the GNU free documentation license
mpl-exhibit; MPL-2.0; 66; exhibit a; exhibit A ?- ?source code form license notice
mpl-11-contents; MPL-1.1; 78; mozilla public; the contents of this file are subject to the mozilla public license version 1\.1
mpl-10-contents; MPL-1.0; 78; mozilla public; the contents of this file are subject to the mozilla public license version 1\.0
mpl-tri; MPL-1.1 OR GPL-2.0 OR LGPL-2.1; 84; mpl 1.1/gpl 2.0/lgpl 2.1; version: MPL 1\.1/GPL 2\.0/LGPL 2\.1
mpl-copy; MPL-2.0; 64; copy of the mpl; if a copy of the MPL was not distributed with this file, you can obtain one at
npl-contents; NPL-1.1; 78; netscape public; the contents of this file are subject to the netscape public license
epl-made; EPL; 70; eclipse public; this program and the accompanying materials are made available under the terms of the eclipse public license
epl2-made; EPL-2.0; 78; eclipse public; made available under the terms of the eclipse public license (?:v|version )?\.? ?2\.0
epl1-made; EPL-1.0; 78; eclipse public; made available under the terms of the eclipse public license (?:v|version )?\.? ?1\.0
edl-made; BSD-3-Clause; 76; eclipse distribution; eclipse distribution license v(?:ersion|\.)? ?1\.0
cpl-made; CPL-1.0; 70; common public; this program and the accompanying materials are made available under the terms of the common public license
cddl-header; CDDL-1.0; 70; common development; the contents of this file are subject to the terms of the common development and distribution license
cddl-glassfish; CDDL-1.1 OR GPL-2.0; 76; glassfish; glassfish\.(?:dev\.java\.net|java\.net)/public/CDDL\+GPL
spl-contents; SPL-1.0; 78; sun public; the contents of this file are subject to the sun public license
ipl-contents; IPL-1.0; 70; ibm public; \bIBM public license version 1\.0\b
zlib-altered; Zlib; 66; altered source versions; altered source versions must be plainly marked as such, and must not be misrepresented as being the original software
zlib-origin; Zlib; 66; origin of this software; the origin of this software must not be misrepresented; you must not claim that you wrote the original software
zlib-removed; Zlib; 55; removed or altered; this notice may not be removed or altered from any source distribution
libpng-group; Libpng; 66; png reference library; the PNG reference library is supplied ["“]as is["”]
libtiff-grant; libtiff; 66; sam leffler; the names of sam leffler and silicon graphics may not be used in any advertising
ijg-based; IJG; 66; independent jpeg group; this software is based in part on the work of the independent JPEG group
boost-hereby; BSL-1.0; 66; permission is hereby granted; permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
boost-see; BSL-1.0; 62; boost.org/license; https?://(?:www\.)?boost\.org/LICENSE_1_0\.txt
openssl-ack; OpenSSL; 68; openssl project; this product includes software developed by the openssl project for use in the openssl toolkit
ssleay-ack; SSLeay; 68; eric young; this product includes cryptographic software written by eric young
python-psf; PSF-2.0; 66; python software; this license agreement is between the python software foundation
python-cnri; CNRI-Python; 66; national research initiatives; corporation for national research initiatives,? having an office at 1895 preston white drive
python-beopen; BeOpen-Python; 66; beopen; beopen python open source license agreement version 1
php-redistribution; PHP-3.01; 68; php; this product includes php software, freely available from
zend-ack; Zend-2.0; 66; zend engine; this product includes the zend engine
perl-same; Artistic-1.0-Perl OR GPL-1.0-or-later; 76; same terms as perl; (?:redistribute|modify) it under the same terms as perl(?: itself)?
artistic-intent; Artistic-1.0; 60; intent of this document; the intent of this document is to state the conditions under which a package may be copied
artistic2-establishes; Artistic-2.0; 66; given free software package; this license establishes the terms under which a given free software package may be copied
ruby-dual; Ruby; 60; same terms as ruby; (?:redistribute|modify|distribute) it under the same terms as ruby(?:'s)?(?: itself)?
vim-charityware; Vim; 62; charityware; \bvim is charityware\b
tcl-grant; TCL; 62; sun microsystems, inc; this software is copyrighted by the regents of the university of california, sun microsystems, inc
curl-grant; curl; 62; daniel stenberg; copyright \(c\) (?:19|20)\d\d ?- ?(?:19|20)\d\d, daniel stenberg
icu-grant; ICU; 62; international business machines; copyright \(c\) 1995-20\d\d international business machines corporation and others
unicode-terms; Unicode-DFS-2016; 64; unicode; to any person obtaining a copy of the unicode data files
unicode-see; Unicode-DFS-2016; 60; unicode.org/copyright; https?://(?:www\.)?unicode\.org/copyright\.html
ncsa-grant; NCSA; 66; deal with the software; to deal with the software without restriction, including without limitation the rights to use
ncsa-neither; NCSA; 62; nor the names of its contributors; neither the names of [\s\S]{1,120}?,? nor the names of its contributors may be used to endorse or promote products derived from this software without specific
w3c-notice; W3C; 64; w3c; this work is distributed under the W3C(?:\(r\)|®)? software licen[sc]e
ofl-reserved; OFL-1.1; 64; reserved font name; with reserved font name
ofl-licensed; OFL-1.1; 76; sil open font; this font software is licensed under the SIL open font licen[sc]e,? version 1\.1
ofl-see; OFL-1.1; 62; scripts.sil.org/ofl; https?://scripts\.sil\.org/OFL
bitstream-vera; Bitstream-Vera; 64; bitstream vera; bitstream vera is a trademark of bitstream, inc
ubuntu-font; Ubuntu-font-1.0; 64; ubuntu font; ubuntu font licence version 1\.0
wtfpl-everyone; WTFPL; 66; verbatim or modified; everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed
beerware-notice; Beerware; 66; buy me a beer; you can buy me a beer in return
unlicense-anyone; Unlicense; 66; anyone is free to copy; anyone is free to copy, modify, publish, use, compile, sell, or distribute this software
unlicense-see; Unlicense; 62; unlicense.org; https?://(?:www\.)?unlicense\.org/?
cc0-dedicate; CC0-1.0; 66; creative commons zero; \bcreative commons zero(?: v?1\.0)?(?: universal)?\b
cc0-affirmer; CC0-1.0; 60; affirmer; affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives
cc-work-provided; CC; 40; creative commons public license; the work \(as defined below\) is provided under the terms of this creative commons public license
cc-some-rights; CC; 24; some rights reserved; \bsome rights reserved\b
cc-adapt; CC-BY-4.0; 40; creative commons attribution 4; \bcreative commons attribution 4\.0 international public license\b
pd-no-rights; Public-Domain; 22; no rights reserved; \bno rights reserved\b
pd-author; Public-Domain; 26; copyright to this source code; the authors? (?:hereby )?disclaims? copyright to this source code
pd-usgov; Public-Domain; 26; work of the united states government; is a work of the united states government
pd-place; Public-Domain; 24; placed in the public domain; (?:has been|is) placed in the public domain
blessing; blessing; 66; may you do good and not evil; in place of a legal notice, here is a blessing: may you do good and not evil
busl-change; BUSL-1.1; 64; change date; on the change date,? or the fourth anniversary
busl-additional; BUSL-1.1; 56; additional use grant; \badditional use grant:
sspl-service; SSPL-1.0; 62; service source code; you must make the service source code available via network download
elastic-managed; Elastic-2.0; 62; hosted or managed service; you may not provide the software to third parties as a hosted or managed service
commons-clause; Commons-Clause; 78; commons clause; \bcommons clause licen[sc]e condition v1\.0\b
commons-sell; Commons-Clause; 70; right to sell the software; does not grant to you,? the right to sell the software
polyform; PolyForm; 62; polyform; \bpolyform (?:noncommercial|small business|shield|strict|perimeter|internal use|free trial) licen[sc]e\b
prosperity; Prosperity-3.0; 62; prosperity public; \bthe prosperity public licen[sc]e\b
parity; Parity-7.0; 62; parity public; \bthe parity public licen[sc]e\b
ethical-source; Hippocratic-2.1; 60; ethical source; \bethical source licen[sc]e\b
eupl-licensed; EUPL-1.2; 74; eupl; licensed under the EUPL(?:,? version 1\.2| v\.? ?1\.2)?
eupl-or-later; EUPL-1.2; 76; eupl; \bthis work is released under EUPL
cecill-govern; CECILL; 62; cecill; this software is governed by the cecill(?:-[bc])? licen[sc]e under french law
osl-licensed; OSL-3.0; 74; open software; licensed under the open software license version 3\.0
afl-licensed; AFL-3.0; 74; academic free; licensed under the academic free license version 3\.0
ms-pl-grant; MS-PL; 60; ms-pl; \bMS-PL\b
ms-rl-grant; MS-RL; 60; ms-rl; \bMS-RL\b
ms-eula; Proprietary; 44; user license agreement; \bend(?: |-)user license agreement\b
eula-accept; Proprietary; 42; agree to be bound; by (?:installing|downloading),? copying,? or otherwise using the software,? you agree to be bound
proprietary-confidential; Proprietary; 40; confidential and proprietary; \bconfidential and proprietary\b
proprietary-trade; Proprietary; 40; trade secrets; contains (?:confidential information and )?trade secrets
proprietary-unauthorized; Proprietary; 41; unauthorized copying; unauthorized copying of this file,? via any medium,? is strictly prohibited
proprietary-permission; Proprietary; 38; written permission; (?:no part of|may not be reproduced)[\s\S]{0,120}? without (?:the )?prior written permission
proprietary-license; Proprietary; 39; commercial licen; \bcommercial licen[sc]e (?:is )?(?:required|available|agreement)\b
evaluation-only; Proprietary; 39; evaluation purposes only; \bfor evaluation purposes only\b
non-commercial-use; NonCommercial; 36; non-commercial; \bfor (?:personal,? )?non-commercial (?:use|purposes) only\b
research-only; NonCommercial; 36; research purposes only; \bfor (?:(?:academic|non-profit)(?: and| or)? )?research purposes only\b
academic-only; NonCommercial; 36; academic use only; \bfor academic use only\b
openrail-restrict; OpenRAIL; 56; use-based restrictions; \buse-based restrictions as referenced in paragraph\b
bigcode-rail; BigCode-OpenRAIL-M; 66; bigcode; \bbigcode openrail-m\b
gemma-terms; Gemma; 56; gemma terms; \bgemma terms of use\b
odbl-share; ODbL-1.0; 62; opendatacommons.org/licenses/odbl; https?://(?:www\.)?opendatacommons\.org/licenses/odbl(?:/1\.0)?/?
odc-by-see; ODC-By-1.0; 62; opendatacommons.org/licenses/by; https?://(?:www\.)?opendatacommons\.org/licenses/by(?:/1\.0)?/?
pddl-see; PDDL-1.0; 62; opendatacommons.org/licenses/pddl; https?://(?:www\.)?opendatacommons\.org/licenses/pddl(?:/1\.0)?/?
osm-contributors; ODbL-1.0; 50; openstreetmap contributors; (?:\(c\)|©|data by) openstreetmap contributors
ogl-contains; OGL-UK-3.0; 60; public sector information; contains public sector information licensed under the open government licen[sc]e
etalab; etalab-2.0; 60; licence ouverte; \blicence ouverte ?/? ?open licence(?: version 2\.0)?\b
dl-de; DL-DE-BY-2.0; 60; datenlizenz deutschland; \bdatenlizenz deutschland (?:–|-)? ?(?:namensnennung|zero)(?: (?:–|-)? ?version 2\.0)?
gpl-german; GPL; 30; freie software; dieses programm ist freie software
gpl-french; GPL; 30; logiciel libre; ce programme est un logiciel libre
gpl-spanish; GPL; 30; software libre; este programa es software libre
rights-german; Proprietary; 20; alle rechte vorbehalten; \balle rechte vorbehalten\b
rights-french; Proprietary; 20; droits r; \btous droits r[ée]serv[ée]s\b
rights-spanish; Proprietary; 20; todos los derechos reservados; \btodos los derechos reservados\b
mulan-see; MulanPSL-2.0; 62; license.coscl.org.cn; https?://license\.coscl\.org\.cn/MulanPSL2
blueoak-purpose; BlueOak-1.0.0; 62; this license gives everyone; this license gives everyone as much permission to work with this software as possible
cal-terms; CAL-1.0; 60; cryptographic autonomy; \bcryptographic autonomy license\b
rpl-terms; RPL-1.5; 60; reciprocal public; \breciprocal public license\b
sissl-terms; SISSL; 60; sun industry standards; \bsun industry standards source license\b
nasa-terms; NASA-1.3; 60; nasa open source; \bNASA open source agreement version 1\.3\b
intel-terms; Intel; 60; intel open source; \bintel open source licen[sc]e\b
sgi-terms; SGI-B-2.0; 60; sgi free software; \bSGI free software license B\b
lppl-terms; LPPL-1.3c; 66; latex project public; \blatex project public licen[sc]e,? (?:either )?version 1\.3c?\b
lppl-any; LPPL; 40; latex project public; \blatex project public licen[sc]e\b
knuth-ctan; Knuth-CTAN; 60; no changes whatsoever; this file may be freely copied and distributed, provided that no changes whatsoever are made
catosl; CATOSL-1.1; 60; computer associates trusted; \bcomputer associates trusted open source license\b
frameworx; Frameworx-1.0; 60; frameworx; \bframeworx open license\b
jabber; JOSL-1.0; 60; jabber open source; \bjabber open source license\b
motosoto; Motosoto; 60; motosoto; \bmotosoto open source license\b
nokia; NOKOS-1.0a; 60; nokia open source; \bnokia open source license\b
ricoh; RSCPL; 60; ricoh source code; \bricoh source code public license\b
realnetworks; RPSL-1.0; 60; realnetworks public source; \brealnetworks public source license\b
sybase; Watcom-1.0; 60; sybase open watcom; \bsybase open watcom public license\b
vovida; VSL-1.0; 60; vovida software; \bvovida software license\b
wxwindows; WXwindows; 60; wxwindows library; \bwxwindows library licen[sc]e\b
xnet; Xnet; 60; x.net; \bX\.net,? inc\.? license\b
zope; ZPL-2.1; 62; zope public; \bzope public license(?: \(ZPL\))?(?:,? version 2\.[01])?\b
entessa; Entessa; 60; entessa; \bentessa public license\b
eiffel; EFL-2.0; 60; eiffel forum; \beiffel forum license(?:,? version [12])?\b
fair; Fair; 60; fair license; \bfair license\b
lucent; LPL-1.02; 60; lucent public; \blucent public license(?: version 1\.0[02]?)?\b
naumen; Naumen; 60; naumen; \bnaumen public license\b
ntp; NTP; 60; ntp license; \bNTP license\b
oclc; OCLC-2.0; 60; oclc research; \bOCLC research public license\b
simpl; SimPL-2.0; 60; simple public; \bsimple public license\b
sleepycat-redistributions; Sleepycat; 66; information on how to obtain; redistributions in any form must be accompanied by information on how to obtain complete source code
"""
