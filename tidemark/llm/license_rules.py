"""The license signature rules: hand-written patterns, most specific first in each family; those of license_phrases.py are among them.

A rule is (name, license, priority, keywords, pattern). At least one of the keywords (lower case) is in every
text that the pattern, which ignores case, can match, once its gaps are single spaces: that is what the prefilter relies on.

Patterns are written with [ \t] for a gap between words; `wrapped` makes it any white space with comment marks, so that
notices match however they are broken into lines. Tags (SPDX-License-Identifier, license: ...) stay on their line.
"""

from __future__ import annotations

import re

from tidemark.llm.license_phrases import PHRASES

Rule = tuple[str, str, int, tuple[str, ...], str]

#: A gap between words: white space, with the marks of comment lines in it. Possessive, so long runs cost no backtracking.
GAP = r"\s++[\s*#/;]*+"
_GAPS = {
    r"[ \t]+": GAP, r"[ \t]": GAP, r"[ \t]*": f"(?:{GAP})?",
    r"[ \t-]+": r"[\s-]++(?:(?<=\s)[\s*#/;]*+)?", r"[ \t-]*": r"[\s-]*+(?:(?<=\s)[\s*#/;]*+)?", r"[ \t-]": f"(?:-?{GAP}|-)", r"[ \t-]?": f"(?:-?{GAP}|-)?",
}


def wrapped(pattern: str) -> str:
    """The pattern with gaps that go across line breaks."""
    return re.sub(r"\[ \\t-?\][+*?]?", lambda m: _GAPS[m[0]], pattern)


#: SPDX id: (keyword, pattern of the license's name in prose). A number alone on the next line may be a list's, so it needs its decimal there.
NAMES: dict[str, tuple[str, str]] = {
    "MIT": ("mit", r"\bMIT(?:(?:/|[ \t-])(?:style|expat|X11))?[ \t-]+licen[sc]e\b"),
    "MIT-0": ("mit", r"\bMIT[ \t-]+no[ \t-]+attribution(?:[ \t]+licen[sc]e)?\b"),
    "X11": ("x11", r"\bX11[ \t]+licen[sc]e\b"),
    "Apache-1.0": ("apache", r"\bApache(?:[ \t]+software)?[ \t]+licen[sc]e,?[ \t]+(?:version|v\.?)?[ \t]*1\.0\b"),
    "Apache-1.1": ("apache", r"\bApache(?:[ \t]+software)?[ \t]+licen[sc]e,?[ \t]+(?:version|v\.?)?[ \t]*1\.1\b"),
    "Apache-2.0": ("apache", r"\bApache(?:[ \t]+software)?[ \t]+licen[sc]e,?(?:[ \t]+(?:version|v\.?)[ \t]*|[ \t]+(?=\d\.\d)|[^\S\r\n]+)2(?:\.0)?\b"),
    "BSD-1-Clause": ("bsd", r"\bBSD[ \t-]*1[ \t-]*clause\b|\b1[ \t-]*clause[ \t-]+BSD\b"),
    "BSD-2-Clause": ("bsd", r"\b(?:BSD[ \t-]*2[ \t-]*clause|2[ \t-]*clause[ \t-]+BSD|simplified[ \t]+BSD|FreeBSD)(?:[ \t]+licen[sc]e)?\b"),
    "BSD-3-Clause": ("bsd", r"\b(?:BSD[ \t-]*3[ \t-]*clause|3[ \t-]*clause[ \t-]+BSD|(?:new|revised|modified)[ \t]+BSD)(?:[ \t]+licen[sc]e)?\b"),
    "BSD-4-Clause": ("bsd", r"\b(?:BSD[ \t-]*4[ \t-]*clause|4[ \t-]*clause[ \t-]+BSD|original[ \t]+BSD)(?:[ \t]+licen[sc]e)?\b"),
    "0BSD": ("bsd", r"\b(?:zero[ \t-]+clause[ \t]+BSD|BSD[ \t-]+zero[ \t-]+clause)(?:[ \t]+licen[sc]e)?\b"),
    "GPL-1.0": ("general public", r"\b(?:GNU[ \t]+)?general[ \t]+public[ \t]+licen[sc]e,?[ \t]+(?:\(GPL\),?[ \t]+)?(?:version|v\.?)[ \t]*1(?:\.0)?\b"),
    "GPL-2.0": ("general public", r"\b(?:GNU[ \t]+)?general[ \t]+public[ \t]+licen[sc]e,?[ \t]+(?:\(GPL\),?[ \t]+)?(?:version|v\.?)[ \t]*2(?:\.0)?\b"),
    "GPL-3.0": ("general public", r"\b(?:GNU[ \t]+)?general[ \t]+public[ \t]+licen[sc]e,?[ \t]+(?:\(GPL\),?[ \t]+)?(?:version|v\.?)[ \t]*3(?:\.0)?\b"),
    "LGPL-2.0": ("library general", r"\b(?:GNU[ \t]+)?library[ \t]+general[ \t]+public[ \t]+licen[sc]e(?:,?[ \t]+(?:version|v\.?)[ \t]*2(?:\.0)?)?\b"),
    "LGPL-2.1": ("lesser general", r"\b(?:GNU[ \t]+)?lesser[ \t]+general[ \t]+public[ \t]+licen[sc]e,?[ \t]+(?:version|v\.?)[ \t]*2\.1\b"),
    "LGPL-3.0": ("lesser general", r"\b(?:GNU[ \t]+)?lesser[ \t]+general[ \t]+public[ \t]+licen[sc]e,?[ \t]+(?:version|v\.?)[ \t]*3(?:\.0)?\b"),
    "AGPL-1.0": ("affero", r"\baffero[ \t]+general[ \t]+public[ \t]+licen[sc]e,?[ \t]+(?:version|v\.?)[ \t]*1(?:\.0)?\b"),
    "AGPL-3.0": ("affero", r"\b(?:GNU[ \t]+)?affero[ \t]+general[ \t]+public[ \t]+licen[sc]e(?:,?[ \t]+(?:version|v\.?)[ \t]*3(?:\.0)?)?\b"),
    "GFDL-1.1": ("free documentation", r"\b(?:GNU[ \t]+)?free[ \t]+documentation[ \t]+licen[sc]e,?[ \t]+(?:version|v\.?)[ \t]*1\.1\b"),
    "GFDL-1.2": ("free documentation", r"\b(?:GNU[ \t]+)?free[ \t]+documentation[ \t]+licen[sc]e,?[ \t]+(?:version|v\.?)[ \t]*1\.2\b"),
    "GFDL-1.3": ("free documentation", r"\b(?:GNU[ \t]+)?free[ \t]+documentation[ \t]+licen[sc]e,?[ \t]+(?:version|v\.?)[ \t]*1\.3\b"),
    "MPL-1.0": ("mozilla", r"\bmozilla[ \t]+public[ \t]+licen[sc]e,?[ \t]+(?:version|v\.?)[ \t]*1\.0\b"),
    "MPL-1.1": ("mozilla", r"\bmozilla[ \t]+public[ \t]+licen[sc]e,?[ \t]+(?:version|v\.?)[ \t]*1\.1\b"),
    "MPL-2.0": ("mozilla", r"\bmozilla[ \t]+public[ \t]+licen[sc]e,?[ \t]+(?:version|v\.?)[ \t]*2(?:\.0)?\b"),
    "EPL-1.0": ("eclipse", r"\beclipse[ \t]+public[ \t]+licen[sc]e(?:[ \t-]+(?:version|v\.?)[ \t]*|[ \t-]+(?=\d\.\d)|(?:[^\S\r\n]|-)+)1(?:\.0)?\b"),
    "EPL-2.0": ("eclipse", r"\beclipse[ \t]+public[ \t]+licen[sc]e(?:[ \t-]+(?:version|v\.?)[ \t]*|[ \t-]+(?=\d\.\d)|(?:[^\S\r\n]|-)+)2(?:\.0)?\b"),
    "CDDL-1.0": ("common development", r"\bcommon[ \t]+development[ \t]+and[ \t]+distribution[ \t]+licen[sc]e(?:,?[ \t]+(?:version|v\.?)[ \t]*1\.0)?\b"),
    "CDDL-1.1": ("common development", r"\bcommon[ \t]+development[ \t]+and[ \t]+distribution[ \t]+licen[sc]e,?[ \t]+(?:version|v\.?)[ \t]*1\.1\b"),
    "CPL-1.0": ("common public", r"\bcommon[ \t]+public[ \t]+licen[sc]e(?:,?[ \t]+(?:version|v\.?)[ \t]*1\.0)?\b"),
    "IPL-1.0": ("ibm", r"\bIBM[ \t]+public[ \t]+licen[sc]e\b"),
    "ISC": ("isc", r"\bISC[ \t]+licen[sc]e\b"),
    "Zlib": ("zlib", r"\bzlib(?:/libpng)?[ \t]+licen[sc]e\b"),
    "Libpng": ("libpng", r"\blibpng[ \t]+licen[sc]e\b"),
    "BSL-1.0": ("boost", r"\bboost[ \t]+software[ \t]+licen[sc]e\b"),
    "BUSL-1.1": ("business source", r"\bbusiness[ \t]+source[ \t]+licen[sc]e(?:[ \t]+1\.1)?\b"),
    "SSPL-1.0": ("server side", r"\bserver[ \t]+side[ \t]+public[ \t]+licen[sc]e\b"),
    "Elastic-2.0": ("elastic", r"\belastic[ \t]+licen[sc]e(?:[ \t]+2\.0)?\b"),
    "Artistic-1.0": ("artistic", r"\bartistic[ \t]+licen[sc]e[ \t]+(?:version[ \t]+)?1\.0\b"),
    "Artistic-2.0": ("artistic", r"\bartistic[ \t]+licen[sc]e[ \t]+(?:version[ \t]+)?2\.0\b"),
    "Unlicense": ("unlicense", r"\b(?:the[ \t]+)?unlicense\b"),
    "WTFPL": ("do what the", r"\bdo[ \t]+what[ \t]+the[ \t]+f\w+[ \t]+you[ \t]+want[ \t]+to[ \t]+public[ \t]+licen[sc]e\b"),
    "Beerware": ("beer", r"\bbeer-?ware[ \t]+licen[sc]e\b"),
    "EUPL-1.1": ("european union", r"\beuropean[ \t]+union[ \t]+public[ \t]+licen[sc]e,?[ \t]+(?:version|v\.?)?[ \t]*1\.1\b"),
    "EUPL-1.2": ("european union", r"\beuropean[ \t]+union[ \t]+public[ \t]+licen[sc]e,?[ \t]+(?:version|v\.?)?[ \t]*1\.2\b"),
    "CECILL-2.1": ("cecill", r"\bCeCILL(?:[ \t-]*(?:version[ \t]+|v)?2\.1)?[ \t]+licen[sc]e\b"),
    "OSL-3.0": ("open software", r"\bopen[ \t]+software[ \t]+licen[sc]e(?:[ \t]+(?:version|v\.?)?[ \t]*3\.0)?\b"),
    "AFL-3.0": ("academic free", r"\bacademic[ \t]+free[ \t]+licen[sc]e(?:[ \t]+(?:version|v\.?)?[ \t]*3\.0)?\b"),
    "MS-PL": ("microsoft", r"\bmicrosoft[ \t]+public[ \t]+licen[sc]e\b"),
    "MS-RL": ("microsoft", r"\bmicrosoft[ \t]+reciprocal[ \t]+licen[sc]e\b"),
    "PSF-2.0": ("python software", r"\bpython[ \t]+software[ \t]+foundation[ \t]+licen[sc]e(?:[ \t]+version[ \t]+2)?\b"),
    "Ruby": ("ruby", r"\bruby[ \t]+licen[sc]e\b"),
    "PHP-3.01": ("php", r"\bPHP[ \t]+licen[sc]e(?:,?[ \t]+(?:version|v\.?)[ \t]*3\.01)?\b"),
    "OpenSSL": ("openssl", r"\bopenssl[ \t]+licen[sc]e\b"),
    "PostgreSQL": ("postgresql", r"\bpostgresql[ \t]+licen[sc]e\b"),
    "NCSA": ("ncsa", r"\b(?:university[ \t]+of[ \t]+illinois/)?NCSA[ \t]+open[ \t]+source[ \t]+licen[sc]e\b"),
    "W3C": ("w3c", r"\bW3C[ \t]+software[ \t](?:notice[ \t]and[ \t])?licen[sc]e\b"),
    "Vim": ("vim", r"\bvim[ \t]+licen[sc]e\b"),
    "UPL-1.0": ("universal permissive", r"\buniversal[ \t]+permissive[ \t]+licen[sc]e\b"),
    "QPL-1.0": ("q public", r"\bQ[ \t]+public[ \t]+licen[sc]e\b"),
    "Sleepycat": ("sleepycat", r"\bsleepycat[ \t]+licen[sc]e\b"),
    "NPL-1.1": ("netscape", r"\bnetscape[ \t]+public[ \t]+licen[sc]e\b"),
    "APSL-2.0": ("apple public", r"\bapple[ \t]+public[ \t]+source[ \t]+licen[sc]e\b"),
    "OFL-1.1": ("open font", r"\b(?:SIL[ \t]+)?open[ \t]+font[ \t]+licen[sc]e(?:,?[ \t]+(?:version|v\.?)[ \t]*1\.1)?\b"),
    "OGL-UK-3.0": ("open government", r"\bopen[ \t]+government[ \t]+licen[sc]e(?:[ \t]+v?3\.0)?\b"),
    "ODbL-1.0": ("open database", r"\bopen[ \t]+(?:data[ \t]+commons[ \t]+open[ \t]+)?database[ \t]+licen[sc]e\b"),
    "ODC-By-1.0": ("open data commons", r"\bopen[ \t]+data[ \t]+commons[ \t]+attribution[ \t]+licen[sc]e\b"),
    "PDDL-1.0": ("public domain dedication", r"\bpublic[ \t]+domain[ \t]+dedication[ \t]+and[ \t]+licen[sc]e\b"),
    "CDLA-Permissive-2.0": ("community data", r"\bcommunity[ \t]+data[ \t]+licen[sc]e[ \t]+agreement[ \t]*[-,]?[ \t]*permissive\b"),
    "CDLA-Sharing-1.0": ("community data", r"\bcommunity[ \t]+data[ \t]+licen[sc]e[ \t]+agreement[ \t]*[-,]?[ \t]*sharing\b"),
    "MulanPSL-2.0": ("mulan", r"\bmulan[ \t]+permissive[ \t]+software[ \t]+licen[sc]e\b"),
    "BlueOak-1.0.0": ("blue oak", r"\bblue[ \t]+oak[ \t]+model[ \t]+licen[sc]e\b"),
    "OpenRAIL-M": ("openrail", r"\b(?:(?:bigscience|creativeml)[ \t-]*|[-\t ]*)openrail(?:[+][+])?(?:-M)?(?:[ \t]+licen[sc]e)?\b"),
    "Hippocratic-2.1": ("hippocratic", r"\bhippocratic[ \t]+licen[sc]e\b"),
    "JSON": ("good, not evil", r"\bshall[ \t]+be[ \t]+used[ \t]+for[ \t]+good,[ \t]+not[ \t]+evil\b"),
}

#: Creative Commons: suffix, the words of its long name, versions.
_CC = {
    "BY": "attribution", "BY-SA": "attribution[ \\t-]+share[ \\t-]?alike", "BY-ND": "attribution[ \\t-]+no[ \\t-]?deriv(?:ative|ativework|ative[ \\t]+work)s?",
    "BY-NC": "attribution[ \\t-]+non[ \\t-]?commercial", "BY-NC-SA": "attribution[ \\t-]+non[ \\t-]?commercial[ \\t-]+share[ \\t-]?alike",
    "BY-NC-ND": "attribution[ \\t-]+non[ \\t-]?commercial[ \\t-]+no[ \\t-]?deriv(?:ative|ativework|ative[ \\t]+work)s?",
}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Sentences that only one family's notice or full text has: name, license, priority, keywords, pattern.
NOTICES: list[Rule] = [
    ("mit-grant", "MIT", 70, ("permission is hereby granted",), r"permission[ \t]+is[ \t]+hereby[ \t]+granted,?[ \t]+free[ \t]+of[ \t]+charge,?[ \t]+to[ \t]+any[ \t]+person[ \t]+obtaining[ \t]+a[ \t]+copy"),
    ("mit-released", "MIT", 80, ("mit license", "mit licence"), r"\b(?:released|licensed|distributed|available)[ \t]+under[ \t]+(?:the[ \t]+)?(?:terms[ \t]+of[ \t]+the[ \t]+)?MIT[ \t]+licen[sc]e\b\.?"),
    ("apache-2.0-notice", "Apache-2.0", 80, ("apache",), r"\blicensed[ \t]+under[ \t]+the[ \t]+Apache[ \t]+licen[sc]e,?[ \t]+version[ \t]+2\.0\b(?:[ \t]+\(the[ \t]+[\"“]License[\"”]\))?\.?"),
    ("apache-2.0-url", "Apache-2.0", 60, ("apache.org/licenses",), r"https?://(?:www\.)?apache\.org/licenses/LICENSE-2\.0(?:\.txt|\.html)?"),
    ("bsd-redistribution", "BSD", 50, ("redistribution and use",), r"redistribution[ \t]+and[ \t]+use[ \t]+in[ \t]+source[ \t]+and[ \t]+binary[ \t]+forms,?[ \t]+with[ \t]+or[ \t]+without[ \t]+modification"),
    ("bsd-endorse", "BSD-3-Clause", 55, ("endorse or promote",), r"may[ \t]+be[ \t]+used[ \t]+to[ \t]+endorse[ \t]+or[ \t]+promote[ \t]+products[ \t]+derived[ \t]+from"),
    ("bsd-advertising", "BSD-4-Clause", 56, ("all advertising materials",), r"all[ \t]+advertising[ \t]+materials[ \t]+mentioning[ \t]+features[ \t]+or[ \t]+use[ \t]+of[ \t]+this[ \t]+software"),
    ("gpl-work-3", "GPL-3.0", 80, ("general public",), r"\bthis[ \t]+(?:work|program|software|library)[ \t]+is[ \t]+licensed[ \t]+under[ \t]+the[ \t]+GNU[ \t]+general[ \t]+public[ \t]+licen[sc]e,?[ \t]+version[ \t]+3\b\.?"),
    ("gpl-work-2", "GPL-2.0", 80, ("general public",), r"\bthis[ \t]+(?:work|program|software|library)[ \t]+is[ \t]+licensed[ \t]+under[ \t]+the[ \t]+GNU[ \t]+general[ \t]+public[ \t]+licen[sc]e,?[ \t]+version[ \t]+2\b\.?"),
    ("gpl-or-later", "GPL-or-later", 75, ("either version",), r"either[ \t]+version[ \t]+[123](?:\.\d)?[ \t]+of[ \t]+the[ \t]+licen[sc]e,?[ \t]+or[ \t]+\(at[ \t]+your[ \t]+option\)[ \t]+any[ \t]+later[ \t]+version"),
    ("gpl-warranty", "GPL", 30, ("without any warranty",), r"but[ \t]+without[ \t]+any[ \t]+warranty;[ \t]+without[ \t]+even[ \t]+the[ \t]+implied[ \t]+warranty[ \t]+of"),
    ("gpl-copy", "GPL", 30, ("you should have received a copy",), r"you[ \t]+should[ \t]+have[ \t]+received[ \t]+a[ \t]+copy[ \t]+of[ \t]+the[ \t]+GNU[ \t]+(?:lesser[ \t]+|affero[ \t]+)?general[ \t]+public[ \t]+licen[sc]e"),
    ("gpl-url", "GPL", 40, ("gnu.org/licenses",), r"https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?(?:[al]?gpl|fdl)(?:-[\d.]+)?(?:\.html|\.txt)?"),
    ("mpl-2.0-form", "MPL-2.0", 80, ("source code form is subject",), r"this[ \t]+source[ \t]+code[ \t]+form[ \t]+is[ \t]+subject[ \t]+to[ \t]+the[ \t]+terms[ \t]+of[ \t]+the[ \t]+mozilla[ \t]+public[ \t]+licen[sc]e,?[ \t]+v\.?[ \t]*2\.0"),
    ("mpl-url", "MPL", 40, ("mozilla.org/mpl",), r"https?://(?:www\.)?mozilla\.org/MPL(?:/[\d.]+)?/?"),
    ("epl-url", "EPL", 40, ("eclipse.org/",), r"https?://(?:www\.)?eclipse\.org/(?:legal|org/documents)/epl-v?[\d.]+(?:\.html|/)?"),
    ("isc-grant", "ISC", 70, ("permission to use, copy",), r"permission[ \t]+to[ \t]+use,[ \t]+copy,[ \t]+modify,[ \t]+and(?:/or)?[ \t]+distribute[ \t]+this[ \t]+software[ \t]+for[ \t]+any[ \t]+purpose"),
    ("zlib-grant", "Zlib", 65, ("express or implied warranty", "express or implied"), r"provided[ \t]+'as-is',[ \t]+without[ \t]+any[ \t]+express[ \t]+or[ \t]+implied[ \t]+warranty"),
    ("boost-grant", "BSL-1.0", 75, ("boost software",), r"distributed[ \t]+under[ \t]+the[ \t]+boost[ \t]+software[ \t]+licen[sc]e,?[ \t]+version[ \t]+1\.0"),
    ("unlicense-grant", "Unlicense", 70, ("released into the public domain",), r"this[ \t]+is[ \t]+free[ \t]+and[ \t]+unencumbered[ \t]+software[ \t]+released[ \t]+into[ \t]+the[ \t]+public[ \t]+domain"),
    ("cc0-waiver", "CC0-1.0", 70, ("waived all copyright",), r"has[ \t]+waived[ \t]+all[ \t]+copyright[ \t]+and[ \t]+related[ \t]+or[ \t]+neighbou?ring[ \t]+rights"),
    ("cc0-name", "CC0-1.0", 60, ("cc0",), r"\bCC0(?:[ \t-]+1\.0)?(?:[ \t]+universal)?\b"),
    ("cc0-url", "CC0-1.0", 60, ("publicdomain/zero",), r"https?://(?:www\.)?creativecommons\.org/publicdomain/zero/1\.0/?"),
    ("cc-pdm", "PDM-1.0", 60, ("publicdomain/mark",), r"https?://(?:www\.)?creativecommons\.org/publicdomain/mark/1\.0/?"),
    ("public-domain", "Public-Domain", 20, ("public domain",), r"\b(?:dedicated[ \t]+to|placed[ \t]+in(?:to)?|released[ \t]+in(?:to)?|in)[ \t]+the[ \t]+public[ \t]+domain\b"),
    ("all-rights", "Proprietary", 20, ("all rights reserved",), r"\ball[ \t]+rights[ \t]+reserved\b\.?"),
    ("proprietary", "Proprietary", 25, ("proprietary",), r"\b(?:this[ \t]+(?:software|document|work)[ \t]+is[ \t]+)?proprietary[ \t]+and[ \t]+confidential\b"),
    ("copyright", "Copyright", 5, ("copyright", "(c)", "©"), r"(?:\bcopyright[ \t]*(?:\(c\)|©)?|\(c\)|©)[ \t]*(?:19|20)\d\d(?:[ \t]*[-–,][ \t]*(?:19|20)\d\d)*"),
    ("gpl-any", "GPL", 10, ("general public",), r"\b(?:GNU[ \t]+)?general[ \t]+public[ \t]+licen[sc]e\b"),
    ("lgpl-any", "LGPL", 12, ("lesser general",), r"\b(?:GNU[ \t]+)?lesser[ \t]+general[ \t]+public[ \t]+licen[sc]e\b"),
    ("apache-any", "Apache", 10, ("apache",), r"\bApache[ \t]+(?:software[ \t]+)?licen[sc]e\b"),
    ("bsd-any", "BSD", 10, ("bsd",), r"\bBSD(?:-style)?[ \t]+licen[sc]e\b"),
    ("mpl-any", "MPL", 10, ("mozilla",), r"\bmozilla[ \t]+public[ \t]+licen[sc]e\b"),
    ("epl-any", "EPL", 10, ("eclipse",), r"\beclipse[ \t]+public[ \t]+licen[sc]e\b"),
    ("gfdl-any", "GFDL", 10, ("free documentation",), r"\b(?:GNU[ \t]+)?free[ \t]+documentation[ \t]+licen[sc]e\b"),
    ("artistic-any", "Artistic", 10, ("artistic",), r"\bartistic[ \t]+licen[sc]e\b"),
    ("cc-any", "CC", 10, ("creative commons",), r"\bcreative[ \t]+commons(?:[ \t]+licen[sc]e)?\b"),
]


def phrases() -> list[Rule]:
    """The rules of license_phrases.py."""
    out = []
    for line in PHRASES.strip().splitlines():
        name, spdx, priority, keyword, pattern = line.split("; ", 4)
        out.append((name, spdx, int(priority), (keyword,), pattern.replace(" ?", "\0").replace(" ", GAP).replace("\0", f"(?:{GAP})?")))
    return out


def rules() -> list[Rule]:
    """All rules. Where two have one priority, the earlier one goes first."""
    out = [(*rule, wrapped(pattern)) for *rule, pattern in NOTICES] + phrases()
    for spdx, (keyword, pattern) in NAMES.items():
        out.append((f"name-{spdx}", spdx, 50, (keyword,), wrapped(pattern)))
        escaped = spdx.replace(".", r"\.").replace("+", r"\+")
        out.append((f"spdx-{spdx}", spdx, 90, ("spdx-license-identifier",), rf"\bSPDX-License-Identifier:[ \t]*{escaped}(?:-only|-or-later|\+)?(?![\w.+-])"))
        out.append((f"field-{spdx}", spdx, 40, ("licen",), rf"\"?\blicen[sc]e\"?[ \t]*[:=][ \t]*[\"']?{escaped}(?:-only|-or-later|\+)?[\"']?(?![\w.+-])"))
    for suffix, words in _CC.items():
        for version in _CC_VERSIONS:
            v, spdx, low = version.replace(".", r"\."), f"CC-{suffix}-{version}", suffix.lower()
            short = suffix.replace("-", "[ \\t-]")
            out.append((f"short-{spdx}", spdx, 60, ("cc",), wrapped(rf"\bCC[ \t-]{short}[ \t-]v?{v}\b")))
            out.append((f"under-{spdx}", spdx, 80, ("cc",), wrapped(rf"\b(?:licensed|released|available)[ \t]+under[ \t]+(?:the[ \t]+)?CC[ \t-]{short}[ \t-]v?{v}\b\.?")))
            out.append((f"long-{spdx}", spdx, 65, ("creative commons",), wrapped(rf"\bcreative[ \t]+commons[ \t]+{words}[ \t]+(?:international[ \t]+|unported[ \t]+)?v?{v}(?:[ \t]+(?:international|unported|generic))?\b")))
            out.append((f"url-{spdx}", spdx, 60, ("creativecommons.org",), rf"https?://(?:www\.)?creativecommons\.org/licenses/{low}/{v}/?"))
    return out
