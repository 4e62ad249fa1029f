"""Signature rules of the licence scan, written over lower-case words with one blank between them.

A rule is label, priority (1 wins over 4), confidence, the keyword without which it is not tried, and a regex. Every
alternative of the regex holds one of the keywords as a whole word.
NAMES holds one hand-written name signature per licence, from which its tag rule follows; GRANTS, WORDINGS,
FAMILIES and NOTICES hold wordings of grants, passages of full texts, names without a version, and notices.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    keyword: str  # one of several, with | between them
    regex: str
    base: bool = False


TAG, TEXT, NAME, NOTICE = 1, 2, 3, 4
L = "licen[cs]e"
V = "(?: version| ver| v)?"
GPL = f"(?:gnu )?(?:general public {L}|gpl)"
LGPL = f"(?:gnu )?(?:(?:lesser|library) (?:general public {L}|gpl)|lgpl)"
AGPL = f"(?:gnu )?(?:affero (?:general public {L}|gpl)|agpl)"
CC = "(?:creative commons|cc)"
BY, NC, ND, SA = "(?:attribution|by)", "(?: non ?commercial| nc)", "(?: no ?deriv(?:ative)?s?(?: works)?| nd)", "(?: share ?alike| sa)"

# Identifier, keyword and name signature; the tag rule is made from the identifier.
NAMES = [
    ("0BSD", "0bsd|bsd", "(?:zero clause bsd|bsd zero clause|0bsd)"),
    ("AAL", "attribution", f"attribution assurance {L}"),
    ("AFL-2.1", "academic", f"academic free {L}{V} ?2 1"),
    ("AFL-3.0", "academic", f"academic free {L}{V} ?3(?: 0)?"),
    ("AGPL-1.0-only", "affero", f"affero general public {L}{V} ?1(?: 0)?"),
    ("AGPL-3.0-only", "affero|agpl", f"{AGPL}{V} v?3(?: 0)?"),
    ("Apache-1.0", "apache", f"apache(?: software)? {L}{V} ?1 0"),
    ("Apache-1.1", "apache", f"apache(?: software)? {L}{V} ?1 1"),
    ("Apache-2.0", "apache", f"apache(?: software)?(?: foundation)?(?: {L})?{V} v?2(?: 0)?"),
    ("APSL-2.0", "apple", f"apple public source {L}{V} ?2(?: 0)?"),
    ("Artistic-1.0", "artistic", f"artistic {L}{V} ?1(?: 0)?"),
    ("Artistic-2.0", "artistic", f"artistic {L}{V} ?2(?: 0)?"),
    ("Beerware", "beer|beerware", f"beer ?ware {L}"),
    ("BlueOak-1.0.0", "oak", f"blue oak model {L}(?: 1 0 0)?"),
    ("BSD-1-Clause", "bsd", f"(?:bsd (?:1|one) clause|(?:1|one) clause bsd)(?: {L})?"),
    ("BSD-2-Clause", "bsd|freebsd", f"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: {L})?"),
    ("BSD-3-Clause", "bsd", f"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)(?: {L})?"),
    ("BSD-4-Clause", "bsd", f"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|(?:original|old) bsd)(?: {L})?"),
    ("BSL-1.0", "boost", f"boost software {L}(?:{V} ?1(?: 0)?)?"),
    ("BUSL-1.1", "business", f"business source {L}(?:{V} ?1 1)?"),
    ("CAL-1.0", "cryptographic", f"cryptographic autonomy {L}(?:{V} ?1 0)?"),
    ("CATOSL-1.1", "computer", f"computer associates trusted open source {L}(?: 1 1)?"),
    ("CC0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("CDDL-1.0", "common", f"common development and distribution {L}{V} ?1(?: 0)?"),
    ("CDDL-1.1", "common", f"common development and distribution {L}{V} ?1 1"),
    ("CECILL-2.1", "cecill|cecill2", "cecill(?: version| v)? ?2 1"),
    ("CECILL-B", "cecill", "cecill b"),
    ("CECILL-C", "cecill", "cecill c"),
    ("ClArtistic", "clarified", f"clarified artistic {L}"),
    ("CPAL-1.0", "common", f"common public attribution {L}(?:{V} ?1 0)?"),
    ("CPL-1.0", "common", f"common public {L}(?:{V} ?1 0)?"),
    ("CUA-OPL-1.0", "cua", f"cua office public {L}(?: 1 0)?"),
    ("ECL-2.0", "educational", f"educational community {L}(?:{V} ?2 0)?"),
    ("EFL-2.0", "eiffel", f"eiffel forum {L}(?:{V} ?2)?"),
    ("Elastic-2.0", "elastic", f"elastic {L}(?: 2 0)?"),
    ("Entessa", "entessa", f"entessa public {L}"),
    ("EPL-1.0", "eclipse", f"eclipse public {L}{V} ?v?1(?: 0)?"),
    ("EPL-2.0", "eclipse", f"eclipse public {L}{V} ?v?2(?: 0)?"),
    ("EUDatagrid", "datagrid", f"eu datagrid software {L}"),
    ("EUPL-1.1", "european", f"european union public {L}{V} ?1 1"),
    ("EUPL-1.2", "european", f"european union public {L}{V} ?1 2"),
    ("Fair", "fair", f"fair {L}"),
    ("FTL", "freetype", f"freetype(?: project)? {L}"),
    ("Frameworx-1.0", "frameworx", f"frameworx(?: open)? {L}(?: 1 0)?"),
    ("GFDL-1.2-only", "documentation", f"(?:gnu )?free documentation {L}{V} ?1 2"),
    ("GFDL-1.3-only", "documentation", f"(?:gnu )?free documentation {L}{V} ?1 3"),
    ("GPL-1.0-only", "public|gpl", f"{GPL}{V} v?1(?: 0)?"),
    ("GPL-2.0-only", "public|gpl", f"{GPL}{V} v?2(?: 0)?"),
    ("GPL-3.0-only", "public|gpl", f"{GPL}{V} v?3(?: 0)?"),
    ("HPND", "historical", "historical permission notice and disclaimer"),
    ("ICU", "icu", f"icu {L}"),
    ("IJG", "jpeg", f"independent jpeg group(?: s)? {L}"),
    ("ImageMagick", "imagemagick", f"imagemagick {L}"),
    ("Info-ZIP", "zip", f"info zip {L}"),
    ("Intel", "intel", f"intel open source {L}"),
    ("IPA", "ipa", f"ipa font {L}"),
    ("IPL-1.0", "ibm", f"ibm public {L}(?:{V} ?1 0)?"),
    ("ISC", "isc", f"isc {L}"),
    ("JSON", "json", f"json {L}"),
    ("LAL-1.3", "libre|art", f"licence art libre(?: 1 3)?|free art {L}(?: 1 3)?"),
    ("LGPL-2.0-only", "public|gpl|lgpl", f"{LGPL}{V} v?2(?: 0)?"),
    ("LGPL-2.1-only", "public|gpl|lgpl", f"{LGPL}{V} v?2 1"),
    ("LGPL-3.0-only", "public|gpl|lgpl", f"{LGPL}{V} v?3(?: 0)?"),
    ("Libpng", "libpng", f"libpng {L}"),
    ("LiLiQ-P-1.1", "liliq", "liliq p(?: 1 1)?"),
    ("LPL-1.02", "lucent", f"lucent public {L}(?:{V} ?1 02)?"),
    ("LPPL-1.3c", "latex", f"latex project public {L}(?:{V} ?1 3c?)?"),
    ("MirOS", "miros", f"miros {L}"),
    ("MIT", "mit|expat|x11", f"mit {L}|{L} mit|(?:expat|x11) {L}"),
    ("MIT-0", "mit", "mit no attribution|mit 0"),
    ("Motosoto", "motosoto", f"motosoto(?: open source)? {L}"),
    ("MPL-1.0", "mozilla", f"mozilla public {L}{V} ?v?1 0"),
    ("MPL-1.1", "mozilla", f"mozilla public {L}{V} ?v?1 1"),
    ("MPL-2.0", "mozilla", f"mozilla public {L}{V} ?v?2(?: 0)?"),
    ("MS-PL", "microsoft", f"microsoft public {L}"),
    ("MS-RL", "microsoft", f"microsoft reciprocal {L}"),
    ("MulanPSL-2.0", "mulan", f"mulan (?:permissive software|psl)(?: {L})?{V} ?v?2"),
    ("NASA-1.3", "nasa", "nasa open source agreement(?: 1 3)?"),
    ("Naumen", "naumen", f"naumen public {L}"),
    ("NCSA", "ncsa", f"(?:university of illinois )?ncsa open source {L}"),
    ("NGPL", "nethack", f"nethack general public {L}"),
    ("Nokia", "nokia", f"nokia open source {L}"),
    ("NPOSL-3.0", "profit", f"non profit open software {L}(?: 3 0)?"),
    ("NTP", "ntp", f"ntp {L}"),
    ("OCLC-2.0", "oclc", f"oclc research public {L}(?: 2 0)?"),
    ("ODbL-1.0", "database", f"open (?:data commons open )?database {L}(?:{V} ?v?1 0)?"),
    ("ODC-By-1.0", "commons", f"open data commons attribution {L}(?:{V} ?v?1 0)?"),
    ("OFL-1.1", "font", f"(?:sil )?open font {L}(?:{V} ?1 1)?"),
    ("OGL-UK-3.0", "government", f"open government {L}(?:{V} ?v?3 0)?"),
    ("OGTSL", "group", f"open group test suite {L}"),
    ("OpenSSL", "openssl", f"openssl {L}"),
    ("OSET-PL-2.1", "oset", f"oset public {L}(?: 2 1)?"),
    ("OSL-3.0", "software", f"open software {L}(?:{V} ?3 0)?"),
    ("PDDL-1.0", "dedication", f"public domain dedication and {L}"),
    ("PHP-3.01", "php", f"php {L}(?:{V} ?3 01)?"),
    ("PolyForm-Noncommercial-1.0.0", "polyform", f"polyform noncommercial(?: {L})?(?: 1 0 0)?"),
    ("PostgreSQL", "postgresql", f"postgresql {L}"),
    ("PSF-2.0", "python", f"python software foundation {L}(?:{V} ?2)?"),
    ("QPL-1.0", "public", f"q(?:t)? public {L}(?:{V} ?1 0)?"),
    ("RPL-1.5", "reciprocal", f"reciprocal public {L}(?: 1 5)?"),
    ("RPSL-1.0", "realnetworks", f"realnetworks public source {L}(?:{V} ?1 0)?"),
    ("RSCPL", "ricoh", f"ricoh source code public {L}"),
    ("Ruby", "ruby", f"ruby(?: s)? {L}"),
    ("Sendmail", "sendmail", f"sendmail {L}"),
    ("SimPL-2.0", "simple", f"simple public {L}(?: 2 0)?"),
    ("Sleepycat", "sleepycat", f"sleepycat {L}"),
    ("SPL-1.0", "sun", f"sun public {L}(?:{V} ?1 0)?"),
    ("SSPL-1.0", "server", f"server side public {L}(?:{V} ?1)?"),
    ("TCL", "tcl", f"tcl tk {L}|tcl {L}"),
    ("UPL-1.0", "permissive", f"universal permissive {L}(?:{V} ?1 0)?"),
    ("Unicode-3.0", "unicode", f"unicode {L}(?:{V} ?(?:v3|3))?"),
    ("Unlicense", "unlicense", "(?:the )?unlicense"),
    ("Vim", "vim", f"vim {L}"),
    ("VSL-1.0", "vovida", f"vovida software {L}(?: 1 0)?"),
    ("W3C", "w3c", f"w3c software(?: notice and)? {L}"),
    ("Watcom-1.0", "watcom", f"sybase open watcom public {L}(?: 1 0)?"),
    ("WTFPL", "wtfpl|fuck", "wtfpl|do what the fuck you want to public licen[cs]e"),
    ("Xnet", "net", f"x net {L}"),
    ("ZPL-2.1", "zope", f"zope public {L}(?:{V} ?2 1)?"),
    ("Zlib", "zlib", f"zlib(?: libpng)? {L}"),
]

# Wordings of grants and full texts.
GRANTS = [
    ("MIT", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "mit", f"(?:released|distributed|licen[cs]ed|available) under (?:the )?(?:terms of (?:the )?)?mit(?: {L})?"),
    ("ISC", "permission", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("Apache-2.0", "apache", f"licen[cs]ed (?:under|to you under) (?:the )?apache(?: software)? {L}{V} ?v?2(?: 0)?"),
    ("BSD-3-Clause", "neither", "neither the name of (?:\\S+ ){1,8}nor the names of its contributors may be used to endorse or promote products"),
    ("BSD-2-Clause", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    ("BSD-4-Clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("GPL-2.0-or-later", "public|gpl|lgpl", f"{GPL}(?: \\S+){{0,8}}? either{V} 2 of the {L} or at your option any later version"),
    ("GPL-3.0-or-later", "public|gpl|lgpl", f"{GPL}(?: \\S+){{0,8}}? either{V} 3 of the {L} or at your option any later version"),
    ("LGPL-2.1-or-later", "public|gpl|lgpl", f"{LGPL}(?: \\S+){{0,8}}? either{V} 2 1 of the {L} or at your option any later version"),
    ("LGPL-3.0-or-later", "public|gpl|lgpl", f"{LGPL}(?: \\S+){{0,8}}? either{V} 3 of the {L} or at your option any later version"),
    ("AGPL-3.0-or-later", "affero|agpl", f"{AGPL}(?: \\S+){{0,8}}? either{V} 3 of the {L} or at your option any later version"),
    ("GPL-2.0-or-later", "public|gpl|lgpl", f"{GPL}{V} v?2(?: 0)? or (?:any )?later"),
    ("GPL-3.0-or-later", "public|gpl|lgpl", f"{GPL}{V} v?3(?: 0)? or (?:any )?later"),
    ("GPL-3.0-only", "public|gpl", f"licen[cs]ed under (?:the )?(?:terms of the )?{GPL}{V} v?3(?: 0)?"),
    ("GPL-2.0-only", "public|gpl", f"licen[cs]ed under (?:the )?(?:terms of the )?{GPL}{V} v?2(?: 0)?"),
    ("MPL-2.0", "mozilla", f"this source code form is subject to the terms of the mozilla public {L} v 2 0"),
    ("Zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("Unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("BSL-1.0", "boost", f"distributed under the boost software {L}{V} 1 0"),
    ("CC0-1.0", "waived", "has waived all copyright and related or neighbo?u?ring rights"),
    ("CC0-1.0", "cc0", "(?:dedicated|released) (?:\\S+ ){0,6}(?:under|via|with) cc0(?: 1 0)?"),
    ("OFL-1.1", "font", f"this font software is licen[cs]ed under the sil open font {L}{V} 1 1"),
    ("WTFPL", "fuck", "you just do what the fuck you want to"),
    ("Beerware", "beer", "you can buy me a beer in return"),
    ("JSON", "evil", "the software shall be used for good not evil"),
    ("EUPL-1.2", "eupl", "licen[cs]ed under the eupl(?: 1 2)?"),
    ("SSPL-1.0", "sspl", "licen[cs]ed under the sspl(?: v?1)?"),
    ("Elastic-2.0", "elastic|hosted", f"you may not provide the software to third parties as a hosted or managed service|licen[cs]ed under the elastic {L}(?: 2 0)?"),
]

# Passages of full texts, and more grants, of the licences above.
PERMIT = "permission to use copy modify and(?: or)? distribute this software"
WORDINGS = [
    ("0BSD", "permission", f"{PERMIT} for any purpose with or without fee is hereby granted the software is provided as is"),
    ("AFL-3.0", "academic", f"licen[cs]ed under the academic free {L}{V} 3 0"),
    ("AFL-2.1", "academic", f"licen[cs]ed under the academic free {L}{V} 2 1"),
    ("AGPL-3.0-only", "affero", f"the gnu affero general public {L} is a free copyleft {L} for software and other kinds of works"),
    ("Apache-2.0", "reproduction", "terms and conditions for use reproduction and distribution 1 definitions"),
    ("Artistic-1.0", "semblance", "maintains some semblance of artistic control over the development of the package"),
    ("Artistic-2.0", "establishes", f"this {L} establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("Beerware", "retain", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("BlueOak-1.0.0", "infringe", "to do everything with this software that would otherwise infringe that contributor s copyright in it"),
    ("BSD-3-Clause", "endorse", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSL-1.0", "accompanying", f"any person or organization obtaining a copy of the software and accompanying documentation covered by this {L}"),
    ("BUSL-1.1", "licensor", f"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the {L}d work"),
    ("CC0-1.0", "affirmer", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("CPL-1.0", "accompanying", f"the accompanying program is provided under the terms of this common public {L}"),
    ("ECL-2.0", "educational", f"licen[cs]ed under the educational community {L}{V} 2 0"),
    ("Elastic-2.0", "hosted", "you may not provide the software to third parties as a hosted or managed service where the service provides users with access to any substantial set of the features or functionality of the software"),
    ("EPL-1.0", "eclipse", f"made available under the terms of the eclipse public {L}{V} v?1 0 which accompanies this distribution"),
    ("EPL-2.0", "eclipse", f"made available under the terms of the eclipse public {L}{V} v?2 0 which is available at"),
    ("epl", "eclipse", f"the accompanying program is provided under the terms of this eclipse public {L}"),
    ("EUPL-1.1", "eupl", f"licen[cs]ed under the eupl{V} 1 1"),
    ("EUPL-1.2", "eupl", f"licen[cs]ed under the eupl{V} 1 2"),
    ("Fair", "instrument", "usage of the works is permitted provided that this instrument is retained with the works"),
    ("FTL", "freetype", "portions of this software are copyright(?: c)?(?: \\S+)? the freetype project"),
    ("gfdl", "textbook", f"the purpose of this {L} is to make a manual textbook or other functional and useful document free"),
    ("GPL-1.0-only", "mercy", f"the {L} agreements of most software companies try to keep users at the mercy of those companies"),
    ("GPL-3.0-only", "copyleft", f"the gnu general public {L} is a free copyleft {L} for software and other kinds of works"),
    ("HPND", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("IJG", "jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("IPL-1.0", "ibm", f"the accompanying program is provided under the terms of this ibm public {L}"),
    ("LGPL-2.0-only", "ordinary", "first released version of the library gpl it is numbered 2 because it goes with version 2 of the ordinary gpl"),
    ("LGPL-2.1-only", "successor", f"it also counts as the successor of the gnu library public {L} version 2 hence the version number 2 1"),
    ("LGPL-3.0-only", "incorporates", f"this version of the gnu lesser general public {L} incorporates the terms and conditions of version 3 of the gnu general public {L}"),
    ("LPPL-1.3c", "latex", f"may be distributed and or modified under the conditions of the latex project public {L}"),
    ("MirOS", "disclaimer", "provided that these terms and disclaimer and all copyright notices are retained or reproduced in an accompanying document"),
    ("MPL-1.1", "mozilla", f"the contents of this file are subject to the mozilla public {L}{V} 1 1"),
    ("MPL-2.0", "contributor", f"each contributor hereby grants you a world wide royalty free non exclusive {L}"),
    ("MulanPSL-2.0", "mulan", f"licen[cs]ed under mulan psl{V} v?2"),
    ("NCSA", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("NTP", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("ODbL-1.0", "database", f"is made available under the open database {L}"),
    ("OFL-1.1", "worldwide", f"the goals of the open font {L} ofl are to stimulate worldwide development of collaborative font projects"),
    ("OGL-UK-3.0", "government", f"contains public sector information licen[cs]ed under the open government {L}{V} v?3 0"),
    ("OpenSSL", "openssl", "the names openssl toolkit and openssl project must not be used to endorse or promote products"),
    ("OSL-3.0", "open", f"licen[cs]ed under the open software {L}{V} 3 0"),
    ("PDDL-1.0", "dedication", f"is made available under the public domain dedication and {L}"),
    ("PHP-3.01", "php", "products derived from this software may not be called php nor may php appear in their name"),
    ("PolyForm-Noncommercial-1.0.0", "noncommercial", "any noncommercial purpose is a permitted purpose"),
    ("PostgreSQL", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("PSF-2.0", "psf", f"psf hereby grants {L}e a nonexclusive royalty free world wide {L}"),
    ("Sleepycat", "accompanied", "redistributions in any form must be accompanied by information on how to obtain complete source code for the db software"),
    ("SSPL-1.0", "functionality", "if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available"),
    ("Unicode-3.0", "permission", "permission is hereby granted free of charge to any person obtaining a copy of data files and any associated documentation"),
    ("Unlicense", "anyone", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("UPL-1.0", "associated", "any person obtaining a copy of this software associated documentation and or data"),
    ("Vim", "charityware", "vim is charityware"),
    ("W3C", "permission", "permission to copy modify and distribute this software and its documentation with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("WTFPL", "verbatim", f"copy and distribute verbatim or modified copies of this {L} document and changing it is allowed as long as the name is changed"),
    ("Zlib", "liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
]

# Names without a version.
FAMILIES = [
    ("agpl", "affero|agpl", AGPL), ("lgpl", "lesser|library|lgpl", LGPL),
    ("gpl", "gpl", "(?:gnu )?gpl"), ("gpl", "general", f"(?:gnu )?general public {L}"), ("gpl", "copyleft", "copyleft"), ("gfdl", "documentation", f"free documentation {L}"), ("gfdl", "gfdl", "gfdl"),
    ("apache", "apache", f"apache(?: software)? {L}"), ("bsd", "bsd", f"bsd(?: style)? {L}"), ("mpl", "mozilla", f"mozilla public {L}"), ("mpl", "mpl", "mpl"),
    ("epl", "eclipse", f"eclipse public {L}"), ("cddl", "cddl", "cddl"), ("eupl", "eupl", "eupl"), ("artistic", "artistic", f"artistic {L}"),
    ("afl", "academic", f"academic free {L}"), ("cc", "commons", f"creative commons(?: {L})?"), ("osl", "software", f"open software {L}"),
    ("mit", "mit", f"mit style {L}"), ("ogl", "government", f"open government {L}"), ("cecill", "cecill", "cecill"), ("ofl", "ofl", "ofl"),
    ("odbl", "odbl", "odbl"), ("zpl", "zope", f"zope public {L}"), ("wtfpl", "fuck", "what the fuck you want"),
]

# Notices that name no licence.
NOTICES = [
    ("public-domain", 0.7, "domain", "(?:in|into|to) the public domain"),
    ("public-domain", 0.5, "domain", "public domain"),
    ("copyright", 0.4, "copyright", "copyright(?: c)? (?:19|20)\\d\\d(?: (?:19|20)?\\d\\d)?"),
    ("reserved", 0.5, "rights", "some rights reserved"),
    ("proprietary", 0.6, "proprietary", "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", 0.6, "redistribution", "redistribution (?:is )?(?:strictly )?prohibited"),
    ("proprietary", 0.6, "permission", "without (?:the )?(?:express |prior )*(?:written )?permission"),
    ("proprietary", 0.5, "commercial", f"commercial {L}"),
    ("freeware", 0.5, "freeware", "freeware"),
    ("shareware", 0.5, "shareware", "shareware"),
    ("patent", 0.4, "patent", f"patent {L}"),
    ("warranty", 0.3, "warranty", "without warranty of any kind"),
    ("warranty", 0.3, "warranties", "without warranties or conditions of any kind"),
    ("eula", 0.5, "agreement", f"end user {L} agreement"),
]

BASE = [
    ("cc-by", "cc", "cc by"),
    ("gpl", "general", "general public license"),
    ("reserved", "reserved", "all rights reserved"),
]


def words_of(identifier: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in identifier.lower()).split())


def creative_commons() -> list[Rule]:
    """Each licence with each version it has, and without one."""
    parts = {"by": BY, "by-nc": BY + NC, "by-nd": BY + ND, "by-sa": BY + SA, "by-nc-nd": BY + NC + ND, "by-nc-sa": BY + NC + SA}
    rules = []
    for name, regex in parts.items():
        named = f"{CC} {regex}"
        rules += [Rule(f"cc-{name}-{v}", TEXT, 0.95, "commons|cc", f"{named}(?: {L})?{V} {v.replace('.', ' ')}(?: international| generic| unported)?")
                  for v in ("1.0", "2.0", "2.5", "3.0", "4.0")]
        rules.append(Rule(f"cc-{name}", NAME, 0.8, "commons|cc", named))
    return rules


def all_rules() -> list[Rule]:
    rules = [Rule(name.lower(), TAG, 1.0, "spdx", f"spdx {L} identifier {words_of(name)}") for name, _, _ in NAMES]
    rules += [Rule(label.lower(), TAG, 0.98, keyword, regex) for label, keyword, regex in GRANTS]
    rules += [Rule(label.lower(), TAG, 0.98, keyword, regex) for label, keyword, regex in WORDINGS]
    rules += creative_commons()
    rules += [Rule(name.lower(), TEXT, 0.95, keyword, regex) for name, keyword, regex in NAMES]
    rules += [Rule(label, NAME, 0.75, keyword, regex) for label, keyword, regex in FAMILIES]
    rules += [Rule(label, NOTICE, confidence, keyword, regex) for label, confidence, keyword, regex in NOTICES]
    return rules + [Rule(label, NOTICE, 0.6, keyword, regex, True) for label, keyword, regex in BASE]
