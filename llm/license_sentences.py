"""What license scans know: names of licenses, sentences of their texts and headers, and the sequences that make up a license."""

from __future__ import annotations

# Fixed values. All patterns are of normalised sentences: lower case, one blank between words, without quotes,
# brackets, bullets, numbers of clauses and the last stop.

#: Words ahead of a license's name, and a version's.
LEAD = r"(?:.{0,80}?\b(?:is|are|was|be|been|and|work|project|software|code)[ ,])?(?:(?:dual|triple)[- ])?(?:free software )?(?:distributed|licensed|released|redistributed|available|made available|provided|published|covered|usable|offered)(?: to you| freely| here| as open source| as is)? (?:under|by|subject to)(?: the)?(?: terms(?: and conditions)?(?: of)?| conditions of)?(?: the| an?)?(?: permissive| standard| open source| free)? "
BRIEF = r"(?:(?:the )?license[ :]+(?:is |osi approved :: |under )?(?:the )?|for the license, see the )"
V = r"(?:,? ?(?:version|v\.?|release)? ?)"
LATER = r"(?:,? (?:or|and)(?: at your option)?,? (?:any )?(?:later|newer|greater)(?: versions?)?)"

#: (identifier, pattern of the name); {0} and so on stand for captured parts, a plus for "or later".
NAMES: list[tuple[str, str]] = [
    ("Apache-{0}", r"apache(?: software)?(?: foundation)?(?: public)? license(?: the)?" + V + r"([12](?:\.[01])?)(?: the license)?"),
    ("Apache-{0}", r"apache[- ]?([12]\.[01])(?: license)?"),
    ("MIT", r"(?:mit|expat)(?:/x11| x11|/expat)?[ -]?(?:style )?license(?: mit)?"),
    ("X11", r"x11 license"),
    ("ISC", r"isc license(?: isc)?"),
    ("BSD-{0}-Clause", r"(?:bsd[ -])?([0-4])[- ]clause(?: bsd)?(?: license)?"),
    ("BSD-3-Clause", r"(?:(?:new|modified|revised|3-clause) bsd|bsd[- ]new|bsd 3-clause new or revised)(?: license)?"),
    ("BSD-2-Clause", r"(?:simplified|freebsd) bsd(?: license)?"),
    ("BSD-any", r"bsd(?:[ -]style)? license"),
    ("0BSD", r"(?:zero[- ]clause bsd|0bsd)(?: license)?"),
    ("GPL-{0}+", r"(?:gnu )?(?:general public license|gpl)" + V + r"([1-3](?:\.0)?)(?:\+|" + LATER + r")(?: gpl(?:v|-)[1-3]\+?)?"),
    ("GPL-{0}", r"(?:gnu )?(?:general public license|gpl)" + V + r"([1-3](?:\.0)?)(?: only)?(?: gpl(?:v|-)[1-3])?"),
    ("GPL-any", r"(?:gnu )?(?:general public license|gpl)"),
    ("LGPL-{0}+", r"(?:gnu )?(?:(?:lesser|library)(?: general public license| gpl)|lgpl)" + V + r"([2-3](?:\.[01])?)(?:\+|" + LATER + ")"),
    ("LGPL-{0}", r"(?:gnu )?(?:(?:lesser|library)(?: general public license| gpl)|lgpl)" + V + r"([2-3](?:\.[01])?)(?: only)?"),
    ("LGPL-any", r"(?:gnu )?(?:(?:lesser|library) general public license|lgpl)"),
    ("AGPL-{0}+", r"(?:gnu )?(?:affero (?:general public license|gpl)|agpl)" + V + r"([1-3](?:\.0)?)(?:\+|" + LATER + ")"),
    ("AGPL-{0}", r"(?:gnu )?(?:affero (?:general public license|gpl)|agpl)" + V + r"([1-3](?:\.0)?)(?: only)?"),
    ("GFDL-{0}", r"gnu free documentation license" + V + r"([1-3]\.[0-3])"),
    ("MPL-{0}", r"(?:mozilla public license|mpl)(?: mpl)?" + V + r"([12]\.[01])"),
    ("EPL-{0}", r"(?:eclipse public license|epl)" + V + r"([12]\.0)"),
    ("EUPL-{0}", r"(?:european union public license|eupl)" + V + r"(1\.[0-2])"),
    ("CDDL-{0}", r"(?:common development and distribution license|cddl)" + V + r"(1\.[01])"),
    ("CPL-1.0", r"common public license" + V + r"1\.0"),
    ("Artistic-{0}", r"artistic license" + V + r"([12]\.0)"),
    ("Artistic-1.0-Perl", r"same terms as perl(?: ?5)?(?: itself)?"),
    ("BSL-1.0", r"boost software license" + V + r"1\.0"),
    ("Zlib", r"zlib(?:/libpng)? license"),
    ("Unlicense", r"unlicense(?: license)?"),
    ("WTFPL", r"wtfpl(?: license)?(?:,? version 2)?"),
    ("PSF-2.0", r"(?:python software foundation|psf) license" + V + r"(?:2(?:\.0)?)?"),
    ("OFL-1.1", r"(?:sil )?(?:open font license|ofl)" + V + r"1\.1"),
    ("MS-PL", r"(?:microsoft public license|ms-pl)"),
    ("MS-RL", r"(?:microsoft reciprocal license|ms-rl)"),
    ("NCSA", r"(?:university of illinois/)?ncsa(?: open source)? license"),
    ("AFL-{0}", r"academic free license" + V + r"([123]\.[01])"),
    ("ODbL-1.0", r"(?:open (?:data commons )?(?:open )?database license|odbl)" + V + r"(?:1\.0)?"),
    ("ODC-By-1.0", r"open data commons attribution license" + V + r"(?:1\.0)?"),
    ("SSPL-1.0", r"server side public license" + V + r"(?:1(?:\.0)?)?"),
    ("Elastic-2.0", r"elastic license" + V + r"2\.0"),
    ("BUSL-1.1", r"business source license" + V + r"1\.1"),
    ("CC0-1.0", r"(?:cc0|cc-0|cc zero|creative commons zero)(?:[ -]1\.0)?(?: universal)?(?: \(?cc0(?:[ -]1\.0)?\)?)?(?: public domain dedication)?(?: license)?"),
    ("CC-BY{0}{1}", r"(?:cc|creative commons)[ -](?:by|attribution)((?:[ -](?:nc|noncommercial|non-commercial))?(?:[ -](?:sa|nd|sharealike|share-alike|share alike|noderivatives|noderivs|no-derivatives))?)[ -]?([1-4]\.[05])?(?: international| unported| generic)?(?: public)?(?: licenses?)?(?: cc[ -]by[a-z-]* ?[1-4]\.[05])?"),
]

_GNU = r"(?:this (?:program|library|software|file|package|module|work|project)|[a-z0-9_. -]{{1,60}}) is free software[:;,.]? you (?:can|may) redistribute it and ?/? ?(?:or)? modify it under the terms of (?:version ([1-3](?:\.[01])?) of )?the gnu {}general public license"
_BY = r" as published by the free software foundation"
_THIS = r"(?:this |the |[a-z0-9_. -]{1,60}? )?(?:program|library|software|file|package|module|work|project|[a-z0-9_.-]+)"
_NO_WARRANTY = r"(?:,? ?without (?:any )?(?:express or implied )?warrant(?:y|ies).*|,? ?but without any warranty.*)"
_COPYING = r"you should have received a copy of the gnu {}general public license(?: version [1-3](?:\.[01])?)?(?: and a copy of the gnu general public license)? along with .*"

#: (identifier, pattern) of the sentences that texts and headers of licenses are made of.
SENTENCES: list[tuple[str, str]] = [
    # Apache
    ("Apache-may-not-use", r"you may not use this (?:file|work|software|project)(?: except in compliance with the license| .{0,40}except in compliance with .*)"),
    ("Apache-obtain", r"you may obtain a copy of the license at:?(?: https?://www\.apache\.org/licenses/license-2\.0(?:\.txt|\.html)?)?"),
    ("Apache-as-is", r"unless required by applicable law or agreed to in writing,? (?:software|the software) distributed under the license is distributed on an as[ -]is basis,? without warranties or conditions of any kind,? either express or implied"),
    ("Apache-see", r"see the license for the specific language governing permissions and limitations under the license"),
    ("Apache-contributors", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("Apache-notice", r"see the notice file distributed with this work for additional information regarding copyright ownership"),
    ("Apache-asf", r"the asf licenses this file to you under the apache license, version ([12]\.[01]) the license"),
    ("Apache-title", r"(?:.{0,60})?apache license,? version 2\.0,? january 2004(?: https?://www\.apache\.org/licenses/?)?"),
    ("Apache-terms", r"terms and conditions for use, reproduction, and distribution"),
    ("Apache-grant", r"(?:grant of copyright license )?subject to the terms and conditions of this license, each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to .*"),
    ("Apache-patent", r"(?:grant of patent license )?subject to the terms and conditions of this license, each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable except as stated in this section patent license .*"),
    ("Apache-redistribution", r"(?:redistribution )?you may reproduce and distribute copies of the work or derivative works thereof in any medium, with or without modifications, .*"),
    ("Apache-end", r"(?:.{0,40})?end of terms and conditions"),
    ("Apache-appendix", r"(?:.*)?to apply the apache license to your work, attach the following boilerplate notice.*"),
    # MIT and its kin
    ("MIT-title", r"(?:the )?(?:mit|expat) license(?: mit)?"),
    ("MIT-grant", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of this software and associated documentation files? the software,? to deal in the software without restriction,? including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and ?/?(?:or)? sell copies of the software,? and to permit persons to whom the software is furnished to do so,? subject to the following conditions:?"),
    ("MIT-grant", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of this software and associated documentation files.*"),
    ("MIT-notice", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("MIT-good", r"the software shall be used for good, not evil"),
    ("MIT-as-is", r"the software is provided as[ -]is,? without warranty of any kind,? expressed? or implied.*"),
    ("MIT-as-is", r"the software is provided as[ -]is,? without warranty of any kind"),
    ("MIT-no-liability", r"in no event shall (?:the )?(?:authors?|copyright holders?|[a-z0-9., -]{1,80}?)(?: or copyright holders?)? be liable for any claim,? damages or other liability.*"),
    ("MIT-no-liability", r"in no event shall the authors or copyright holders be liable for any claim"),
    ("X11-name", r"except as contained in this notice,? the names? .* shall not be used in advertising or otherwise to promote the sale, use or other dealings in this software without prior written authorization.*"),
    # ISC, 0BSD and the older notices of permission
    ("ISC-title", r"(?:the )?isc license(?: isc)?"),
    ("ISC-grant", r"permission to use,? copy,? modify,? (?:and|and ?/ ?or|or) distribute this software (?:and its documentation )?for any purpose (?:with or without fee|and without fee) is hereby granted,? provided that the above copyright notice(?:s)?(?: and this permission notice)? appear in all copies"),
    ("0BSD-grant", r"permission to use,? copy,? modify,? (?:and|and ?/ ?or|or) distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC-as-is", r"the software is provided as[ -]is and (?:the author|isc|[a-z0-9., -]{1,80}?) disclaims? all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("ISC-no-liability", r"in no event shall (?:the author|isc|[a-z0-9., -]{1,80}?) be liable for any special, direct, indirect, or consequential damages or any damages whatsoever.*"),
    ("HPND-grant", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appears? in all copies and that both that copyright notice and this permission notice appear in supporting documentation.*"),
    # BSD
    ("BSD-redistribution", r"redistribution and use in source and binary forms,? with or without modification,? are permitted(?: \(subject to the limitations in the disclaimer below\))? provided that the following conditions are met:?"),
    ("BSD-source", r"redistributions? of source code must retain the above copyright notice.*"),
    ("BSD-binary", r"redistributions? in binary form must reproduce the above copyright notice.*"),
    ("BSD-advertising", r"all advertising materials mentioning features or use of this software must display the following ack?nowledge?ment:?.*"),
    ("BSD-acknowledgement", r"this product includes software developed by .*"),
    ("BSD-endorse", r"(?:neither )?the names? (?:of )?.*may (?:not )?be used to endorse or promote products derived from this (?:software|[a-z0-9_-]+)(?: without .*)?"),
    ("BSD-as-is", r"this software is provided (?:by .*|as[ -]is).*any express or implied warranties.*"),
    ("BSD-no-liability", r"in no event shall .*be liable for any direct, indirect, incidental, special, exemplary, or consequential damages.*"),
    # GNU
    ("GNU-title", r"(?:.{0,40})?gnu general public license,? version ([1-3](?:\.[01])?),? .*(?:19|20)[0-9]{2}"),
    ("LGNU-title", r"(?:.{0,40})?gnu (?:lesser|library) general public license,? version ([1-3](?:\.[01])?),? .*(?:19|20)[0-9]{2}"),
    ("AGNU-title", r"(?:.{0,40})?gnu affero general public license,? version ([1-3](?:\.[01])?),? .*(?:19|20)[0-9]{2}"),
    ("GFDL-title", r"(?:.{0,40})?gnu free documentation license,? version ([1-3]\.[0-3]),? .*(?:19|20)[0-9]{2}"),
    ("GNU-verbatim", r"(?:.{0,120})?everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("GNU-preamble", r"(?:preamble )?the (?:gnu (?:affero )?general public license is a free, copyleft license for software and other kinds of works|licenses for most software are designed to take away your freedom to share and change it|license agreements of most software companies try to keep users at the mercy of those companies)"),
    ("GNU-supplement", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license, supplemented by the additional permissions listed below"),
    ("GNU-how-to-apply", r"(?:.*)?(?:it is safest to attach them to the start of each source file|to apply these terms, attach the following notices to the (?:library|program)).*"),
    ("GNU-sample", r"(?:.{0,10})?one line to give the (?:program|library)'?s name and (?:a brief idea|an idea) of what it does"),
    ("GPL-free-software-later", _GNU.format("") + _BY + r"[:;,]? (?:either )?version ([1-3](?:\.0)?)(?: of the license)?,? (?:or \(?at your option\)?|or),? any later version"),
    ("GPL-free-software-only", _GNU.format("") + r"(?:,? version ([1-3](?:\.0)?))?" + _BY + r"(?:[:;,]? version ([1-3](?:\.0)?)(?: of the license)?)?(?: only)?"),
    ("LGPL-free-software-later", _GNU.format("(?:lesser|library) ") + _BY + r"[:;,]? (?:either )?version ([1-3](?:\.[01])?)(?: of the license)?,? (?:or \(?at your option\)?|or),? any later version"),
    ("LGPL-free-software-only", _GNU.format("(?:lesser|library) ") + r"(?:,? version ([1-3](?:\.[01])?))?" + _BY + r"(?:[:;,]? version ([1-3](?:\.[01])?)(?: of the license)?)?(?: only)?"),
    ("AGPL-free-software-later", _GNU.format("affero ") + _BY + r"[:;,]? (?:either )?version ([1-3](?:\.0)?)(?: of the license)?,? (?:or \(?at your option\)?|or),? any later version"),
    ("AGPL-free-software-only", _GNU.format("affero ") + r"(?:,? version ([1-3](?:\.0)?))?" + _BY + r"(?:[:;,]? version ([1-3](?:\.0)?)(?: of the license)?)?(?: only)?"),
    ("GNU-hope", _THIS + r" is distributed in the hope that it will be useful" + _NO_WARRANTY),
    ("GNU-see", r"see the gnu (?:lesser |library |affero )?general public license for more details"),
    ("GNU-received", _COPYING.format("(?:lesser |library |affero )?")),
    ("GNU-if-not", r"if not,? (?:see|write to).*"),
    ("GFDL-grant", r"permission is granted to copy, distribute and ?/? ?(?:or)? modify this document under the terms of the gnu free documentation license, version ([1-3]\.[0-3]) or any later version published by the free software foundation.*"),
    # Mozilla, Eclipse and others of their kind
    ("MPL-subject", r"this source code form is subject to the terms of the mozilla public license, v\.? ?(2\.0)"),
    ("MPL-copy", r"if a copy of the mpl was not distributed with this file, you can obtain one at:? https?://(?:www\.)?mozilla\.org/mpl/2\.0/?"),
    ("MPL-incompatible", r"this source code form is incompatible with secondary licenses, as defined by the mozilla public license, v\.? ?2\.0"),
    ("MPL-title", r"mozilla public license,? version ([12]\.[01])(?: =+)?(?: .{0,20})?"),
    ("MPL-contents", r"the contents of this file are subject to the mozilla public license version (1\.[01]) the license"),
    ("MPL-distributed", r"software distributed under the license is distributed on an as[ -]is basis, without warranty of any kind, either express or implied"),
    ("MPL-see", r"see the license for the specific language governing rights and limitations under the license"),
    ("CDDL-contents", r"the contents of this file are subject to the terms of the common development and distribution license.*"),
    ("EPL-materials", r"(?:all rights reserved )?this program and the accompanying materials are made available under the terms of the eclipse public license,? v(?:ersion)? ?\.?([12]\.0),?(?: which (?:accompanies this distribution|is available at).*)?"),
    ("EPL-title", r"eclipse public license - v ([12]\.0)"),
    ("Artistic-title", r"(?:the )?artistic license(?: 2\.0)?"),
    ("Artistic-preamble", r"(?:preamble )?the intent of this document is to state the conditions under which a package may be copied.*"),
    ("Perl-terms", r"(?:this (?:program|library|module|package|software)|it) is free software[;,:]? you can redistribute it and ?/? ?(?:or)? modify it under the same terms as perl(?: 5)?(?: itself)?.*"),
    # Boost, zlib and short ones
    ("Boost-title", r"boost software license,? -? ?version 1\.0(?: -)?(?: august 17th, 2003)?"),
    ("Boost-grant", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software.*"),
    ("Boost-notice", r"the copyright notices in the software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the software.*"),
    ("Boost-no-liability", r"in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability.*"),
    ("Boost-copy", r"see accompanying file license_1_0\.txt or copy at:? https?://(?:www\.)?boost\.org/license_1_0\.txt"),
    ("Zlib-as-is", r"this software is provided as[ -]is,? without any express or implied warranty"),
    ("Zlib-no-liability", r"in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("Zlib-grant", r"permission is granted to anyone to use this software for any purpose,? including commercial applications,? and to alter it and redistribute it freely,? subject to the following restrictions:?"),
    ("Zlib-origin", r"the origin of this software must not be misrepresented.*"),
    ("Zlib-altered", r"altered source versions must be plainly marked as such.*"),
    ("Zlib-notice", r"this notice may not be removed or altered from any source distribution"),
    ("Unlicense-free", r"this is free and unencumbered software released into the public domain"),
    ("Unlicense-anyone", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("Unlicense-dedicate", r"in jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("WTFPL-title", r"do what the fuck you want to public license.*"),
    ("WTFPL-just", r"(?:0\. )?you just do what the fuck you want to"),
    ("Beerware", r".*as long as you retain this notice you can do whatever you want with this stuff"),
    ("PSF-title", r"(?:.{0,20})?python software foundation license version 2"),
    ("OFL-title", r"sil open font license,? version 1\.1(?: - 26 february 2007)?"),
    ("OFL-font", r"this font software is licensed under the sil open font license, version 1\.1"),
    ("NCSA-grant", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files the software, to deal with the software without restriction.*"),
    ("BUSL-title", r"business source license 1\.1"),
    ("SSPL-title", r"server side public license,? version 1,? .*"),
    # Creative Commons
    ("CC-title", r"(?:creative commons )?(?:legal code )?attribution(-noncommercial)?(-sharealike|-noderivatives)? ([1-4]\.[05]) international(?: public license)?"),
    ("CC-link", r"(?:.*\b)?(?:https?://)?(?:www\.)?creativecommons\.org/licenses/by((?:-nc)?(?:-sa|-nd)?)/([1-4]\.[05])(?:/.*)?"),
    ("CC0-title", r"(?:creative commons )?(?:legal code )?(?:creative commons )?(?:.{0,4})?cc0 1\.0 universal"),
    ("CC0-link", r"(?:.*\b)?(?:https?://)?(?:www\.)?creativecommons\.org/publicdomain/zero/1\.0(?:/.*)?"),
    ("CC0-waived", r"to the extent possible under law, .* has waived all copyright and related or neighboring rights to .*"),
    # no license at all
    ("public-domain", r"(?:.* )?(?:(?:is|are|released|placed|dedicated|donated|put) (?:hereby )?(?:in|into|to)|in) the public domain(?: .{0,80})?"),
    ("confidential", r"(?:.* )?(?:unauthorized copying of this file,? via any medium,? is strictly prohibited|proprietary and confidential|confidential and proprietary)(?: .{0,80})?"),
    ("copyright", r"(?:.{0,60} )?(?:copyright|©)(?: \(?c\)?| ©)? .{0,200}"),
    ("all-rights-reserved", r"(?:.* )?all rights reserved(?: worldwide)?"),
    # tags
    ("SPDX:{0}", r"(?:.{0,20})?spdx-license-identifier: ?([a-z0-9.+-]+(?: (?:and|or|with) [a-z0-9.+-]+)*)"),
]

_GPL = [(kind, when) for kind in ("", "L", "A") for when in ("later", "only")]
#: License by sequence of identifiers, in order of trial: long ones first. A license of "" uses up what belongs to another.
RULES: list[tuple[str, list[str]]] = [
    # how-to-apply notes at the end of a license's own text are no header
    *(("", ["GNU-how-to-apply", *sample, f"{kind}GPL-free-software-{when}", "GNU-hope", "GNU-see", "GNU-received"]) for kind, when in _GPL for sample in (["GNU-sample"], [])),
    ("", ["Apache-appendix", "Apache-{0}", "Apache-may-not-use", "Apache-obtain", "Apache-as-is", "Apache-see"]),
    # texts
    ("Apache-2.0", ["Apache-title", "Apache-terms", "Apache-grant", "Apache-patent", "Apache-redistribution", "Apache-end"]),
    ("Apache-2.0", ["Apache-title", "Apache-terms"]),
    ("LGPL-{0}", ["LGNU-title", "GNU-verbatim", "GNU-supplement"]),
    ("LGPL-{0}", ["LGNU-title", "GNU-verbatim"]),
    ("AGPL-{0}", ["AGNU-title", "GNU-verbatim"]),
    ("GFDL-{0}", ["GFDL-title", "GNU-verbatim", "GFDL-grant"]),
    ("GFDL-{0}", ["GFDL-title", "GNU-verbatim"]),
    ("GPL-{0}", ["GNU-title", "GNU-verbatim"]),
    ("BSD-4-Clause", ["BSD-redistribution", "BSD-source", "BSD-binary", "BSD-advertising", "BSD-acknowledgement", "BSD-endorse", "BSD-as-is"]),
    ("BSD-4-Clause", ["BSD-redistribution", "BSD-source", "BSD-binary", "BSD-advertising", "BSD-endorse", "BSD-as-is"]),
    ("BSD-3-Clause", ["BSD-redistribution", "BSD-source", "BSD-binary", "BSD-endorse", "BSD-as-is", "BSD-no-liability"]),
    ("BSD-3-Clause", ["BSD-redistribution", "BSD-source", "BSD-binary", "BSD-endorse", "BSD-as-is"]),
    ("BSD-3-Clause", ["BSD-redistribution", "BSD-source", "BSD-binary", "BSD-endorse"]),
    ("BSD-2-Clause", ["BSD-redistribution", "BSD-source", "BSD-binary", "BSD-as-is", "BSD-no-liability"]),
    ("BSD-2-Clause", ["BSD-redistribution", "BSD-source", "BSD-binary", "BSD-as-is"]),
    ("BSD-2-Clause", ["BSD-redistribution", "BSD-source", "BSD-binary"]),
    ("BSD-1-Clause", ["BSD-redistribution", "BSD-source", "BSD-as-is"]),
    ("JSON", ["MIT-grant", "MIT-notice", "MIT-good", "MIT-as-is", "MIT-no-liability"]),
    ("X11", ["MIT-grant", "MIT-notice", "MIT-as-is", "MIT-no-liability", "X11-name"]),
    ("MIT", ["MIT-title", "MIT-grant", "MIT-notice", "MIT-as-is", "MIT-no-liability"]),
    ("MIT", ["MIT-grant", "MIT-notice", "MIT-as-is", "MIT-no-liability"]),
    ("MIT", ["MIT-grant", "MIT-notice", "MIT-as-is"]),
    ("NCSA", ["NCSA-grant", "BSD-source", "BSD-binary", "BSD-endorse"]),
    ("BSL-1.0", ["Boost-title", "Boost-grant", "Boost-notice", "MIT-as-is", "Boost-no-liability"]),
    ("BSL-1.0", ["Boost-grant", "Boost-notice", "MIT-as-is", "Boost-no-liability"]),
    ("BSL-1.0", ["Boost-grant", "Boost-notice"]),
    ("ISC", ["ISC-title", "ISC-grant", "ISC-as-is", "ISC-no-liability"]),
    ("ISC", ["ISC-grant", "ISC-as-is", "ISC-no-liability"]),
    ("0BSD", ["0BSD-grant", "ISC-as-is", "ISC-no-liability"]),
    ("Zlib", ["Zlib-as-is", "Zlib-no-liability", "Zlib-grant", "Zlib-origin", "Zlib-altered", "Zlib-notice"]),
    ("Zlib", ["Zlib-as-is", "Zlib-no-liability", "Zlib-grant"]),
    ("Unlicense", ["Unlicense-free", "Unlicense-anyone", "Unlicense-dedicate", "MIT-as-is"]),
    ("WTFPL", ["WTFPL-title", "WTFPL-just"]),
    ("Artistic-1.0", ["Artistic-title", "Artistic-preamble", "public-domain"]),
    ("Artistic-1.0", ["Artistic-title", "Artistic-preamble"]),
    # headers
    ("Apache-2.0", ["Apache-contributors", "Apache-notice", "Apache-asf", "Apache-may-not-use", "Apache-obtain", "Apache-as-is", "Apache-see"]),
    ("Apache-{0}", ["Apache-{0}", "Apache-may-not-use", "Apache-obtain", "Apache-as-is", "Apache-see"]),
    ("Apache-{0}", ["Apache-{0}", "Apache-may-not-use", "Apache-obtain"]),
    *((f"{kind}GPL-{{0}}" + "+" * (when == "later"), [f"{kind}GPL-free-software-{when}", *rest]) for rest in (["GNU-hope", "GNU-see", "GNU-received", "GNU-if-not"], ["GNU-hope", "GNU-see", "GNU-received"], ["GNU-hope", "GNU-received", "GNU-if-not"], ["GNU-hope", "GNU-received"], ["GNU-hope", "GNU-see"], []) for kind, when in _GPL),
    ("GFDL-{0}+", ["GFDL-grant"]),
    ("MPL-2.0", ["MPL-subject", "MPL-copy"]),
    ("MPL-2.0", ["MPL-subject"]),
    ("MPL-{0}", ["MPL-contents", "Apache-may-not-use", "MPL-distributed", "MPL-see"]),
    ("MPL-{0}", ["MPL-contents"]),
    ("MPL-{0}", ["MPL-title"]),
    ("BSL-1.0", ["BSL-1.0", "Boost-copy"]),
    # one sentence each
    ("Apache-{0}", ["Apache-asf"]),
    ("MIT", ["MIT-grant"]),
    ("ISC", ["ISC-grant"]),
    ("0BSD", ["0BSD-grant"]),
    ("HPND", ["HPND-grant"]),
    ("CDDL-1.0", ["CDDL-contents"]),
    ("EPL-{0}", ["EPL-materials"]),
    ("EPL-{0}", ["EPL-title"]),
    ("Artistic-1.0-Perl", ["Perl-terms"]),
    ("Unlicense", ["Unlicense-free"]),
    ("WTFPL", ["WTFPL-title"]),
    ("Beerware", ["Beerware"]),
    ("PSF-2.0", ["PSF-title"]),
    ("OFL-1.1", ["OFL-font"]),
    ("OFL-1.1", ["OFL-title"]),
    ("BUSL-1.1", ["BUSL-title"]),
    ("SSPL-1.0", ["SSPL-title"]),
    ("CC0-1.0", ["CC0-title"]),
    ("CC0-1.0", ["CC0-link"]),
    ("CC0-1.0", ["CC0-waived"]),
    ("public-domain", ["public-domain"]),
    ("proprietary", ["confidential"]),
]
#: Reserving all rights is proprietary, but for the notice of copyright ahead of a license's text.
RESERVED = "all-rights-reserved"
#: Only the notice: no license, and not counted as unknown.
NOTICE = "copyright"
