"""Licence signatures, over texts of lower-case words with one space before and after each.

Fixed values: names, identifiers and notices of well-known licences. Rules over a whole family follow from FAMILIES by
the forms in ``rules``; NOTICES are written out.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    keyword: str
    regex: str
    priority: int


#: A text without any of these can match no rule.
GATES = (
    "licen", " under ", " cc by", " cc0", "creative commons", "creativecommons", "public domain", "copyright", "copyleft",
    "warranty", "permission", "redistribution", "endorse or promote", "advertising materials", "free software foundation",
    "any later version", "unencumbered", "eclipse org legal", "source code form", "confidential",
    "affero general public", "common development and distribution", "dealings in th",
)

#: (label, keyword, names as a regex, identifier as words)
FAMILIES = (
    ("mit", "mit", r"mit", "mit"),
    ("mit", "expat", r"expat", "mit"),
    ("mit-0", "mit", r"mit (?:no attribution|0)", "mit 0"),
    ("x11", "x11", r"x11", "x11"),
    ("isc", "isc", r"isc", "isc"),
    ("isc", "internet systems", r"internet systems consortium", "isc"),
    ("0bsd", "bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)", "0bsd"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|(?:bsd )?2 clause bsd|bsd 2 clause)", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:(?:new|modified|revised) bsd|3 clause bsd|bsd 3 clause)", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|4 clause bsd|bsd 4 clause)", "bsd 4 clause"),
    ("bsd", "bsd", r"bsd(?: style)?", "bsd"),
    ("apache-1.1", "apache", r"apache(?: software)? license(?: version)? v?1 1", "apache 1 1"),
    ("apache-2.0", "apache", r"apache(?: software)? license(?: version)? v?2(?: 0)?", "apache 2 0"),
    ("apache", "apache", r"apache(?: software)?", "apache"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public license(?: version)? v?1(?: 0)?", "gpl 1 0"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public license(?: version)? v?2(?: 0)?", "gpl 2 0"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public license(?: version)? v?3(?: 0)?", "gpl 3 0"),
    ("gpl-2.0", "gpl", r"gpl ?v? ?2(?: 0)?", "gpl 2 0 only"),
    ("gpl-3.0", "gpl", r"gpl ?v? ?3(?: 0)?", "gpl 3 0 only"),
    ("gpl-2.0-or-later", "gpl", r"gpl ?v? ?2(?: 0)? or (?:any )?later", "gpl 2 0 or later"),
    ("gpl-3.0-or-later", "gpl", r"gpl ?v? ?3(?: 0)? or (?:any )?later", "gpl 3 0 or later"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public license(?: version)? v?2 1", "lgpl 2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public license(?: version)? v?3(?: 0)?", "lgpl 3 0"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public", "lgpl"),
    ("lgpl-2.0", "library general", r"(?:gnu )?library general public", "lgpl 2 0"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public(?: license(?: version)? v?3(?: 0)?)?", "agpl 3 0"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation", "gfdl 1 3"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version)? v?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: version)? v?2(?: 0)?", "mpl 2 0"),
    ("mpl", "mozilla", r"mozilla public", "mpl"),
    ("epl-1.0", "eclipse", r"eclipse public license(?: version)? v?1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: version)? v?2(?: 0)?", "epl 2 0"),
    ("epl", "eclipse", r"eclipse public", "epl"),
    ("edl-1.0", "eclipse", r"eclipse distribution", "bsd 3 clause eclipse"),
    ("cddl-1.0", "common development", r"common development and distribution(?: license(?: version)? v?1 0)?", "cddl 1 0"),
    ("cpl-1.0", "common public", r"common public", "cpl 1 0"),
    ("cpal-1.0", "common public attribution", r"common public attribution", "cpal 1 0"),
    ("ipl-1.0", "ibm", r"ibm public", "ipl 1 0"),
    ("eupl-1.2", "european union", r"european union public", "eupl 1 2"),
    ("osl-3.0", "open software", r"open software", "osl 3 0"),
    ("afl-3.0", "academic free", r"academic free", "afl 3 0"),
    ("artistic-1.0", "artistic", r"artistic license(?: version)? v?1(?: 0)?", "artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic license(?: version)? v?2(?: 0)?", "artistic 2 0"),
    ("artistic", "artistic", r"artistic", "artistic"),
    ("bsl-1.0", "boost", r"boost software", "bsl 1 0"),
    ("busl-1.1", "business source", r"business source", "busl 1 1"),
    ("zlib", "zlib", r"(?:zlib|zlib libpng)", "zlib"),
    ("libpng", "png", r"(?:libpng|png reference library)", "libpng 2 0"),
    ("unlicense", "unlicense", r"unlicense", "unlicense"),
    ("wtfpl", "wtf", r"wtfpl", "wtfpl"),
    ("wtfpl", "do what the f", r"do what the f\w+ you want to public", "wtfpl"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-4.0", "cc by", r"cc by 4 0", "cc by 4 0"),
    ("cc-by-3.0", "cc by", r"cc by 3 0", "cc by 3 0"),
    ("cc-by-sa-4.0", "cc by sa", r"cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-sa-3.0", "cc by sa", r"cc by sa 3 0", "cc by sa 3 0"),
    ("cc-by-nc-4.0", "cc by nc", r"cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nc-3.0", "cc by nc", r"cc by nc 3 0", "cc by nc 3 0"),
    ("cc-by-nc-sa-4.0", "cc by nc sa", r"cc by nc sa 4 0", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "cc by nc nd", r"cc by nc nd 4 0", "cc by nc nd 4 0"),
    ("cc-by-nd-4.0", "cc by nd", r"cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by", "creative commons", r"creative commons attribution(?: \d \d)?(?: international)?", "cc by"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: \d \d)?", "cc by sa"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: \d \d)?", "cc by nc"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv\w+(?: \d \d)?", "cc by nd"),
    ("odbl-1.0", "open database", r"open database", "odbl 1 0"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution", "odc by 1 0"),
    ("pddl-1.0", "public domain dedication", r"public domain dedication", "pddl 1 0"),
    ("psf-2.0", "python", r"python software foundation", "psf 2 0"),
    ("python-2.0", "python", r"python license(?: version)? 2", "python 2 0"),
    ("ruby", "ruby", r"ruby", "ruby"),
    ("php-3.0", "php", r"php", "php 3 01"),
    ("openssl", "openssl", r"openssl", "openssl"),
    ("ssleay", "ssleay", r"(?:original )?ssleay", "ssleay"),
    ("postgresql", "postgresql", r"postgresql", "postgresql"),
    ("curl", "curl", r"curl", "curl"),
    ("ncsa", "ncsa", r"(?:university of illinois )?(?:ncsa|open source ncsa)", "ncsa"),
    ("w3c", "w3c", r"w3c software(?: notice)?", "w3c"),
    ("ofl-1.1", "open font", r"(?:sil )?open font", "ofl 1 1"),
    ("upl-1.0", "universal permissive", r"universal permissive", "upl 1 0"),
    ("ms-pl", "microsoft", r"microsoft public", "ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal", "ms rl"),
    ("sspl-1.0", "server side", r"server side public", "sspl 1 0"),
    ("elastic-2.0", "elastic", r"elastic license(?: version)? v?2(?: 0)?", "elastic 2 0"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield)", "polyform noncommercial 1 0 0"),
    ("mulan-2.0", "mulan", r"mulan (?:psl|permissive software)(?: v2)?", "mulanpsl 2 0"),
    ("openrail", "openrail", r"(?:creative ml |bigcode )?openrail(?: m)?", "openrail"),
    ("vim", "vim", r"vim", "vim"),
    ("naist", "naist", r"naist", "naist 2003"),
    ("unicode", "unicode", r"unicode(?: inc)?(?: data files and software)?", "unicode dfs 2016"),
)

#: (label, keyword, regex): sentences of licence texts.
NOTICES = (
    ("mit", "free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote", r"neither the name of .{1,120}? may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "in compliance with the license", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache org licenses", r"(?:http|https) www apache org licenses license 2 0(?: \w+)?"),
    ("gpl", "free software foundation", r"under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0-or-later", "any later version", r"either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "any later version", r"either version 3 of the license or at your option any later version"),
    ("mpl-2.0", "mozilla public", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2.0", "eclipse org legal", r"(?:http|https) www eclipse org legal epl 2 0"),
    ("bsl-1.0", "boost org", r"(?:http|https) www boost org license 1 0 txt"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("zlib", "provided as is without", r"this software is provided as is without any express or implied warranty"),
    ("cc", "creativecommons", r"(?:http|https)? ?creativecommons org (?:licenses|publicdomain) [a-z ]{1,12}\d \d"),
    ("proprietary", "all rights reserved", r"copyright .{1,80}? all rights reserved"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("no-warranty", "warranty", r"without warranty of any kind"),
    ("copyleft", "copyleft", r"copyleft"),
    ("mit", "without restriction", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "dealings in the software", r"arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "as is without warranty", r"the software is provided as is without warranty of any kind express or implied"),
    ("x11", "shall not be used in advertising", r"except as contained in this notice the name of .{1,80}? shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written (?:authorization|permission)"),
    ("isc", "with or without fee is hereby granted", r"for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "must retain the above copyright", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "must reproduce the above copyright", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd", "copyright holders and contributors as is", r"this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd", "or contributors be liable", r"in no event shall the copyright (?:holder|owner) or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd-3-clause", "names of its contributors", r"nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2.0", "apache license version 2 0 january 2004", r"apache license version 2 0 january 2004"),
    ("apache-2.0", "governing permissions and limitations", r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "without warranties or conditions of any kind", r"distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", "one or more contributor license agreements", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "terms and conditions for use reproduction", r"terms and conditions for use reproduction and distribution 1 definitions license shall mean"),
    ("apache-2.0", "grant of patent license", r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual"),
    ("apache-2.0", "limitations under the license", r"language governing permissions and limitations under the license"),
    ("apache-1.1", "apache software foundation http", r"this product includes software developed by the apache software foundation http(?:s)? www apache org under"),
    ("gpl", "redistribute it and or modify it under", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "copy of the gnu general public license", r"you should have received a copy of the gnu general public license along with"),
    ("gpl", "gnu general public license for more details", r"see the gnu general public license for more details"),
    ("gpl", "merchantability or fitness for a particular purpose see the gnu", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl-2.0", "gnu general public license version 2 june 1991", r"gnu general public license version 2 june 1991"),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007", r"gnu general public license version 3 29 june 2007"),
    ("gpl-2.0", "version 2 as published by the free software foundation", r"gnu general public license version 2 as published by the free software foundation"),
    ("gpl-2.0", "version 2 of the license as published", r"version 2 of the license as published by the free software foundation"),
    ("gpl-3.0", "version 3 of the license as published", r"version 3 of the license as published by the free software foundation"),
    ("gpl-3.0", "version 3 as published by the free software foundation", r"gnu general public license version 3 as published by the free software foundation"),
    ("gpl-2.0-or-later", "59 temple place", r"free software foundation inc 59 temple place(?: suite 330)? boston ma"),
    ("gpl-2.0-or-later", "51 franklin", r"free software foundation inc 51 franklin (?:street|st) fifth floor boston ma"),
    ("gpl", "licenses for most software", r"the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change"),
    ("gpl-exception", "as a special exception", r"as a special exception .{1,120}? permission to link"),
    ("lgpl", "gnu lesser general public license as published", r"under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "copy of the gnu lesser general public license", r"you should have received a copy of the gnu lesser general public license"),
    ("lgpl", "gnu lesser general public license for more details", r"see the gnu lesser general public license for more details"),
    ("lgpl-2.1-or-later", "either version 2 1 of the license", r"either version 2 1 of the license or at your option any later version"),
    ("lgpl-2.0-or-later", "gnu library general public license as published", r"under the terms of the gnu library general public license as published by the free software foundation"),
    ("lgpl-2.1", "version 2 1 february 1999", r"gnu lesser general public license version 2 1 february 1999"),
    ("agpl-3.0-or-later", "gnu affero general public license as published", r"under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl-3.0", "version 3 19 november 2007", r"gnu affero general public license version 3 19 november 2007"),
    ("agpl-3.0", "copy of the gnu affero general public license", r"you should have received a copy of the gnu affero general public license"),
    ("gfdl", "gnu free documentation license version", r"under the terms of the gnu free documentation license version 1 [123]"),
    ("mpl-1.1", "contents of this file are subject to the mozilla public license", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.1", "software distributed under the license is distributed on an as is basis without warranty", r"software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied"),
    ("mpl-tri-license", "the gnu general public license version 2 or later the gpl", r"alternatively the contents of this file may be used under the terms of either the gnu general public license version 2 or later the gpl"),
    ("epl-1.0", "terms of the eclipse public license v1 0", r"under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "terms of the eclipse public license 2 0", r"under the terms of the eclipse public license 2 0"),
    ("epl-1.0", "eclipse org legal epl v10", r"(?:http|https) www eclipse org legal epl v10"),
    ("cddl-1.0", "common development and distribution license", r"the contents of this file are subject to the terms of (?:either )?the common development and distribution license"),
    ("cpl-1.0", "common public license v1 0", r"under the terms of the common public license v1 0"),
    ("cpal-1.0", "common public attribution license version 1 0", r"contents of this file are subject to the common public attribution license version 1 0"),
    ("apsl-2.0", "apple public source license", r"subject to the apple public source license version 2 0"),
    ("qpl-1.0", "q public license", r"under the terms of the q public license(?: as defined by trolltech as)?"),
    ("artistic-2.0", "terms of the artistic license", r"under the terms of the artistic license(?: version)? 2 0"),
    ("artistic", "same terms as perl itself", r"(?:redistribute it and or modify it )?under the same terms as perl itself"),
    ("bsl-1.0", "distributed under the boost software license", r"distributed under the boost software license version 1 0"),
    ("zlib", "freely subject to the following restrictions", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("libpng", "png reference library", r"permission is hereby granted to use copy modify and distribute this png reference library"),
    ("unlicense", "in jurisdictions that recognize copyright laws", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("unlicense", "unlicense org", r"for more information please refer to (?:http|https) unlicense org"),
    ("cc0-1.0", "to the extent possible under law", r"to the extent possible under law .{1,120}? waived all copyright and related or neighbo(?:u)?ring rights"),
    ("cc0-1.0", "cc0 1 0 universal", r"creative commons legal code cc0 1 0 universal"),
    ("cc0-1.0", "publicdomain zero 1 0", r"(?:http|https) creativecommons org publicdomain zero 1 0"),
    ("cc-by-4.0", "attribution 4 0 international", r"creative commons attribution 4 0 international"),
    ("cc-by-3.0", "attribution 3 0 unported", r"creative commons attribution 3 0 unported"),
    ("cc-by-sa-4.0", "sharealike 4 0 international", r"creative commons attribution sharealike 4 0 international"),
    ("cc-by-sa-3.0", "attribution sharealike 3 0 unported", r"creative commons attribution sharealike 3 0 unported"),
    ("cc-by-nc-4.0", "noncommercial 4 0 international", r"creative commons attribution noncommercial 4 0 international"),
    ("cc-by-nc-sa-4.0", "noncommercial sharealike 4 0 international", r"creative commons attribution noncommercial sharealike 4 0 international"),
    ("cc-by-nc-nd-4.0", "noncommercial noderivatives 4 0 international", r"creative commons attribution noncommercial noderivatives 4 0 international"),
    ("cc-by-nd-4.0", "attribution noderivatives 4 0 international", r"creative commons attribution noderivatives 4 0 international"),
    ("cc-by-4.0", "creativecommons org licenses by 4 0", r"(?:http|https) creativecommons org licenses by 4 0"),
    ("cc-by-sa-4.0", "creativecommons org licenses by sa 4 0", r"(?:http|https) creativecommons org licenses by sa 4 0"),
    ("cc-by-nc-4.0", "creativecommons org licenses by nc 4 0", r"(?:http|https) creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-sa-4.0", "creativecommons org licenses by nc sa 4 0", r"(?:http|https) creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creativecommons org licenses by nc nd 4 0", r"(?:http|https) creativecommons org licenses by nc nd 4 0"),
    ("odbl-1.0", "made available under the open database license", r"(?:is )?made available under the open database license"),
    ("odc-by-1.0", "open data commons attribution license", r"made available under the open data commons attribution license"),
    ("psf-2.0", "psf license agreement for python", r"psf license agreement for python(?: \d)*"),
    ("psf-2.0", "python software foundation license version 2", r"python software foundation license version 2"),
    ("php-3.0", "subject to version 3 0", r"this source file is subject to version 3 01? of the php license"),
    ("ruby", "gpl see the file gpl or the conditions below", r"under the terms of the gpl see the file gpl or the conditions below"),
    ("postgresql", "for any purpose without fee and without a written agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("curl", "shall not be used in advertising or otherwise to promote", r"the name of a copyright holder shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("ncsa", "to deal with the software without restriction", r"permission is hereby granted free of charge .{1,160}? to deal with the software without restriction"),
    ("w3c", "w3c software notice and license", r"w3c software notice and license"),
    ("ofl-1.1", "sil open font license", r"this font software is licensed under the sil open font license version 1 1"),
    ("upl-1.0", "universal permissive license", r"the universal permissive license upl version 1 0"),
    ("ms-pl", "governs use of the accompanying software", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("sspl-1.0", "server side public license", r"under the terms of the server side public license version 1 as published by mongodb"),
    ("busl-1.1", "use of this software is governed by the business source license", r"use of this software is governed by the business source license"),
    ("busl-1.1", "change license", r"change date .{1,60}? change license"),
    ("elastic-2.0", "elastic license 2 0", r"licensed under the elastic license 2 0"),
    ("commons-clause", "commons clause", r"commons clause license condition(?: v1 0)?"),
    ("polyform", "polyform noncommercial license", r"polyform noncommercial license 1 0 0"),
    ("openrail", "responsible ai license", r"(?:open )?responsible ai license(?:s)?"),
    ("unicode", "unicode inc license agreement", r"unicode inc license agreement data files and software"),
    ("beerware", "beer ware license", r"the beer ware license(?: revision 42)?"),
    ("dual-license", "dual licensed", r"(?:is )?dual licensed(?: under)?"),
    ("dual-license", "at your option", r"licensed under either of .{1,60}? at your option"),
    ("public-domain", "has been placed in the public domain", r"(?:this (?:file|work|code) )?has been placed in the public domain"),
    ("public-domain", "public domain mark", r"public domain mark(?: 1 0)?"),
    ("public-domain-us-government", "work of the u s government", r"(?:is a )?work of the u s government .{1,80}? public domain"),
    ("proprietary", "may not be reproduced", r"may not be reproduced .{1,80}? without (?:the )?(?:prior |express )?(?:written )?permission"),
    ("proprietary", "trade secret", r"(?:contains )?trade secrets? .{1,60}? confidential"),
    ("evaluation", "evaluation purposes only", r"licensed for evaluation purposes only"),
    ("non-commercial", "non commercial use only", r"licensed for non commercial use only"),
    ("research-only", "research purposes only", r"licensed for research purposes only"),
    ("eula", "end user license agreement", r"end user license agreement"),
    ("copyright", "copyright c", r"copyright c (?:19|20)\d\d"),
)

#: The contract's phrases; they count wherever their words stand and are never suppressed.
BASE = (
    ("mit", "mit license", r"mit license", 0),
    ("apache", "apache license", r"apache license", 0),
    ("gpl", "general public license", r"general public license", 0),
)
#: A detection's confidence by priority: base phrase, identifier or notice, licensing clause, name.
CONFIDENCE = (0.9, 1.0, 0.9, 0.7)


def rules() -> list[Rule]:
    """All rules, better priorities first. A family gives an identifier tag, two clauses and its bare name."""
    clause = r"(?:licen[cs]ed|released|distributed|published|available|provided|made available)(?: \w+)? under(?: the)?(?: terms of)?(?: the)?"
    out = [Rule(label, keyword, regex, 1) for label, keyword, regex in NOTICES]
    for label, keyword, name, tag in FAMILIES:
        suffix = "(?: licen[cs]es?)?"
        out += [
            Rule(label, "spdx", f"spdx licen[cs]e identifier {tag}", 1),
            Rule(label, keyword, f"{clause} {name}{suffix}", 2),
            Rule(label, keyword, f"licen[cs]e (?:is )?(?:the )?{name}{suffix}", 2),
            Rule(label, keyword, f"{name} licen[cs]es?" if "licen" not in name and "cc" not in label else name, 3),
        ]
    return sorted(out, key=lambda r: r.priority)
