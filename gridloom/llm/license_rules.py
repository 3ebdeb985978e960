"""Signature rules for licences, over texts reduced to lower-case words parted by single spaces.

A family has a label, a pattern of its names, and a pattern of its short identifiers. Each family's names and
identifiers are set into the same templates, from the most explicit notice to a bare mention; sentences that only one
licence has are rules of their own. More explicit rules have higher priority. Patterns match whole words.

Keywords and gate are derived from the patterns: all texts that a pattern can match are written out (in ``phrases``),
and words are chosen until each of these texts holds one of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from functools import cache
from typing import NamedTuple


class Rule(NamedTuple):
    number: int
    priority: int
    label: str
    keywords: tuple[str, ...]  # every match, with the spaces around it, holds one of them
    pattern: str
    confidence: float
    phrases: tuple[str, ...]  # every match, with the spaces around it, holds one of them


#: label, names, identifiers
FAMILIES = (
    ("mit", "(?:mit|expat|x11)(?: style| open source)? licen[cs]e", "mit"),
    ("mit-0", "mit no attribution(?: licen[cs]e)?", "mit 0"),
    ("apache-2", "apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?", "apache 2(?: 0)?"),
    ("apache-1.1", "apache(?: software)? licen[cs]e(?: version| v)? ?1 1", "apache 1 1"),
    ("apache-1.0", "apache(?: software)? licen[cs]e(?: version| v)? ?1 0", "apache 1 0"),
    ("bsd-2-clause", "(?:simplified bsd|freebsd|(?:2|two) clause bsd|bsd (?:2|two) clause) licen[cs]e", "bsd 2 clause"),
    ("bsd-3-clause", "(?:(?:new|modified|revised) bsd|(?:3|three) clause bsd|bsd (?:3|three) clause) licen[cs]e", "bsd 3 clause"),
    ("bsd-4-clause", "(?:original bsd|(?:4|four) clause bsd|bsd (?:4|four) clause) licen[cs]e", "bsd 4 clause"),
    ("0bsd", "(?:zero clause bsd|bsd zero clause) licen[cs]e", "0bsd"),
    ("bsd", "bsd(?: style)? licen[cs]e", "bsd"),
    ("gpl-1.0", "(?:gnu )?(?:general public licen[cs]e|gpl)(?: version| v) ?1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "(?:gnu )?(?:general public licen[cs]e|gpl)(?: version| v) ?2(?: 0)?", "gpl 2 0(?: only| or later)?|gplv2"),
    ("gpl-3.0", "(?:gnu )?(?:general public licen[cs]e|gpl)(?: version| v) ?3(?: 0)?", "gpl 3 0(?: only| or later)?|gplv3"),
    ("gpl", "gnu (?:general public licen[cs]e|gpl)", "gpl"),
    ("lgpl-2.0", "(?:gnu )?(?:library general public licen[cs]e|lgpl)(?: version| v) ?2(?: 0)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "(?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version| v) ?2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "(?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version| v) ?3(?: 0)?", "lgpl 3 0(?: only| or later)?|lgplv3"),
    ("lgpl", "gnu (?:(?:lesser|library) general public licen[cs]e|lgpl)", "lgpl"),
    ("agpl-3.0", "(?:gnu )?(?:affero general public licen[cs]e|agpl)(?: version| v) ?3(?: 0)?", "agpl 3 0(?: only| or later)?|agplv3"),
    ("agpl", "(?:gnu )?affero general public licen[cs]e", "agpl"),
    ("gfdl", "gnu free documentation licen[cs]e", "gfdl 1 [123](?: only| or later)?"),
    ("mpl-1.1", "(?:mozilla public licen[cs]e|mpl)(?: version| v) ?1 1", "mpl 1 1"),
    ("mpl-2.0", "(?:mozilla public licen[cs]e|mpl)(?: version| v) ?2 0", "mpl 2 0"),
    ("mpl", "mozilla public licen[cs]e", "mpl"),
    ("epl-1.0", "(?:eclipse public licen[cs]e|epl)(?: version| v) ?1 0", "epl 1 0"),
    ("epl-2.0", "(?:eclipse public licen[cs]e|epl)(?: version| v) ?2 0", "epl 2 0"),
    ("eupl-1.2", "(?:european union public licen[cs]e|eupl)(?: version| v) ?1 2", "eupl 1 2"),
    ("cddl-1.0", "(?:common development and distribution licen[cs]e|cddl)(?: version| v) ?1 0", "cddl 1 0"),
    ("cpl-1.0", "common public licen[cs]e(?: version| v)? ?1 0", "cpl 1 0"),
    ("ms-pl", "(?:microsoft|ms) public licen[cs]e", "ms pl"),
    ("ms-rl", "(?:microsoft|ms) reciprocal licen[cs]e", "ms rl"),
    ("isc", "isc licen[cs]e", "isc"),
    ("zlib", "zlib(?: libpng)? licen[cs]e", "zlib"),
    ("bsl-1.0", "boost software licen[cs]e(?: version 1 0| 1 0)?", "bsl 1 0"),
    ("artistic-1.0", "artistic licen[cs]e(?: version)? 1 0", "artistic 1 0"),
    ("artistic-2.0", "artistic licen[cs]e(?: version)? 2 0", "artistic 2 0"),
    ("python-2.0", "python software foundation licen[cs]e(?: version 2)?", "(?:python|psf) 2 0"),
    ("postgresql", "postgresql licen[cs]e", "postgresql"),
    ("openssl", "openssl licen[cs]e", "openssl"),
    ("unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "(?:do what the fuck you want to public licen[cs]e|wtfpl)", "wtfpl"),
    ("ofl-1.1", "sil open font licen[cs]e(?: version 1 1| 1 1)?", "ofl 1 1"),
    ("odbl-1.0", "open (?:data commons open )?database licen[cs]e", "odbl 1 0"),
    ("cc0-1.0", "(?:cc0(?: 1 0)?(?: universal)?|creative commons zero)(?: licen[cs]e)?", "cc0 1 0"),
    ("cc-by-4.0", "(?:cc by|creative commons attribution)(?: licen[cs]e)? 4 0(?: international)?", "cc by 4 0"),
    ("cc-by-3.0", "(?:cc by|creative commons attribution)(?: licen[cs]e)? 3 0(?: unported)?", "cc by 3 0"),
    ("cc-by", "creative commons attribution licen[cs]e", "cc by"),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)(?: licen[cs]e)?(?: [234] [05])?", "cc by sa [234] [05]"),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: licen[cs]e)?(?: [234] [05])?", "cc by nd [234] [05]"),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)(?: licen[cs]e)?(?: [234] [05])?", "cc by nc [234] [05]"),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: licen[cs]e)?(?: [234] [05])?", "cc by nc sa [234] [05]"),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: licen[cs]e)?(?: [234] [05])?", "cc by nc nd [234] [05]"),
)

#: priority, text around a family's names (N) or identifiers (I), confidence
TEMPLATES = (
    (5, "spdx license identifier I", 0.99),
    (4, "(?:licensed|released|distributed|published|available|provided|covered) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?N", 0.95),
    (4, "(?:licen[cs]ed|released) (?:to you )?under (?:the )?I(?: licen[cs]e)?", 0.9),
    (3, "(?:subject to|governed by|according to|in accordance with) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?N", 0.9),
    (3, "licen[cs]e I", 0.8),
    (2, "under (?:the )?(?:terms of (?:the )?)?N", 0.85),
    (1, "N", 0.7),
)

#: Sentences of one licence, or of one kind of notice: label, pattern, confidence; priority 6.
SENTENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.99),
    ("mit", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software", 0.97),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise", 0.9),
    ("mit", "(?:use of this source code is|this source code is|this code is) (?:governed by|licensed under|released under) (?:an|the) mit(?: style)? licen[cs]e", 0.95),
    ("mit", "opensource org licenses mit", 0.95),
    ("mit", "dual licensed under (?:the )?mit (?:and|or) gpl", 0.85),
    ("mit-0", "opensource org licenses mit 0", 0.95),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.99),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", 0.95),
    ("isc", "opensource org licenses isc", 0.95),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", 0.97),
    ("hpnd", "(?:not be used in advertising or publicity pertaining to distribution of the software|used in advertising or publicity pertaining to distribution) without specific written prior permission", 0.9),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 0.98),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that", 0.95),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.95),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 0.95),
    ("bsd", "use of this source code is governed by a bsd style licen[cs]e that can be found in the license file", 0.97),
    ("bsd-2-clause", "opensource org licenses bsd 2 clause", 0.95),
    ("bsd-2-clause", "the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies", 0.9),
    ("bsd-3-clause", "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products", 0.97),
    ("bsd-3-clause", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission", 0.95),
    ("bsd-3-clause", "opensource org licenses bsd 3 clause", 0.95),
    ("bsd-3-clause-clear", "no express or implied licenses to any party s patent rights are granted by this license", 0.97),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", 0.97),
    ("bsd-4-clause", "this product includes software developed by the university of california berkeley and its contributors", 0.95),
    ("gpl-1.0", "gnu general public license as published by the free software foundation either version 1", 0.98),
    ("gpl-2.0", "gnu general public license as published by the free software foundation either version 2", 0.98),
    ("gpl-2.0", "gnu general public license version 2 (?:only )?as published by the free software foundation", 0.98),
    ("gpl-2.0", "gnu org licenses (?:old licenses )?gpl 2 0", 0.95),
    ("gpl-2.0", "(?:under|of) (?:the terms of )?version 2 of the gnu general public licen[cs]e", 0.97),
    ("gpl-3.0", "gnu general public license as published by the free software foundation either version 3", 0.98),
    ("gpl-3.0", "gnu general public license version 3 (?:only )?as published by the free software foundation", 0.98),
    ("gpl-3.0", "gnu org licenses gpl 3 0", 0.95),
    ("gpl-3.0", "(?:under|of) (?:the terms of )?version 3 of the gnu general public licen[cs]e", 0.97),
    ("gpl", "you should have received a copy of the gnu general public license along with this (?:program|software|library|file|package)", 0.95),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.95),
    ("gpl", "see the gnu general public license for more details", 0.9),
    ("gpl-classpath-exception", "linking this library statically or dynamically with other modules is making a combined work based on this library", 0.97),
    ("gpl-classpath-exception", "gnu general public license (?:version 2 )?with (?:the )?(?:gnu )?classpath exception", 0.97),
    ("gpl-bison-exception", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton", 0.97),
    ("gpl-gcc-exception", "gcc runtime library exception", 0.95),
    ("gpl-font-exception", "as a special exception if you create a document which uses this font and embed this font", 0.97),
    ("gpl-autoconf-exception", "as a special exception (?:to the gnu general public license )?if you distribute this file as part of a program that contains a configuration script generated by autoconf", 0.97),
    ("gpl-linux-syscall", "this copyright does not cover user programs that use kernel services by normal system calls", 0.97),
    ("lgpl-2.0", "gnu library general public license as published by the free software foundation either version 2", 0.98),
    ("lgpl-2.1", "gnu lesser general public license as published by the free software foundation either version 2 1", 0.98),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 (?:only )?as published by the free software foundation", 0.98),
    ("lgpl-2.1", "gnu org licenses (?:old licenses )?lgpl 2 1", 0.95),
    ("lgpl-3.0", "gnu lesser general public license as published by the free software foundation either version 3", 0.98),
    ("lgpl-3.0", "gnu lesser general public license version 3 (?:only )?as published by the free software foundation", 0.98),
    ("lgpl-3.0", "gnu org licenses lgpl 3 0", 0.95),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|software|library|file|package)", 0.95),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 0.95),
    ("agpl-3.0", "gnu affero general public license as published by the free software foundation either version 3", 0.98),
    ("agpl-3.0", "gnu org licenses agpl 3 0", 0.95),
    ("agpl-3.0", "you should have received a copy of the gnu affero general public license along with this (?:program|software|library)", 0.95),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 0.99),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts", 0.95),
    ("fsf-unlimited", "the free software foundation gives unlimited permission to copy and or distribute it with or without modifications as long as this notice is preserved", 0.97),
    ("fsf-all-permissive", "copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved", 0.98),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", 0.99),
    ("apache-2", "http(?:s)? www apache org licenses license 2 0", 0.9),
    ("apache-2", "licensed to the apache software foundation asf under one or more contributor license agreements", 0.98),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.9),
    ("apache-2", "the asf licenses this file to you under the apache license version 2 0", 0.99),
    ("apache-2", "opensource org licenses apache 2 0", 0.95),
    ("apache-1.1", "this product includes software developed by the apache software foundation", 0.9),
    ("apache-1.1", "products derived from this software may not be called apache nor may apache appear in their name", 0.95),
    ("apache-2-llvm-exception", "apache license v2 0 with llvm exceptions", 0.98),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", 0.99),
    ("mpl-1.1", "mozilla org mpl mpl 1 1", 0.95),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.99),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", 0.97),
    ("mpl-2.0", "mozilla org mpl 2 0", 0.95),
    ("npl-1.1", "the contents of this file are subject to the netscape public license", 0.97),
    ("epl-1.0", "eclipse org legal epl v10", 0.95),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", 0.99),
    ("epl-2.0", "eclipse org legal epl (?:2 0|v20)", 0.95),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0", 0.99),
    ("edl-1.0", "eclipse distribution license (?:v )?1 0", 0.95),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", 0.98),
    ("cddl-1.1", "common development and distribution license (?:version )?1 1", 0.95),
    ("cpl-1.0", "this program and the accompanying materials are made available under the terms of the common public license v1 0", 0.99),
    ("ipl-1.0", "ibm public license (?:version )?1 0", 0.95),
    ("apsl-2.0", "apple public source license (?:version )?2 0", 0.95),
    ("apsl-2.0", "this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license", 0.97),
    ("afl-3.0", "academic free license (?:version |v )?3 0", 0.95),
    ("afl-2.1", "academic free license (?:version |v )?2 1", 0.95),
    ("osl-3.0", "open software license (?:version |v )?3 0", 0.95),
    ("eupl-1.1", "european union public licen[cs]e (?:version |v )?1 1", 0.95),
    ("eupl-1.2", "licensed under the eupl(?: version 1 2)? or as soon they will be approved by the european commission", 0.97),
    ("cecill-2.1", "cecill (?:version |v )?2 1", 0.9),
    ("cecill", "this software is governed by the cecill(?: b| c)? license under french law and abiding by the rules of distribution of free software", 0.98),
    ("ecl-2.0", "educational community license (?:version |v )?2 0", 0.95),
    ("upl-1.0", "universal permissive license (?:version |v )?1 0", 0.95),
    ("ncsa", "university of illinois ncsa open source licen[cs]e", 0.97),
    ("w3c", "w3c software (?:notice and license|and document (?:notice and )?license)", 0.95),
    ("vim", "vim is charityware", 0.95),
    ("php-3.01", "this source file is subject to version 3 01 of the php license", 0.99),
    ("php-3.01", "php license (?:version |v )?3 01", 0.95),
    ("ruby", "(?:same terms as ruby|ruby s licen[cs]e|ruby licen[cs]e)", 0.85),
    ("perl", "(?:under the same terms as perl itself|same terms as the perl 5 programming language system itself)", 0.95),
    ("tcl", "this software is copyrighted by the regents of the university of california sun microsystems inc scriptics corporation", 0.97),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 0.98),
    ("ssleay", "this product includes cryptographic software written by eric young", 0.98),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 0.9),
    ("libpng", "this code is released under the libpng licen[cs]e", 0.97),
    ("ijg", "this software is based in part on the work of the independent jpeg group", 0.98),
    ("freetype", "portions of this software are copyright (?:[^ ]+ ){0,4}the freetype project", 0.95),
    ("freetype", "freetype (?:project )?licen[cs]e", 0.9),
    ("unicode", "unicode inc licen[cs]e agreement data files and software", 0.97),
    ("sqlite-blessing", "may you do good and not evil may you find forgiveness for yourself and forgive others", 0.98),
    ("json", "the software shall be used for good not evil", 0.98),
    ("beerware", "the beer ware licen[cs]e", 0.97),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer in return", 0.98),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 0.98),
    ("python-2.0", "psf license agreement for python", 0.95),
    ("artistic-2.0", "this (?:package|program|library) is free software you can redistribute it and or modify it under the terms of the artistic license 2 0", 0.98),
    ("bsl-1.0", "boost org license 1 0 txt", 0.95),
    ("bsl-1.0", "distributed under the boost software license version 1 0", 0.98),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", 0.9),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 0.97),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0.97),
    ("unlicense", "this is free and unencumbered software released into the public domain", 0.99),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", 0.97),
    ("unlicense", "unlicense org", 0.85),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", 0.98),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", 0.99),
    ("ofl-1.1", "scripts sil org ofl", 0.95),
    ("ofl-1.1", "neither the font software nor any of its individual components in original or modified versions may be sold by itself", 0.97),
    ("bitstream-vera", "bitstream vera is a trademark of bitstream inc", 0.95),
    ("odbl-1.0", "opendatacommons org licenses odbl", 0.95),
    ("odc-by-1.0", "opendatacommons org licenses by", 0.95),
    ("odc-by-1.0", "open data commons attribution licen[cs]e", 0.95),
    ("pddl-1.0", "opendatacommons org licenses pddl", 0.95),
    ("pddl-1.0", "public domain dedication and licen[cs]e", 0.9),
    ("ogl-uk-3.0", "open government licen[cs]e (?:version |v ?)?3 0", 0.95),
    ("ogl-uk", "contains public sector information licensed under the open government licen[cs]e", 0.95),
    ("etalab-2.0", "(?:licence ouverte|etalab open licen[cs]e)(?: (?:version )?2 0)?", 0.9),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0", 0.95),
    ("cc0-1.0", "to the extent possible under law (?:[^ ]+ ){1,8}waived all copyright and related or neighboring rights", 0.97),
    ("cc-by-4.0", "creativecommons org licenses by 4 0", 0.95),
    ("cc-by-3.0", "creativecommons org licenses by 3 0", 0.95),
    ("cc-by-2.0", "creativecommons org licenses by 2 0", 0.95),
    ("cc-by-sa", "creativecommons org licenses by sa [234] [05]", 0.95),
    ("cc-by-sa", "text is available under the creative commons attribution share ?alike licen[cs]e", 0.97),
    ("cc-by-nc", "creativecommons org licenses by nc [234] [05]", 0.95),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa [234] [05]", 0.95),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd [234] [05]", 0.95),
    ("cc-by-nd", "creativecommons org licenses by nd [234] [05]", 0.95),
    ("cc-by", "this work is licensed under a creative commons attribution", 0.85),
    ("cc-by", "some rights reserved this work is licensed under a creative commons", 0.8),
    ("gpl", "free software foundation inc 5[19] (?:temple place|franklin street)", 0.8),
    ("sspl-1.0", "server side public licen[cs]e", 0.95),
    ("elastic-2.0", "elastic licen[cs]e (?:version |v )?2 0", 0.95),
    ("busl-1.1", "business source licen[cs]e (?:version )?1 1", 0.95),
    ("commons-clause", "commons clause licen[cs]e condition", 0.95),
    ("commons-clause", "the license does not grant to you the right to sell the software", 0.95),
    ("polyform-noncommercial-1.0", "polyform noncommercial licen[cs]e", 0.95),
    ("openrail", "(?:creativeml |bigscience |bigcode )?open ?rail(?: m)? licen[cs]e", 0.9),
    ("public-domain", "(?:released into|placed in|dedicated to|in) the public domain", 0.7),
    ("public-domain", "the authors? hereby disclaims? copyright to this source code", 0.9),
    ("public-domain", "this (?:file|work|program) has no copyright assigned and is placed in the public domain", 0.95),
    ("us-government", "this is a work of the (?:u s|us|united states) government (?:and is )?not subject to copyright protection", 0.95),
    ("non-commercial", "(?:for )?non ?commercial (?:use|purposes) only", 0.6),
    ("non-commercial", "free for (?:personal|academic|educational|research) (?:and (?:personal|academic|educational|research) )?use only", 0.6),
    ("evaluation", "for (?:evaluation|internal|trial) (?:use|purposes) only", 0.5),
    ("proprietary", "all rights reserved", 0.5),
    ("proprietary", "(?:confidential and proprietary|proprietary and confidential)", 0.6),
    ("proprietary", "unauthorized (?:copying|use|reproduction|distribution) (?:[^ ]+ ){0,8}is strictly prohibited", 0.8),
    ("proprietary", "no part of this (?:publication|book|document|work) may be reproduced", 0.7),
    ("proprietary", "(?:may not|must not) be (?:copied|reproduced|disclosed|distributed) without (?:the )?(?:prior |express )?written (?:permission|consent)", 0.7),
    ("proprietary", "this software is the confidential and proprietary information of", 0.9),
    ("eula", "end user licen[cs]e agreement", 0.7),
    ("eula", "by (?:installing|downloading|using) (?:or (?:installing|downloading|using) )?(?:this|the) software you agree to be bound by the terms", 0.85),
)

#: Words too common to tell anything; they are not chosen, which decides on speed alone.
COMMON = frozenset(
    "a all an and any are as be book by can code contains copy distributed document file files following for free from good has if in included inc internal is library made make may must name no not of on only "
    "open or org other part parts permission permitted personal prior project provided public published purpose purposes research reserved rights see shall should software source state subject terms that the "
    "these this to trial under unlimited use used user v version was whom will with without work written www you your".split()
)
#: Stands for any word in a written-out pattern.
ANY = "\0"

#: Fixed values of the contract: phrase, label.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def _written(pattern: str) -> list[str]:
    """All texts that a pattern matches: of letters, classes of letters, groups, alternatives and ``?``; a repeated ``[^ ]`` is ``ANY``."""
    at = 0

    def either() -> list[str]:
        nonlocal at
        found = several()
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            found = found + several()
        return found

    def several() -> list[str]:
        nonlocal at
        found = [""]
        while at < len(pattern) and pattern[at] not in "|)":
            if pattern.startswith("(?:", at):
                at += 3
                one = either()
                at += 1
            elif pattern[at] == "[":
                end = pattern.index("]", at)
                one, at = [ANY] if pattern[at + 1] == "^" else list(pattern[at + 1 : end]), end + 1
            else:
                one, at = [pattern[at]], at + 1
            if pattern[at : at + 1] == "?":
                one, at = ["", *one], at + 1
            elif pattern[at : at + 1] == "+":
                at += 1
            elif pattern[at : at + 1] == "{":
                at = pattern.index("}", at) + 1
            found = [a + b for a in found for b in one]
        return found

    return either()


@cache
def phrases(pattern: str) -> tuple[str, ...]:
    """The shortest texts, between spaces, of which every match of a pattern holds one."""
    chosen: list[str] = []
    for text in sorted({f" {w} " for w in _written(pattern)}, key=lambda w: (len(w), w)):
        if not any(c in text for c in chosen):
            chosen.append(text)
    return tuple(chosen)


def _runs(text: str) -> set[str]:
    """Three words in a row of a text, between spaces, or fewer with one that isn't common; the text itself if it has no such."""
    words = text.split()
    runs = [words[i : i + n] for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return {f" {' '.join(r)} " for r in runs if ANY not in r and (len(r) == 3 or any(w not in COMMON and not (w.isdigit() or len(w) < 2) for w in r))} or {text}


def _parts(text: str) -> set[str]:
    """As ``_runs``, without the space before them, so that a search doesn't stop at each word; and beginnings and ends of words that aren't common."""
    words = [w for w in text.split() if ANY not in w and w not in COMMON and not w.isdigit()]
    return {r[1:] for r in _runs(text)} | {w[:5] for w in words if len(w) > 5} | {f"{w[-3:]} " for w in words if len(w) in (3, 4)}


def cover(texts: Iterable[str], cost: Counter[str] | None = None, parts: Callable[[str], set[str]] = _runs) -> tuple[str, ...]:
    """Words of which every text holds one: few, and those of least cost (1 each if none is given)."""
    left = {t: parts(t) for t in texts}
    chosen: list[str] = []
    while left:
        counts = Counter(r for runs in left.values() for r in runs)
        chosen.append(min(counts, key=lambda r: ((cost[r] if cost else 1) / counts[r], -len(r), r)))
        left = {t: runs for t, runs in left.items() if chosen[-1] not in t}
    return tuple(chosen)


def gate(found: Iterable[Rule]) -> tuple[str, ...]:
    """What a text must hold one of for any of the rules to match it."""
    return cover({p for r in found for p in r.phrases}, parts=_parts)


@cache
def _all() -> tuple[Rule, ...]:
    # A run of words costs as many as there are labels whose patterns have it.
    groups = [(label, phrases(p)) for label, *both in FAMILIES for p in both] + [(label, phrases(p)) for label, p, _ in SENTENCES]
    cost = Counter(r for _, r in {(label, r) for label, texts in groups for t in texts for r in _runs(t)})
    found: list[Rule] = []
    for label, names, identifiers in FAMILIES:
        for priority, template, confidence in TEMPLATES:
            named = "N" in template
            own = names if named else identifiers
            body = template.replace("N", f"(?:{names})").replace("I", f"(?:{identifiers})")
            found.append(Rule(len(found), priority, label, cover(phrases(own), cost), body, confidence, phrases(own if named else body)))
    for label, pattern, confidence in SENTENCES:
        found.append(Rule(len(found), 6, label, cover(phrases(pattern), cost), pattern, confidence, phrases(pattern)))
    return tuple(r._replace(pattern=f"(?<= )(?:{r.pattern})(?= )") for r in found)


def rules() -> list[Rule]:
    return list(_all())
