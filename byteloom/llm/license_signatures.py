"""The signature rules of the license scan, written by hand: label, kind, keywords, pattern.

Patterns run over lower-case words joined by single spaces. One of the keywords (parted by |) stands
in every text that the pattern matches; a test draws matches of each pattern to prove it.
"""

SIGNATURES = (
    # MIT and its kin
    ("mit", "id", "identifier mit", r"spdx license identifier mit"),
    ("mit", "text", "hereby granted free", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)?"),
    ("mit", "part", "without restriction including", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell(?: copies of the software)?"),
    ("mit", "part", "and this permission notice", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", "address", "org licenses mit|org license mit", r"(?:https? )?(?:www )?opensource org licenses? mit(?: license)?(?: php| html)?"),
    ("mit", "grant", "mit |expat ", r"(?:licen[sc]ed|released|distributed|available|published|provided|offered|covered) under (?:the )?(?:terms of (?:the )?)?(?:mit|expat)(?: style)? licen[sc]e"),
    ("mit", "mention", "mit |expat ", r"(?:under|subject to|governed by|according to) (?:the )?(?:terms of (?:the )?)?(?:mit|expat)(?: style)? licen[sc]e"),
    ("mit", "mention", "license mit|licence mit|license is mit|licence is mit", r"licen[sc]e (?:is )?mit"),
    ("mit", "name", "mit licen|mit style|mit x11|expat licen", r"(?:the )?(?:mit(?: style)?|mit x11|expat) licen[sc]e"),
    ("mit-0", "id", "identifier mit 0", r"spdx license identifier mit 0"),
    ("mit-0", "name", "no attribution", r"mit no attribution(?: licen[sc]e)?"),
    ("x11", "part", "shall not be used in advertising", r"shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
    ("x11", "name", "x11 licen", r"(?:the )?x11 licen[sc]e"),
    # Apache
    ("apache-2", "id", "identifier apache 2", r"spdx license identifier apache 2 0"),
    ("apache-2", "header", "except in compliance", r"you may not use this file except in compliance with the license(?: you may obtain a copy of the license at)?"),
    ("apache-2", "part", "agreed to in writing", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", "text", "apache license version 2", r"apache license version 2 0 january 2004"),
    ("apache-2", "part", "each contributor hereby grants to you a perpetual", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license"),
    ("apache-2", "address", "licenses license 2", r"(?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2", "grant", "apache", r"(?:licen[sc]ed|released|distributed|available|published|provided|offered|covered)(?: to you)? under (?:the )?(?:terms of (?:the )?)?apache(?: software| public)? licen[sc]e(?: version| v)? ?2(?: 0)?"),
    ("apache-2", "mention", "license apache 2|licence apache 2|license is apache 2|licence is apache 2", r"licen[sc]e (?:is )?apache 2(?: 0)?"),
    ("apache-2", "name", "apache", r"(?:the )?apache(?: software| public)? licen[sc]e(?: version| v)? ?2(?: 0)?"),
    ("apache-2", "name", "apache 2|asl 2", r"apache 2(?: 0)?(?: licen[sc]e)?|asl 2 0"),
    ("apache-1", "id", "identifier apache 1", r"spdx license identifier apache 1 [01]"),
    ("apache-1", "part", "developed by the apache", r"this product includes software developed by the apache (?:software foundation|group)"),
    ("apache-1", "part", "apache software foundation must not", r"(?:the names )?apache(?: server| group)? and apache software foundation must not be used to endorse or promote products"),
    ("apache-1", "name", "apache", r"(?:the )?apache(?: software| public)? licen[sc]e(?: version| v)? 1(?: [01])?"),
    ("apache", "weak", "apache", r"(?:the )?apache(?: software| public)? licen[sc]e"),
    # BSD
    ("bsd-2-clause", "id", "identifier bsd 2", r"spdx license identifier bsd 2 clause(?: patent| views)?"),
    ("bsd-2-clause", "address", "licenses bsd 2", r"(?:https? )?(?:www )?opensource org licenses bsd 2 clause"),
    ("bsd-2-clause", "name", "2 clause bsd|two clause bsd|simplified bsd|freebsd", r"(?:2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: style)? licen[sc]e"),
    ("bsd-2-clause", "name", "bsd 2 clause", r"bsd 2 clause(?: simplified)?(?: licen[sc]e)?"),
    ("bsd-3-clause", "id", "identifier bsd 3", r"spdx license identifier bsd 3 clause(?: clear| attribution| lbnl)?"),
    ("bsd-3-clause", "text", "endorse or promote", r"neither the names? of .{1,120}? nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "part", "endorse or promote", r"the names? of .{1,80}? may not be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "address", "licenses bsd 3", r"(?:https? )?(?:www )?opensource org licenses bsd 3 clause"),
    ("bsd-3-clause", "name", "3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd", r"(?:3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: style)?(?: licen[sc]e)?"),
    ("bsd-3-clause", "name", "bsd 3 clause", r"bsd 3 clause(?: new| revised| clear)*(?: licen[sc]e)?"),
    ("bsd-4-clause", "id", "identifier bsd 4", r"spdx license identifier bsd 4 clause(?: uc)?"),
    ("bsd-4-clause", "text", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ments?"),
    ("bsd-4-clause", "name", "4 clause bsd|four clause bsd|original bsd|bsd 4 clause", r"(?:4 clause bsd|four clause bsd|original bsd|bsd 4 clause)(?: licen[sc]e)?"),
    ("bsd", "text", "source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    ("bsd", "part", "must retain the above", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "part", "must reproduce the above", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "grant", "bsd ", r"(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of (?:the )?)?bsd(?: style| like)? licen[sc]e"),
    ("bsd", "address", "licenses bsd license", r"(?:https? )?(?:www )?opensource org licenses bsd license(?: php)?"),
    ("bsd", "name", "bsd licen|bsd style|bsd like", r"bsd(?: style| like)? licen[sc]e"),
    ("0bsd", "id", "identifier 0bsd", r"spdx license identifier 0bsd"),
    ("0bsd", "name", "0bsd|zero clause bsd", r"0bsd|zero clause bsd(?: licen[sc]e)?"),
    # GNU GPL
    ("gpl-1", "id", "identifier gpl 1", r"spdx license identifier gpl 1 0(?: only| or later)?"),
    ("gpl-1", "header", "either version 1", r"either version 1 or at your option any later version"),
    ("gpl-1", "name", "general public|gpl", r"(?:gnu )?(?:general public licen[sc]e|gpl)(?: version| v)? ?1(?: 0)?"),
    ("gpl-2", "id", "identifier gpl 2", r"spdx license identifier gpl 2 0(?: only| or later| with [a-z]+(?: [a-z]+){0,3}? exception(?: [0-9])*)?"),
    ("gpl-2", "header", "either version 2", r"either version 2 of the license or at your option any later version"),
    ("gpl-2", "text", "version 2 june 1991", r"gnu general public license version 2 june 1991"),
    ("gpl-2", "part", "covered by this license they are outside", r"activities other than copying distribution and modification are not covered by this license they are outside its scope"),
    ("gpl-2", "address", "licenses gpl 2|licenses gpl 2|licenses old licenses gpl", r"(?:https? )?(?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?"),
    ("gpl-2", "grant", "general public|gpl", r"(?:licen[sc]ed|released|distributed|available|published|provided|redistributed) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:general public licen[sc]e|gpl)(?: version| v)? ?2(?: 0)?"),
    ("gpl-2", "name", "general public|gpl", r"(?:gnu )?(?:general public licen[sc]e|gpl)(?: version| v)? ?2(?: 0)?(?: only| or later)?"),
    ("gpl-2", "name", "gplv2", r"(?:gnu )?gplv2(?: only| or later)?"),
    ("gpl-3", "id", "identifier gpl 3", r"spdx license identifier gpl 3 0(?: only| or later| with [a-z]+(?: [a-z]+){0,3}? exception(?: [0-9])*)?"),
    ("gpl-3", "header", "either version 3", r"either version 3 of the license or at your option any later version"),
    ("gpl-3", "text", "version 3 29 june 2007", r"gnu general public license version 3 29 june 2007"),
    ("gpl-3", "part", "covered work|to propagate a work", r"to propagate a work means to do anything with it|you may convey a covered work in object code form"),
    ("gpl-3", "address", "licenses gpl 3", r"(?:https? )?(?:www )?gnu org licenses gpl 3 0(?: html| txt)?"),
    ("gpl-3", "grant", "general public|gpl", r"(?:licen[sc]ed|released|distributed|available|published|provided|redistributed) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:general public licen[sc]e|gpl)(?: version| v)? ?3(?: 0)?"),
    ("gpl-3", "name", "general public|gpl", r"(?:gnu )?(?:general public licen[sc]e|gpl)(?: version| v)? ?3(?: 0)?(?: only| or later)?"),
    ("gpl-3", "name", "gplv3", r"(?:gnu )?gplv3(?: only| or later)?"),
    ("gpl", "header", "redistribute it and or", r"(?:this program|it|this file|this library) is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "part", "have received a copy", r"you should have received a copy of the gnu general public license"),
    ("gpl", "part", "fitness for a particular purpose see the gnu general", r"merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl", "address", "gnu org licenses gpl|gnu org copyleft gpl", r"(?:https? )?(?:www )?gnu org (?:licenses|copyleft) gpl(?: html| txt)?"),
    ("gpl", "mention", "the gpl|the gnu gpl", r"(?:under|of) the (?:gnu )?gpl"),
    ("gpl", "name", "gnu g", r"gnu (?:general public licen[sc]e|gpl)"),
    # GNU LGPL, AGPL, FDL
    ("lgpl-2", "id", "identifier lgpl 2 0", r"spdx license identifier lgpl 2 0(?: only| or later)?"),
    ("lgpl-2", "header", "gnu library general", r"under the terms of the gnu library general public license as published by the free software foundation"),
    ("lgpl-2", "name", "library general public", r"(?:gnu )?library general public licen[sc]e(?: version| v)?(?: 2(?: 0)?)?"),
    ("lgpl-2.1", "id", "identifier lgpl 2 1", r"spdx license identifier lgpl 2 1(?: only| or later)?"),
    ("lgpl-2.1", "header", "either version 2 1", r"either version 2 1 of the license or at your option any later version"),
    ("lgpl-2.1", "address", "licenses lgpl 2|old licenses lgpl 2", r"(?:https? )?(?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?"),
    ("lgpl-2.1", "name", "lesser general public|lgpl", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?: version| v)? ?2 1(?: only| or later)?"),
    ("lgpl-2.1", "name", "lgplv2 1", r"(?:gnu )?lgplv2 1(?: only| or later)?"),
    ("lgpl-3", "id", "identifier lgpl 3", r"spdx license identifier lgpl 3 0(?: only| or later)?"),
    ("lgpl-3", "address", "licenses lgpl 3", r"(?:https? )?(?:www )?gnu org licenses lgpl 3 0(?: html| txt)?"),
    ("lgpl-3", "name", "lesser general public|lgpl", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?: version| v)? ?3(?: 0)?(?: only| or later)?"),
    ("lgpl-3", "name", "lgplv3", r"(?:gnu )?lgplv3(?: only| or later)?"),
    ("lgpl", "header", "gnu lesser general", r"under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "part", "have received a copy", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl", "address", "gnu org licenses lgpl|gnu org copyleft lesser", r"(?:https? )?(?:www )?gnu org (?:licenses lgpl|copyleft lesser)(?: html| txt)?"),
    ("lgpl", "weak", "lesser general public", r"(?:gnu )?lesser general public licen[sc]e"),
    ("agpl-3", "id", "identifier agpl 3", r"spdx license identifier agpl 3 0(?: only| or later)?"),
    ("agpl-3", "header", "gnu affero general", r"under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl-3", "part", "have received a copy", r"you should have received a copy of the gnu affero general public license"),
    ("agpl-3", "address", "licenses agpl", r"(?:https? )?(?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?"),
    ("agpl-3", "name", "affero general public|agpl", r"(?:gnu )?(?:affero general public licen[sc]e|agpl)(?: version| v)? ?3(?: 0)?(?: only| or later)?"),
    ("agpl-3", "name", "agplv3", r"(?:gnu )?agplv3(?: only| or later)?"),
    ("gfdl", "id", "identifier gfdl", r"spdx license identifier gfdl 1 [123](?: only| or later| invariants only| no invariants only)?"),
    ("gfdl", "header", "copy distribute and or modify this document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "part", "invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", "address", "gnu org licenses fdl|gnu org copyleft fdl", r"(?:https? )?(?:www )?gnu org (?:licenses|copyleft) fdl(?: 1 [123])?(?: html| txt)?"),
    ("gfdl", "name", "free documentation|gfdl", r"(?:gnu )?free documentation licen[sc]e(?: version)?(?: 1 [123])?|gfdl(?: 1 [123])?"),
    # Mozilla, Eclipse, CDDL, IBM, Nokia and the like
    ("mpl-1", "id", "identifier mpl 1", r"spdx license identifier mpl 1 [01]"),
    ("mpl-1", "header", "contents of this file", r"the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("mpl-1", "address", "mozilla org mpl", r"(?:https? )?(?:www )?mozilla org mpl(?: mpl 1 [01])?(?: html| txt)?"),
    ("mpl-1", "name", "mozilla |mpl", r"(?:mozilla public licen[sc]e|mpl)(?: version| v)? ?1 [01]"),
    ("mpl-2", "id", "identifier mpl 2", r"spdx license identifier mpl 2 0(?: no copyleft exception)?"),
    ("mpl-2", "header", "source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "part", "mpl was not distributed", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2", "address", "mozilla org mpl 2|mozilla org en us mpl 2", r"(?:https? )?(?:www )?mozilla org (?:en us )?mpl 2 0"),
    ("mpl-2", "grant", "mozilla |mpl", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:mozilla public licen[sc]e|mpl)(?: version| v)? ?2(?: 0)?"),
    ("mpl-2", "name", "mozilla |mpl", r"(?:mozilla public licen[sc]e|mpl)(?: version| v)? ?2(?: 0)?"),
    ("mpl", "weak", "mozilla public", r"mozilla public licen[sc]e"),
    ("npl", "header", "netscape public", r"the contents of this file are subject to the netscape public license version 1 [01]"),
    ("npl", "name", "netscape public", r"netscape public licen[sc]e"),
    ("epl-1", "id", "identifier epl 1", r"spdx license identifier epl 1 0"),
    ("epl-1", "header", "accompanying materials", r"(?:this program and the )?accompanying materials are made available under the terms of the eclipse public license v ?1 0"),
    ("epl-1", "part", "eclipse public", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("epl-1", "address", "eclipse org legal epl v10", r"(?:https? )?(?:www )?eclipse org legal epl v10(?: html)?"),
    ("epl-1", "name", "eclipse public|epl", r"(?:eclipse public licen[sc]e|epl)(?: version| v)? ?1 0"),
    ("epl-2", "id", "identifier epl 2", r"spdx license identifier epl 2 0"),
    ("epl-2", "header", "accompanying materials", r"(?:this program and the )?accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("epl-2", "address", "eclipse org legal epl 2", r"(?:https? )?(?:www )?eclipse org legal epl 2 0"),
    ("epl-2", "name", "eclipse public|epl", r"(?:eclipse public licen[sc]e|epl)(?: version| v)? ?2 0"),
    ("epl", "weak", "eclipse public", r"eclipse public licen[sc]e"),
    ("edl", "address", "eclipse org org documents edl", r"(?:https? )?(?:www )?eclipse org org documents edl v10(?: php| html)?"),
    ("edl", "name", "eclipse distribution", r"eclipse distribution licen[sc]e(?: v| version)?(?: 1 0)?"),
    ("cddl", "id", "identifier cddl", r"spdx license identifier cddl 1 [01]"),
    ("cddl", "header", "contents of this file", r"the contents of this file are subject to the terms of (?:either .{1,80}? or )?the common development and distribution license"),
    ("cddl", "name", "common development and|cddl", r"common development and distribution licen[sc]e(?: cddl)?(?: version| v)?(?: 1 [01])?|cddl(?: version| v)? 1 [01]"),
    ("cpl", "id", "identifier cpl", r"spdx license identifier cpl 1 0"),
    ("cpl", "part", "common public", r"the accompanying program is provided under the terms of this common public license"),
    ("cpl", "name", "common public", r"common public licen[sc]e(?: version| v)?(?: 1 0)?"),
    ("ipl", "name", "ibm public", r"ibm public licen[sc]e(?: version| v)?(?: 1 0)?"),
    ("cpal", "name", "common public attribution", r"common public attribution licen[sc]e"),
    ("spl", "name", "sun public", r"sun public licen[sc]e"),
    ("qpl", "name", "q public", r"q public licen[sc]e"),
    ("apsl", "header", "apple public source", r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"),
    ("apsl", "name", "apple public source", r"apple public source licen[sc]e"),
    ("lucent", "name", "lucent public", r"lucent public licen[sc]e"),
    ("reciprocal", "name", "reciprocal public", r"reciprocal public licen[sc]e"),
    ("eupl", "id", "identifier eupl", r"spdx license identifier eupl 1 [012]"),
    ("eupl", "header", "under the eupl", r"licensed under the eupl(?: version| v)? ?1 [012]"),
    ("eupl", "name", "european union public|eupl", r"european union public licen[sc]e|eupl(?: version| v)? ?1 [012]"),
    # Perl, Python, Ruby, PHP, Tcl and other languages
    ("artistic-1", "id", "identifier artistic 1", r"spdx license identifier artistic 1 0(?: perl| cl8)?"),
    ("artistic-1", "name", "artistic licen", r"artistic licen[sc]e(?: version| v)? 1(?: 0)?"),
    ("artistic-2", "id", "identifier artistic 2", r"spdx license identifier artistic 2 0"),
    ("artistic-2", "address", "licenses artistic", r"(?:https? )?(?:www )?opensource org licenses artistic license 2 0"),
    ("artistic-2", "name", "artistic licen", r"artistic licen[sc]e(?: version| v)? 2(?: 0)?"),
    ("artistic", "text", "conditions under which", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", "weak", "artistic licen", r"(?:the )?artistic licen[sc]e"),
    ("perl", "grant", "terms as perl", r"(?:under|on) the same terms as perl(?: itself| 5)?"),
    ("perl", "name", "terms as perl", r"same terms as perl(?: itself)?"),
    ("python", "id", "identifier psf|identifier python", r"spdx license identifier (?:psf|python) 2 0"),
    ("python", "text", "python software foundation", r"this license agreement is between the python software foundation(?: psf)?"),
    ("python", "name", "python software foundation|psf licen", r"python software foundation licen[sc]e|psf licen[sc]e(?: agreement)?"),
    ("ruby", "header", "terms as ruby", r"(?:under|on) the same terms as ruby(?: itself)?"),
    ("ruby", "name", "ruby ", r"ruby(?: s)? licen[sc]e"),
    ("php", "id", "identifier php", r"spdx license identifier php 3 01?"),
    ("php", "header", "subject to version 3", r"this source file is subject to version 3 01? of the php license"),
    ("php", "address", "php net license", r"(?:https? )?(?:www )?php net license(?: 3 01?)?(?: txt)?"),
    ("php", "name", "php licen", r"php licen[sc]e(?: version| v)?(?: 3(?: 01?)?)?"),
    ("zend", "name", "zend ", r"zend(?: engine)? licen[sc]e"),
    ("tcl", "text", "regents of the university of california sun microsystems", r"this software is copyrighted by the regents of the university of california sun microsystems"),
    ("tcl", "name", "tcl licen|tcl tk licen", r"tcl(?: tk)? licen[sc]e"),
    ("lua", "name", "lua licen", r"lua licen[sc]e"),
    ("llvm", "id", "llvm exception", r"spdx license identifier apache 2 0 with llvm exceptions?"),
    ("llvm", "header", "llvm exceptions", r"(?:part of the llvm project )?under the apache license v2 0 with llvm exceptions"),
    ("vim", "name", "vim licen", r"vim licen[sc]e"),
    ("json", "part", "good not evil", r"the software shall be used for good not evil"),
    ("json", "name", "json licen", r"json licen[sc]e"),
    # Small permissive ones
    ("isc", "id", "identifier isc", r"spdx license identifier isc"),
    ("isc", "text", "with or without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "name", "isc licen|isc style", r"isc(?: style)? licen[sc]e"),
    ("zlib", "id", "identifier zlib", r"spdx license identifier zlib(?: acknowledgement)?"),
    ("zlib", "text", "in no event will the authors", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "part", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("zlib", "part", "origin of this software", r"the origin of this software must not be misrepresented"),
    ("zlib", "name", "zlib ", r"zlib(?: libpng)? licen[sc]e"),
    ("libpng", "part", "is supplied as is", r"(?:libpng|the png reference library) is supplied as is"),
    ("libpng", "name", "libpng licen", r"libpng licen[sc]e"),
    ("boost-1", "id", "identifier bsl 1", r"spdx license identifier bsl 1 0"),
    ("boost-1", "text", "any person or organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("boost-1", "header", "boost software", r"distributed under the boost software license version 1 0"),
    ("boost-1", "address", "boost org license", r"(?:https? )?(?:www )?boost org license 1 0(?: txt)?"),
    ("boost-1", "name", "boost software", r"boost software licen[sc]e(?: version)?(?: 1 0)?"),
    ("curl", "id", "identifier curl", r"spdx license identifier curl"),
    ("curl", "name", "curl licen", r"curl licen[sc]e"),
    ("openssl", "text", "openssl project for use", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "part", "eric young", r"this product includes (?:cryptographic )?software written by eric young"),
    ("openssl", "name", "openssl licen|ssleay licen", r"(?:openssl|ssleay) licen[sc]e"),
    ("postgresql", "text", "without a written agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("postgresql", "name", "postgresql licen", r"postgresql licen[sc]e"),
    ("ncsa", "id", "identifier ncsa", r"spdx license identifier ncsa"),
    ("ncsa", "name", "ncsa ", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("w3c", "id", "identifier w3c", r"spdx license identifier w3c(?: 19980720| 20150513)?"),
    ("w3c", "name", "w3c software", r"w3c software(?: notice and| and document notice and)? licen[sc]e"),
    ("ntp", "text", "any purpose with or without fee", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("hpnd", "text", "any purpose and without fee", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("ijg", "part", "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", "part", "freetype ", r"portions of this software are copyright .{0,40}?the freetype project"),
    ("freetype", "name", "freetype ", r"(?:the )?freetype(?: project)? licen[sc]e"),
    ("imagemagick", "name", "imagemagick licen", r"imagemagick licen[sc]e"),
    ("unicode", "id", "identifier unicode", r"spdx license identifier unicode (?:dfs 201[56]|3 0|tou)"),
    ("unicode", "part", "unicode data files", r"obtaining a copy of the unicode data files and any associated documentation"),
    ("unicode", "name", "unicode ", r"unicode(?: inc)? licen[sc]e(?: agreement)?"),
    ("icu", "name", "icu licen", r"icu licen[sc]e"),
    ("blueoak", "id", "identifier blueoak", r"spdx license identifier blueoak 1 0 0"),
    ("blueoak", "name", "blue oak", r"blue oak model licen[sc]e(?: 1 0 0)?"),
    ("upl", "name", "universal permissive", r"universal permissive licen[sc]e(?: upl)?"),
    ("mulan", "id", "identifier mulanpsl", r"spdx license identifier mulanpsl [12] 0"),
    ("mulan", "name", "mulan p", r"mulan (?:psl|permissive software licen[sc]e)(?: v)?(?: ?[12])?"),
    ("afl", "id", "identifier afl", r"spdx license identifier afl (?:1 [12]|2 [01]|3 0)"),
    ("afl", "header", "academic free", r"licensed under the academic free license version [123] [012]"),
    ("afl", "name", "academic free", r"academic free licen[sc]e(?: version| v)?(?: [123] [012])?"),
    ("osl", "id", "identifier osl", r"spdx license identifier osl (?:1 [01]|2 [01]|3 0)"),
    ("osl", "header", "open software licen", r"licensed under the open software license version [123] [01]"),
    ("osl", "name", "open software licen", r"open software licen[sc]e(?: version| v)?(?: [123] [01])?"),
    ("mspl", "id", "identifier ms pl", r"spdx license identifier ms pl"),
    ("mspl", "name", "microsoft public|ms pl", r"microsoft public licen[sc]e(?: ms pl)?|ms pl"),
    ("msrl", "id", "identifier ms rl", r"spdx license identifier ms rl"),
    ("msrl", "name", "microsoft reciprocal|ms rl", r"microsoft reciprocal licen[sc]e(?: ms rl)?|ms rl"),
    ("cecill", "id", "identifier cecill", r"spdx license identifier cecill (?:1 [01]|2 [01]|b|c)"),
    ("cecill", "header", "governed by the cecill", r"this software is governed by the cecill(?: [abc])? license"),
    ("cecill", "name", "cecill", r"(?:licence )?cecill(?: [abc2])?(?: licen[sc]e)?"),
    ("beerware", "text", "buy me a beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("beerware", "name", "beerware|beer ware", r"(?:the )?beer ?ware licen[sc]e"),
    # Public domain and do-as-you-please
    ("unlicense", "id", "identifier unlicense", r"spdx license identifier unlicense"),
    ("unlicense", "text", "unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "part", "anyone is free", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "address", "unlicense org", r"(?:https? )?(?:www )?unlicense org"),
    ("unlicense", "name", "the unlicense", r"the unlicense"),
    ("wtfpl", "id", "identifier wtfpl", r"spdx license identifier wtfpl"),
    ("wtfpl", "text", "you just do what", r"you just do what the fuck you want to"),
    ("wtfpl", "address", "wtfpl net", r"(?:https? )?(?:www )?wtfpl net(?: txt copying)?"),
    ("wtfpl", "name", "you want to public|wtfpl", r"do what the f(?:uck|\*ck|ck) you want to public licen[sc]e|wtfpl"),
    ("cc0", "id", "identifier cc0", r"spdx license identifier cc0 1 0"),
    ("cc0", "text", "possible under law", r"to the extent possible under law .{1,120}? (?:has|have) waived all copyright"),
    ("cc0", "address", "publicdomain zero", r"(?:https? )?(?:www )?creativecommons org publicdomain zero(?: 1 0)?"),
    ("cc0", "name", "cc0|creative commons zero|cc zero", r"cc0(?: 1 0)?(?: universal)?|creative commons zero|cc zero"),
    ("cc-pdm", "address", "publicdomain mark", r"(?:https? )?(?:www )?creativecommons org publicdomain mark(?: 1 0)?"),
    ("cc-pdm", "name", "public domain mark", r"public domain mark(?: 1 0)?"),
    ("public-domain", "grant", "public domain", r"(?:placed|released|dedicated|put) (?:in|into|to) the public domain"),
    ("public-domain", "mention", "public domain", r"(?:is|are) in the public domain"),
    # Creative Commons
    ("cc-by", "address", "licenses by", r"(?:https? )?(?:www )?creativecommons org licenses by(?: [1-4] [05])?"),
    ("cc-by", "name", "cc by", r"cc by(?: [1-4] [05])?(?: licen[sc]e)?"),
    ("cc-by", "name", "commons attribution", r"creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?"),
    ("cc-by-sa", "address", "licenses by sa", r"(?:https? )?(?:www )?creativecommons org licenses by sa(?: [1-4] [05])?"),
    ("cc-by-sa", "name", "cc by sa", r"cc by sa(?: [1-4] [05])?(?: licen[sc]e)?"),
    ("cc-by-sa", "name", "commons attribution share", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?"),
    ("cc-by-nd", "address", "licenses by nd", r"(?:https? )?(?:www )?creativecommons org licenses by nd(?: [1-4] [05])?"),
    ("cc-by-nd", "name", "cc by nd", r"cc by nd(?: [1-4] [05])?(?: licen[sc]e)?"),
    ("cc-by-nd", "name", "commons attribution no", r"creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?"),
    ("cc-by-nc", "address", "licenses by nc", r"(?:https? )?(?:www )?creativecommons org licenses by nc(?: [1-4] [05])?"),
    ("cc-by-nc", "name", "cc by nc", r"cc by nc(?: [1-4] [05])?(?: licen[sc]e)?"),
    ("cc-by-nc", "name", "commons attribution non", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?"),
    ("cc-by-nc-sa", "address", "licenses by nc sa", r"(?:https? )?(?:www )?creativecommons org licenses by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "name", "cc by nc sa", r"cc by nc sa(?: [1-4] [05])?(?: licen[sc]e)?"),
    ("cc-by-nc-sa", "name", "commercial share", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?"),
    ("cc-by-nc-nd", "address", "licenses by nc nd", r"(?:https? )?(?:www )?creativecommons org licenses by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "name", "cc by nc nd", r"cc by nc nd(?: [1-4] [05])?(?: licen[sc]e)?"),
    ("cc-by-nc-nd", "name", "commercial no", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?"),
    ("cc", "weak", "creative commons licen", r"(?:a )?creative commons licen[sc]e"),
    # Fonts
    ("ofl", "id", "identifier ofl", r"spdx license identifier ofl 1 [01](?: rfn| no rfn)?"),
    ("ofl", "header", "font software is licensed", r"this font software is licensed under the sil open font license(?: version)?(?: 1 [01])?"),
    ("ofl", "address", "sil org ofl", r"(?:https? )?(?:scripts )?sil org ofl"),
    ("ofl", "name", "open font licen", r"(?:sil )?open font licen[sc]e(?: version)?(?: 1 [01])?"),
    ("bitstream-vera", "text", "fonts accompanying this license", r"obtaining a copy of the fonts accompanying this license(?: fonts)?"),
    # Data, documents, governments
    ("odbl", "id", "identifier odbl", r"spdx license identifier odbl 1 0"),
    ("odbl", "header", "made available under the open database", r"this .{1,60}? is made available under the open database license"),
    ("odbl", "address", "opendatacommons org licenses odbl", r"(?:https? )?(?:www )?opendatacommons org licenses odbl(?: 1 0)?"),
    ("odbl", "name", "database licen|odbl", r"open (?:data commons open )?database licen[sc]e|odbl"),
    ("odc-by", "address", "opendatacommons org licenses by", r"(?:https? )?(?:www )?opendatacommons org licenses by(?: 1 0)?"),
    ("odc-by", "name", "commons attribution licen", r"open data commons attribution licen[sc]e"),
    ("pddl", "address", "opendatacommons org licenses pddl", r"(?:https? )?(?:www )?opendatacommons org licenses pddl(?: 1 0)?"),
    ("pddl", "name", "public domain dedication", r"public domain dedication and licen[sc]e"),
    ("ogl-uk", "id", "identifier ogl uk", r"spdx license identifier ogl uk [123] 0"),
    ("ogl-uk", "header", "public sector information", r"contains public sector information licensed under the open government licence"),
    ("ogl-uk", "address", "open government licence", r"(?:https? )?(?:www )?nationalarchives gov uk doc open government licence(?: version [123])?"),
    ("ogl-uk", "name", "open government licen", r"open government licen[sc]e(?: v| version)?(?: ?[123])?"),
    ("etalab", "name", "licence ouverte|etalab", r"licence ouverte(?: open licence)?|etalab 2 0"),
    ("dl-de", "name", "datenlizenz deutschland", r"datenlizenz deutschland (?:namensnennung|zero)(?: 2 0)?"),
    ("cdla", "name", "data license agreement|cdla", r"community data license agreement(?: permissive| sharing)?|cdla (?:permissive|sharing) [12] 0"),
    ("opl", "name", "open publication licen", r"open publication licen[sc]e"),
    # Source-available, models, proprietary
    ("business-source", "id", "identifier busl", r"spdx license identifier busl 1 1"),
    ("business-source", "text", "the licensor hereby grants you the right to copy", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("business-source", "name", "business source licen|busl", r"business source licen[sc]e(?: 1 1)?|busl(?: 1 1)?"),
    ("sspl", "id", "identifier sspl", r"spdx license identifier sspl 1 0"),
    ("sspl", "name", "server side public", r"server side public licen[sc]e(?: version| v)?(?: 1)?"),
    ("elastic", "header", "elastic license", r"licensed under (?:one or more contributor license agreements and )?the elastic license(?: 2 0)?"),
    ("elastic", "name", "elastic licen", r"elastic licen[sc]e(?: 2 0)?"),
    ("commons-clause", "header", "commons clause", r"commons clause license condition(?: v1 0)?"),
    ("commons-clause", "name", "commons clause", r"commons clause"),
    ("polyform", "name", "polyform ", r"polyform (?:noncommercial|small business|shield|perimeter|strict|free trial|internal use) licen[sc]e(?: 1 0 0)?"),
    ("prosperity", "name", "prosperity public", r"prosperity public licen[sc]e"),
    ("openrail", "name", "openrail|open rail", r"(?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[sc]e)?"),
    ("llama", "name", "community licen", r"llama [234](?: [0-9])? community licen[sc]e(?: agreement)?"),
    ("gemma", "name", "gemma terms", r"gemma terms of use"),
    ("proprietary", "header", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "text", "confidential and proprietary", r"this software is the confidential and proprietary information of"),
    ("proprietary", "part", "this publication may", r"no part of this publication may be reproduced"),
    ("proprietary", "part", "prior written permission", r"may not be (?:reproduced|copied|distributed)(?: or (?:reproduced|copied|distributed))? without (?:the )?(?:express )?prior written permission"),
    ("proprietary", "mention", "proprietary and confidential|confidential and proprietary", r"proprietary and confidential|confidential and proprietary"),
    ("proprietary", "name", "end user licen", r"end user licen[sc]e agreement"),
    ("proprietary", "weak", "rights reserved", r"all rights reserved"),
)
