"""License scans by ordered signature rules, native DataFrame operations only.

A text is reduced to its words, once. A few literals find the texts that may name a license at all. Each rule has a
keyword, a regular expression over the words, a label and a weight; a rule's place in the list is its priority. The
expression runs only where the keyword occurs. A detection that lies inside one of higher priority is suppressed;
what remains gives labels and a score.

The expressions are written by hand: titles and identifiers of licenses, sentences of their texts and notices, and their
addresses. Five kinds of signature are made of them (identifier tag, notice, grant, address, bare title, in that order of
priority; within a kind, in the order of the tables, special licenses before general ones).

Cases: a null text counts as empty and has no words; repeated rows are scanned alike; a phrase or rule that occurs several
times counts at each place; a long text with many detections compares each with those that overlap it only; other columns
are ignored, whatever their names; an empty table gives an empty result. Narrow: no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words, what lies between them, base phrases and their labels.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BASE_WEIGHT = 0.9
#: Whatever a phrase or a rule matches contains one of these.
GATE = (
    "licen", "spdx", "creative", "gpl", "bsd", "apache", "public domain", "wtfpl", "cc0", "cc by", "no attribution", "hereby grant", "redistribut", "above copyright", "advertising", "unencumbered", "altered source", "held liable", "waived all",
    "commercial purposes", "modified material", "medium or format", "retain this notice", "good not evil", "managed service", "perl itself", "strictly prohibited", "making python", "openssl", "includes php", "gemma",
    "mozilla org", "eclipse org", "zoy org", "sil org", "bsl11", "names of its", "deal with the software", "deal in the software", "views and conclusions",
)

#: label, keyword (in every match of the title), expression of titles, expression of identifiers ("" for none).
LICENSES = [
    ("agpl-3", "agpl", r"agpl ?v?3(?: 0)?(?: or later| only)?", r"agpl 3 0(?: only| or later)?"),
    ("agpl-3", "affero", r"gnu affero general public licen[cs]e(?: as published by the free software foundation)?(?: either)? (?:version|v) ?3(?: 0)?(?: or later)?", r""),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", r""),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?v?2 1(?: or later| only)?", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public licen[cs]e (?:version|v) ?2 1(?: or later)?", r""),
    ("lgpl-3", "lgpl", r"(?:gnu )?lgpl ?v?3(?: 0)?(?: or later| only)?", r"lgpl 3 0(?: only| or later)?"),
    ("lgpl-3", "lesser", r"gnu lesser general public licen[cs]e (?:version|v) ?3(?: 0)?(?: or later)?", r""),
    ("lgpl-2", "library", r"gnu library general public licen[cs]e(?: version 2(?: 0)?)?", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e", r""),
    ("gpl-3", "gpl", r"(?:gnu )?gpl ?(?:version )?v?3(?: 0)?(?: or later| only)?", r"gpl 3 0(?: only| or later)?"),
    ("gpl-3", "general", r"(?:gnu )?general public licen[cs]e (?:version|v) ?3(?: 0)?(?: or later| or any later version)?", r""),
    ("gpl-2", "gpl", r"(?:gnu )?gpl ?(?:version )?v?2(?: 0)?(?: or later| only)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-2", "general", r"(?:gnu )?general public licen[cs]e (?:version|v) ?2(?: 0)?(?: or later| or any later version)?", r""),
    ("gpl-1", "general", r"(?:gnu )?general public licen[cs]e (?:version|v) ?1(?: 0)?(?: or later)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl", "gnu", r"gnu general public licen[cs]e|gnu gpl", r""),
    ("gfdl", "documentation", r"gnu free documentation licen[cs]e(?: (?:version|v) ?1 [123])?", r"gfdl 1 [123](?: only| or later)?"),
    ("apache-2", "apache", r"apache (?:software )?licen[cs]e(?: ?version| ?v)? ?2(?: 0)?", r"apache 2 0"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e (?:version |v )?1 1", r"apache 1 1"),
    ("apache-1", "apache", r"apache (?:software )?licen[cs]e (?:version |v )?1 0", r"apache 1 0"),
    ("apache", "apache", r"apache (?:software )?licen[cs]e", r""),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?|mit 0 licen[cs]e", r"mit 0"),
    ("mit", "mit", r"mit licen[cs]e|mit x11 licen[cs]e|expat licen[cs]e mit", r"mit"),
    ("x11", "x11", r"x11 licen[cs]e", r"x11"),
    ("isc", "isc", r"isc licen[cs]e", r"isc"),
    ("bsd-4-clause", "bsd", r"(?:original |old )bsd licen[cs]e|bsd 4 clause(?: licen[cs]e)?|4 clause bsd(?: licen[cs]e)?", r"bsd 4 clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised) bsd licen[cs]e|bsd 3 clause(?: licen[cs]e)?|3 clause bsd(?: licen[cs]e)?", r"bsd 3 clause"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd) bsd licen[cs]e|bsd 2 clause(?: licen[cs]e)?|2 clause bsd(?: licen[cs]e)?", r"bsd 2 clause"),
    ("0bsd", "bsd", r"zero clause bsd(?: licen[cs]e)?|bsd zero clause licen[cs]e|0bsd licen[cs]e", r"0bsd"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e", r""),
    ("mpl-2", "mozilla", r"mozilla public licen[cs]e (?:version |v )?2(?: 0)?", r"mpl 2 0"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version |v )?1 1", r"mpl 1 1"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", r""),
    ("epl-2", "eclipse", r"eclipse public licen[cs]e (?:version |v )?2(?: 0)?", r"epl 2 0"),
    ("epl-1", "eclipse", r"eclipse public licen[cs]e (?:version |v )?1(?: 0)?", r"epl 1 0"),
    ("epl", "eclipse", r"eclipse public licen[cs]e", r""),
    ("cddl-1.1", "distribution", r"common development and distribution licen[cs]e (?:version |v )?1 1", r"cddl 1 1"),
    ("cddl-1", "distribution", r"common development and distribution licen[cs]e(?: (?:version |v )?1 0)?", r"cddl 1 0"),
    ("cpl-1", "common", r"common public licen[cs]e(?: (?:version |v )?1 0)?", r"cpl 1 0"),
    ("eupl-1.2", "european", r"european union public licen[cs]e (?:version |v )?1 2", r"eupl 1 2"),
    ("eupl", "european", r"european union public licen[cs]e", r"eupl 1 [01]"),
    ("artistic-2", "artistic", r"artistic licen[cs]e (?:version |v )?2(?: 0)?", r"artistic 2 0"),
    ("artistic-1", "artistic", r"(?:perl )?artistic licen[cs]e(?: (?:version |v )?1 0)?", r"artistic 1 0(?: perl)?"),
    ("boost-1", "boost", r"boost software licen[cs]e(?: (?:version |v )?1 0)?", r"bsl 1 0"),
    ("bsl-1.1", "business", r"business source licen[cs]e(?: (?:version |v )?1 1)?", r"busl 1 1"),
    ("elastic-2", "elastic", r"elastic licen[cs]e(?: (?:version |v )?2(?: 0)?)?", r"elastic 2 0"),
    ("sspl-1", "server", r"server side public licen[cs]e(?: (?:version |v )?1)?", r"sspl 1 0"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", r"zlib"),
    ("libpng", "libpng", r"libpng licen[cs]e(?: version 2)?", r"libpng 2 0"),
    ("unlicense", "unlicense", r"the unlicense|unlicense licen[cs]e", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: version 2| v2)?", r"wtfpl"),
    ("python-2", "licen", r"python software foundation licen[cs]e(?: version 2)?|psf licen[cs]e(?: agreement)?", r"psf 2 0|python 2 0"),
    ("php-3", "php", r"php licen[cs]e(?: (?:version |v )?3 0?1)?", r"php 3 0?1"),
    ("ruby", "ruby", r"ruby licen[cs]e", r"ruby"),
    ("openssl", "openssl", r"openssl(?: ssleay)? licen[cs]e", r"openssl"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql"),
    ("ncsa", "illinois", r"university of illinois ncsa open source licen[cs]e", r"ncsa"),
    ("ofl-1.1", "font", r"sil open font licen[cs]e(?: (?:version |v )?1 1)?", r"ofl 1 1"),
    ("odbl-1", "database", r"open (?:data commons open )?database licen[cs]e(?: (?:version |v )?1 0)?", r"odbl 1 0"),
    ("odc-by-1", "commons", r"open data commons attribution licen[cs]e(?: (?:version |v )?1 0)?", r"odc by 1 0"),
    ("cecill-2.1", "cecill", r"cecill(?: free software)? licen[cs]e(?: agreement)?(?: (?:version |v )?2 1)?", r"cecill 2 1"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", r"ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", r"ms rl"),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[cs]e", r"w3c"),
    ("openrail-m", "openrail", r"(?:bigscience |creativeml )?openrail m? ?licen[cs]e", r""),
    ("cc0-1", "cc0", r"cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("cc0-1", "zero", r"creative commons zero(?: (?:version |v )?1 0)?(?: universal)?", r""),
    ("cc-by-nc-nd", "nd", r"cc by nc nd(?: [1-4] [05])?(?: international| unported)?", r"cc by nc nd [1-4] [05]"),
    ("cc-by-nc-sa", "sa", r"cc by nc sa(?: [1-4] [05])?(?: international| unported)?", r"cc by nc sa [1-4] [05]"),
    ("cc-by-nc", "nc", r"cc by nc(?: [1-4] [05])?(?: international| unported)?", r"cc by nc [1-4] [05]"),
    ("cc-by-nd", "nd", r"cc by nd(?: [1-4] [05])?(?: international| unported)?", r"cc by nd [1-4] [05]"),
    ("cc-by-sa", "sa", r"cc by sa(?: [1-4] [05])?(?: international| unported)?", r"cc by sa [1-4] [05]"),
    ("cc-by", "cc", r"cc by(?: [1-4] [05])(?: international| unported)?", r"cc by [1-4] [05]"),
    ("cc-by-nc-nd", "noncommercial", r"creative commons attribution noncommercial no ?derivatives(?: works)?(?: [1-4] [05])?", r""),
    ("cc-by-nc-sa", "noncommercial", r"creative commons attribution noncommercial share ?alike(?: [1-4] [05])?", r""),
    ("cc-by-nc", "commercial", r"creative commons attribution non ?commercial(?: [1-4] [05])?", r""),
    ("cc-by-nd", "creative", r"creative commons attribution no ?derivatives(?: works)?(?: [1-4] [05])?", r""),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] [05])?", r""),
    ("cc-by", "creative", r"creative commons attribution(?: licen[cs]e)?(?: [1-4] [05])?", r""),
    ("public-domain", "domain", r"(?:dedicated to|placed in|released into|in) the public domain", r""),
    ("pddl-1", "domain", r"open data commons public domain dedication and licen[cs]e", r"pddl 1 0"),
    ("cdla-permissive-2", "data", r"community data licen[cs]e agreement permissive(?: version)? 2 0", r"cdla permissive 2 0"),
    ("cdla-sharing-1", "data", r"community data licen[cs]e agreement sharing(?: version)? 1 0", r"cdla sharing 1 0"),
    ("ogl-3", "government", r"open government licen[cs]e (?:version |v ?)3(?: 0)?", r"ogl uk 3 0"),
    ("ogl", "government", r"open government licen[cs]e", r""),
    ("llama", "llama", r"llama(?: ?[2-4])?(?: [0-9])? community licen[cs]e(?: agreement)?", r""),
    ("gemma", "gemma", r"gemma terms of use|gemma licen[cs]e", r""),
]

#: label, keyword, expression: sentences of license texts and of the notices that go with them.
NOTICES = [
    ("ncsa", "deal", r"to deal with the software without restriction including without limitation"),
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "deal", r"to deal in the software without restriction including without limitation"),
    ("mit", "permission notice", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("boost-1", "hereby", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"),
    ("isc", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", "hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "hereby", r"permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation for any purpose is hereby granted(?: without fee)?"),
    ("x11", "advertising", r"except as contained in this notice the names? of (?:[^ ]+ ){1,12}shall not be used in advertising or otherwise to promote the sale"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause", "endorse", r"neither the names? of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-2-clause", "views", r"the views and conclusions contained in the software and documentation are those of the authors"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", r"redistributions (?:of source code must retain|in binary form must reproduce) the above copyright notice this list of conditions and the following disclaimer"),
    ("agpl-3", "affero", r"gnu affero general public licen[cs]e as published by the free software foundation(?: either)? version 3 of the licen[cs]e"),
    ("lgpl-3", "lesser", r"gnu lesser general public licen[cs]e as published by the free software foundation(?: either)? version 3 of the licen[cs]e"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public licen[cs]e as published by the free software foundation(?: either)? version 2 1 of the licen[cs]e"),
    ("gpl-3", "general", r"gnu general public licen[cs]e as published by the free software foundation(?: either)? version 3 of the licen[cs]e"),
    ("gpl-2", "general", r"gnu general public licen[cs]e as published by the free software foundation(?: either)? version 2 of the licen[cs]e"),
    ("agpl", "affero", r"you should have received a copy of the gnu affero general public licen[cs]e along with"),
    ("lgpl", "lesser", r"you should have received a copy of the gnu lesser general public licen[cs]e along with"),
    ("gpl", "general", r"you should have received a copy of the gnu general public licen[cs]e along with"),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed"),
    ("wtfpl", "verbatim", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document"),
    ("wtfpl", "public", r"do what the fuck you want to public licen[cs]e"),
    ("apache-2", "compliance", r"you may not use this file except in compliance with the licen[cs]e you may obtain a copy of the licen[cs]e at"),
    ("apache-2", "apache", r"the asf licenses this file to you under the apache licen[cs]e version 2 0"),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("epl-2", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v? ?2 0"),
    ("epl-1", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v1 0"),
    ("cddl-1", "distribution", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("zlib", "liable", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("cc0-1", "waived", r"to the extent possible under law (?:[^ ]+ ){1,12}has waived all copyright and related or neighbou?ring rights"),
    ("cc-by-nc", "material", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "material", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-sa", "material", r"if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e as the original"),
    ("cc", "material", r"copy and redistribute the material in any medium or format"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font licen[cs]e"),
    ("python-2", "python", r"psf is making python available to licensee on an as is basis"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php-3", "php", r"this product includes php software freely available from"),
    ("perl-5", "perl", r"(?:you can |you may )?redistribute it and or modify it under the same terms as perl itself"),
    ("ms-pl", "accompanying", r"this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e"),
    ("bsl-1.1", "production", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("beerware", "stuff", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("proprietary", "copying", r"unauthori[sz]ed copying of (?:this file|this software) via any medium is strictly prohibited"),
]

#: label, keyword, expression: addresses of license texts, as words.
ADDRESSES = [
    ("apache-2", "apache org", r"apache org licenses license 2 0"),
    ("apache-1.1", "apache org", r"apache org licenses license 1 1"),
    ("apache-1", "apache org", r"apache org licenses license 1 0"),
    ("agpl-3", "gnu org", r"gnu org licenses agpl 3 0"),
    ("agpl", "gnu org", r"gnu org licenses agpl"),
    ("lgpl-3", "gnu org", r"gnu org licenses lgpl 3 0"),
    ("lgpl-2.1", "gnu org", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl", "gnu org", r"gnu org (?:licenses|copyleft) lgpl"),
    ("gpl-3", "gnu org", r"gnu org licenses gpl 3 0"),
    ("gpl-2", "gnu org", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl", "gnu org", r"gnu org (?:licenses|copyleft) gpl"),
    ("gfdl", "gnu org", r"gnu org licenses fdl(?: 1 [123])?"),
    ("mit", "opensource org", r"opensource org licenses? mit(?: license)?(?: php)?"),
    ("bsd", "opensource org", r"opensource org licenses? bsd license(?: php)?"),
    ("mpl-2", "mozilla org", r"mozilla org (?:en us )?mpl 2 0"),
    ("mpl-1.1", "mozilla org", r"mozilla org (?:en us )?mpl (?:mpl )?1 1"),
    ("epl-2", "eclipse org", r"eclipse org legal epl (?:v ?20|2 0|v ?2 0)"),
    ("epl-1", "eclipse org", r"eclipse org legal epl v ?10"),
    ("boost-1", "boost org", r"boost org licen[cs]e 1 0(?: txt)?"),
    ("unlicense", "unlicense org", r"unlicense org"),
    ("wtfpl", "wtfpl", r"wtfpl net|zoy org wtfpl"),
    ("ofl-1.1", "sil org", r"scripts sil org (?:cms scripts page php site id nrsi (?:amp )?id )?ofl|scripts sil org ofl"),
    ("ofl-1.1", "openfontlicense", r"openfontlicense org"),
    ("zlib", "zlib", r"zlib net zlib license"),
    ("php-3", "php net", r"php net license 3 01"),
    ("python-2", "python org", r"docs python org (?:[^ ]+ )?license"),
    ("openssl", "openssl org", r"openssl org source license"),
    ("postgresql", "postgresql org", r"postgresql org about licen[cs]e"),
    ("odbl-1", "opendatacommons", r"opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by-1", "opendatacommons", r"opendatacommons org licenses by(?: 1 0)?"),
    ("pddl-1", "opendatacommons", r"opendatacommons org licenses pddl(?: 1 0)?"),
    ("ogl-3", "nationalarchives", r"nationalarchives gov uk doc open government licen[cs]e version 3"),
    ("artistic-2", "perlfoundation", r"perlfoundation org artistic license 2 0"),
    ("artistic-1", "perl org", r"dev perl org licenses artistic"),
    ("elastic-2", "elastic co", r"elastic co licensing elastic license"),
    ("sspl-1", "mongodb com", r"mongodb com licensing server side public license"),
    ("bsl-1.1", "mariadb com", r"mariadb com bsl11"),
    ("cecill-2.1", "cecill info", r"cecill info licen[cs]es"),
    ("llama", "llama", r"llama meta com (?:llama[0-9]* )?license"),
    ("gemma", "google dev", r"ai google dev gemma terms"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by [1-4] [05]"),
    ("cc0-1", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", r"creativecommons org publicdomain mark 1 0"),
]

GRANT = r"(?:(?:dual )?licen[cs]ed|released|distributed|redistributed|available|published|provided|offered|covered|governed|made available|shared) (?:under|by|with) (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?(?:{title})(?: licen[cs]e)?"
CATALOGUE = r"(?:opensource org licenses?|spdx org licenses|choosealicense com licenses) {id}"

Rule = tuple[int, str, str, str, float]


def signature_rules() -> list[Rule]:
    """(priority, label, keyword, expression, weight), in order of priority."""
    tags = [(label, "identifier", rf"spdx licen[cs]e identifier (?:{id})", 1.0) for label, _, _, id in LICENSES if id]
    notices = [(*n, 0.98) for n in NOTICES]
    grants = [(label, keyword, GRANT.format(title=title), 0.95) for label, keyword, title, _ in LICENSES]
    addresses = [(*n, 0.85) for n in ADDRESSES] + [(label, "licens", CATALOGUE.format(id=f"(?:{id})"), 0.85) for label, _, _, id in LICENSES if id]
    titles = [(label, keyword, rf"(?:{title})", 0.7) for label, keyword, title, _ in LICENSES]
    found = tags + notices + grants + addresses + titles
    return [(p, label, keyword, f"(?<= ){x}(?= )", weight) for p, (label, keyword, x, weight) in enumerate(found)]


def count_of(text: Column, one: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(one), F.lit("")))


def rule_array(rules: list[Rule]) -> Column:
    """The rules as one constant, which a single literal brings to Spark."""
    named = [dict(zip(("priority", "label", "keyword", "expression", "weight"), r, strict=True)) for r in rules]
    return F.from_json(F.lit(json.dumps(named)), "array<struct<priority:int,label:string,keyword:string,expression:string,weight:double>>")


#: Items that are folded at once.
BLOCK = 64


def folded(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The arrays of ``kind`` that ``step(state, item) -> (state, array)`` gives for the items in turn, one after the other.

    An array grows by being copied, so items are folded in blocks: a block's array stays short, and the blocks' arrays are put
    together at the end. The time is in proportion to the items."""
    nothing = F.array().cast(f"array<{kind}>")

    def of_block(so_far: Column, block: Column) -> Column:
        def one(a: Column, x: Column) -> Column:
            state_, out = step(a["state"], x)
            return F.struct(state_.alias("state"), F.concat(a["out"], out).alias("out"))

        inner = F.aggregate(block, F.struct(so_far["state"].alias("state"), nothing.alias("out")), one)
        # what a block gives is bound to a lambda's argument, else it would be computed for each of its two uses
        return F.get(F.transform(F.array(inner), lambda i: F.struct(i["state"].alias("state"), F.concat(so_far["outs"], F.array(i["out"])).alias("outs"))), F.lit(0))

    def cut(all_: Column) -> Column:
        at = F.when(F.size(all_) > 0, F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda k: F.slice(all_, k * BLOCK + 1, F.lit(BLOCK)))

    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("outs"))
    blocks = F.flatten(F.transform(F.array(items), cut))
    return F.flatten(F.aggregate(blocks, start, of_block, lambda x: x["outs"]))


def detections(words: Column, rules: list[Rule]) -> Column:
    """array<struct<a, b, priority, label, weight>>: all matches of the rules whose keyword occurs, as places in ``words``. The
    rules are one constant array: an expression for each of them would take longer to plan than to run."""

    def places(s: Column) -> Column:
        sizes = F.arrays_zip(F.transform(s["between"], F.length).alias("gap"), F.transform(s["found"], F.length).alias("size"))

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            a = at + x["gap"]
            return a + x["size"], F.array(F.struct(a.alias("a"), (a + x["size"]).alias("b")))

        return folded(F.slice(sizes, F.lit(1), F.size(s["found"])), F.lit(0), "struct<a:int,b:int>", step)

    def spans(r: Column) -> Column:
        # what the expression finds is bound to a lambda's argument, else it would be found again at every step
        cut = F.struct(F.regexp_extract_all(words, r["expression"], F.lit(0)).alias("found"), F.split(words, r["expression"], -1).alias("between"))
        found = F.flatten(F.transform(F.array(cut), places))
        return F.transform(found, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), r["priority"].alias("priority"), r["label"].alias("label"), r["weight"].alias("weight")))

    return F.flatten(F.transform(F.filter(rule_array(rules), lambda r: F.contains(words, r["keyword"])), spans))


def unsuppressed(found: Column) -> Column:
    """Detections that lie in none of higher priority. In order of their starts, the longest first, whatever a detection can
    lie in comes before it and is still open where it starts."""
    in_order = F.array_sort(F.transform(found, lambda d: F.struct(d["a"].alias("a"), (-d["b"]).alias("z"), d["priority"].alias("priority"), d["label"].alias("label"), d["weight"].alias("weight"))))
    kind = "struct<a:int,z:int,priority:int,label:string,weight:double>"
    nothing = F.array().cast(f"array<{kind}>")

    def step(open_: Column, d: Column) -> tuple[Column, Column]:
        alive = F.filter(open_, lambda e: -e["z"] > d["a"])
        inside = F.exists(open_, lambda e: (-e["z"] > d["a"]) & (e["z"] <= d["z"]) & (e["priority"] < d["priority"]))
        return F.concat(alive, F.array(d)), F.when(inside, nothing).otherwise(F.array(d))

    return F.transform(folded(in_order, nothing, kind, step), lambda d: F.struct(d["a"].alias("a"), (-d["z"]).alias("b"), d["priority"].alias("priority"), d["label"].alias("label"), d["weight"].alias("weight")))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of every whole text;
    detections are array<struct<a, b, priority, label, weight>> in characters of the normalized words."""
    rules = signature_rules() if rules is None else rules
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.col(key).alias("key"), F.trim(F.regexp_replace(lower, BETWEEN, " ")).alias("plain"))
    n_words = F.when(F.col("plain") == "", 0).otherwise(count_of(F.col("plain"), " ") + 1)
    rows = rows.select("key", n_words.cast("long").alias("n_words"), F.when(F.exists(F.lit(list(GATE)), lambda x: F.contains(F.col("plain"), x)), F.concat(F.lit(" "), "plain", F.lit(" "))).alias("words"))
    places = []
    for phrase, label in BASE.items():
        parts, size = F.split("words", f" {phrase}(?= )", -1), len(phrase.split())
        last = F.col("n_words") - (count_of(F.element_at(parts, -1), " ") - 1) - size
        places.append(F.when(F.size(parts) > 1, F.struct((F.size(parts) - 1).cast("long").alias("n"), count_of(F.get(parts, F.lit(0)), " ").cast("long").alias("first"), last.cast("long").alias("last"), F.lit(label).alias("label"))))
    found = F.when(F.col("words").isNotNull(), unsuppressed(F.col("all"))).otherwise(F.array().cast("array<struct<a:int,b:int,priority:int,label:string,weight:double>>"))
    rows = rows.withColumn("base", F.when(F.col("words").isNotNull(), F.filter(F.array(*places), lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<n:bigint,first:bigint,last:bigint,label:string>>")))
    rows = rows.withColumn("all", F.when(F.col("words").isNotNull(), detections(F.col("words"), rules))).withColumn("detections", found)
    base_labels = F.transform("base", lambda x: x["label"])
    weights = F.concat(F.array(F.lit(0.0)), F.transform("detections", lambda x: x["weight"]), F.transform("base", lambda x: F.lit(BASE_WEIGHT)))
    return rows.select(
        F.col("key").alias(key), "n_words", F.aggregate("base", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_base"), F.array_min(F.transform("base", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["last"])).alias("last_word"), F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("detections", lambda x: x["label"])))), ",").alias("labels"), F.array_max(weights).alias("score"), "detections",
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in every whole text of documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")


def scan_sql(rules: list[Rule] | None = None) -> str:
    """The scan in DuckDB. Blanks between words are doubled there, so that neighbouring matches, which take one blank on
    each side instead of looking at it, don't touch."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    doubled = lambda x: x.replace("(?<= )", " ").replace("(?= )", " ").replace(" ?", "\0").strip(" ").replace(" ", "  ").replace("\0", "(?:  )?")
    named = ", ".join(f"({p}, {quoted(label)}, {quoted(k)}, {quoted(' ' + doubled(x) + ' ')}, {w})" for p, label, k, x, w in rules or signature_rules())
    phrases = ", ".join(f"({quoted(' ' + p.replace(' ', '  ') + ' ')}, {len(p.split())}, {quoted(label)})" for p, label in BASE.items())
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
d AS (SELECT doc_id, len(w) AS n, '  ' || array_to_string(w, '  ') || '  ' AS w FROM w),
p AS (SELECT * FROM (VALUES {phrases}) v(phrase, k, label)),
b AS (SELECT doc_id, label, n, k, string_split(w, phrase) AS parts FROM d JOIN p ON contains(w, phrase)),
c AS (SELECT doc_id, label, len(parts) - 1 AS places, len(list_filter(string_split(parts[1], ' '), lambda x: x <> '')) AS first, n - k - len(list_filter(string_split(parts[-1], ' '), lambda x: x <> '')) AS last FROM b),
r AS (SELECT * FROM (VALUES {named}) v(priority, label, keyword, expression, weight)),
h AS (SELECT doc_id, priority, label, weight, regexp_split_to_array(w, expression) AS parts, regexp_extract_all(w, expression) AS f FROM d JOIN r ON contains(w, keyword)),
i AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM h WHERE len(f) > 0),
x AS (SELECT doc_id, priority, label, weight, list_sum(list_transform(parts[1:i], lambda s: len(s))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda s: len(s))), 0) AS a, len(f[i]) AS m FROM i),
k AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM x e WHERE e.doc_id = x.doc_id AND e.a <= x.a AND e.a + e.m >= x.a + x.m AND e.priority < x.priority)),
l AS (SELECT doc_id, label, weight FROM k UNION ALL SELECT doc_id, label, {BASE_WEIGHT} FROM c),
y AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS score FROM l GROUP BY doc_id),
z AS (SELECT doc_id, sum(places) AS n_base, min(first) AS first_word, max(last) AS last_word, string_agg(label, ',' ORDER BY label) AS base_labels FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_words, CAST(coalesce(z.n_base, 0) AS BIGINT) AS n_base, CAST(z.first_word AS BIGINT) AS first_word, CAST(z.last_word AS BIGINT) AS last_word,
  coalesce(z.base_labels, '') AS base_labels, coalesce(y.labels, '') AS labels, CAST(coalesce(y.score, 0) AS DOUBLE) AS score FROM d LEFT JOIN y USING (doc_id) LEFT JOIN z USING (doc_id)
"""
