"""Signature rules of licences, in order. Of one line: tier, keyword, label and regex, parted by bars.

Regexes run over a text's words in lower case, one space apart, so that line breaks, comment marks and punctuation do
not matter (version 2.0 reads "2 0"). A rule is tried only where its keyword occurs; a regex holds its keyword in
every match. Tier 1 are identifiers and addresses, 2 are texts and notices, 3 are names with what tells them apart,
4 are bare names. A lower tier outranks a higher one; in a tier the earlier rule outranks the later.
"""

from __future__ import annotations

TEXT = r"""
1|identifier mit|mit|spdx license identifier mit(?! 0)
1|licenses mit|mit|(?:opensource|spdx) org licenses mit(?: license)?(?: php| html)?
2|hereby granted free of charge|mit|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
2|substantial portions of the software|mit|the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
2|mit license|mit|(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of the )?mit license
2|mit licence|mit|(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of the )?mit licence
3|mit x11|mit|(?:the )?mit x11 licen[cs]e
3|expat licen|mit|(?:the )?expat licen[cs]e
3|license mit|mit|license mit(?= (?:copyright|c|license|author|version)\b)
4|mit license|mit|mit license
4|mit licence|mit|mit licence
4|mit licensed|mit|mit licensed
1|identifier mit 0|mit-0|spdx license identifier mit 0
3|mit no attribution|mit-0|mit no attribution(?: license)?
1|identifier apache 2|apache-2.0|spdx license identifier apache 2 0
1|licenses license 2 0|apache-2.0|(?:www )?apache org licenses license 2 0(?: txt| html)?
1|licenses apache 2 0|apache-2.0|(?:opensource|spdx) org licenses apache 2 0
2|licensed under the apache license|apache-2.0|licensed under the apache license version 2(?: 0)?(?: the license you may not use this file except in compliance with the license)?
2|under the apache license|apache-2.0|(?:released|distributed|available|published|provided) under the apache license version 2(?: 0)?
2|under the apache 2|apache-2.0|(?:released|licensed|distributed|available|published|provided) under the apache 2(?: 0)?(?: license)?
3|apache license|apache-2.0|apache license(?: version| v)? ?v?2(?: 0)?
3|apache 2 0|apache-2.0|apache 2 0(?: license)?
3|apache software license|apache-2.0|apache software license(?: version)? 2(?: 0)?
3|apache license|apache-1.1|apache license(?: version)? 1 1
3|apache software license|apache-1.1|apache software license(?: version)? 1 1
3|apache license|apache-1.0|apache license(?: version)? 1 0
4|apache software license|apache|apache software license
4|apache license|apache|apache license
4|apache licence|apache|apache licence
4|apache licensed|apache|apache licensed
1|identifier gpl 3|gpl-3.0|spdx license identifier gpl 3 0(?: only)?(?! or later)
1|identifier gpl 3|gpl-3.0-or-later|spdx license identifier gpl 3 0 or later
1|identifier gpl 2|gpl-2.0|spdx license identifier gpl 2 0(?: only)?(?! or later)
1|identifier gpl 2|gpl-2.0-or-later|spdx license identifier gpl 2 0 or later
1|licenses gpl 3|gpl-3.0|gnu org licenses gpl 3 0(?: en)?(?: html| txt)?
1|licenses gpl 2|gpl-2.0|gnu org licenses (?:old licenses )?gpl 2 0(?: en)?(?: html| txt)?
2|either version 3 of the license|gpl-3.0-or-later|gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
2|either version 2 of the license|gpl-2.0-or-later|gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
2|general public license as published|gpl-1.0-or-later|gnu general public license as published by the free software foundation either version 1 or (?:at your option )?any later version
2|gnu general public license|gpl-2.0|gnu general public license version 2 as published by the free software foundation
2|gnu general public license|gpl-3.0|(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of the )?gnu general public license(?: gpl)? (?:version |v)?3(?: 0)?
2|gnu general public license|gpl-2.0|(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of the )?gnu general public license(?: gpl)? (?:version |v)?2(?: 0)?
2|gnu general public license along with|gpl|you should have received a copy of the gnu general public license along with this (?:program|file|library|package)
3|general public license|gpl-3.0|(?:gnu )?general public license(?: gpl)? (?:version |v)?3(?: 0)?
3|general public license|gpl-2.0|(?:gnu )?general public license(?: gpl)? (?:version |v)?2(?: 0)?
3|general public license|gpl-1.0|(?:gnu )?general public license(?: gpl)? version 1(?: 0)?
3|gplv3|gpl-3.0|(?:gnu )?gplv3
3|gplv2|gpl-2.0|(?:gnu )?gplv2
3|gpl v3|gpl-3.0|(?:gnu )?gpl v3(?: 0)?
3|gpl v2|gpl-2.0|(?:gnu )?gpl v2(?: 0)?
3|gpl 3 0|gpl-3.0|gpl 3 0
3|gpl 2 0|gpl-2.0|gpl 2 0
3|gpl version 3|gpl-3.0|gpl version 3
3|gpl version 2|gpl-2.0|gpl version 2
3|classpath exception|gpl-2.0-classpath|(?:with (?:the )?)?classpath exception
4|gnu general public license|gpl|gnu general public license
4|general public license|gpl|general public license
4|gnu gpl|gpl|gnu gpl
4|general public licence|gpl|(?:gnu )?general public licence
1|identifier lgpl 3|lgpl-3.0|spdx license identifier lgpl 3 0(?: only| or later)?
1|identifier lgpl 2 1|lgpl-2.1|spdx license identifier lgpl 2 1(?: only| or later)?
1|identifier lgpl 2 0|lgpl-2.0|spdx license identifier lgpl 2 0(?: only| or later)?
1|licenses lgpl 3|lgpl-3.0|gnu org licenses lgpl 3 0(?: en)?(?: html| txt)?
1|licenses lgpl 2 1|lgpl-2.1|gnu org licenses (?:old licenses )?lgpl 2 1(?: en)?(?: html| txt)?
2|gnu lesser general public license|lgpl-2.1-or-later|gnu lesser general public license as published by the free software foundation either version 2 1 of the license or (?:at your option )?any later version
2|gnu lesser general public license|lgpl-3.0-or-later|gnu lesser general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
2|gnu library general public license|lgpl-2.0-or-later|gnu library general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
3|lesser general public license|lgpl-3.0|(?:gnu )?lesser general public license(?: lgpl)? (?:version |v)?3(?: 0)?
3|lesser general public license|lgpl-2.1|(?:gnu )?lesser general public license(?: lgpl)? (?:version |v)?2 1
3|library general public license|lgpl-2.0|(?:gnu )?library general public license(?: lgpl)?(?: version 2(?: 0)?)?
3|lgplv3|lgpl-3.0|(?:gnu )?lgplv3
3|lgplv2|lgpl-2.1|(?:gnu )?lgplv2(?: 1)?
3|lgpl 3 0|lgpl-3.0|lgpl 3 0
3|lgpl 2 1|lgpl-2.1|lgpl 2 1
4|lesser general public license|lgpl|(?:gnu )?lesser general public license
4|gnu lgpl|lgpl|gnu lgpl
1|identifier agpl 3|agpl-3.0|spdx license identifier agpl 3 0(?: only| or later)?
1|licenses agpl 3|agpl-3.0|gnu org licenses agpl 3 0(?: en)?(?: html| txt)?
2|gnu affero general public license|agpl-3.0-or-later|gnu affero general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
3|affero general public license|agpl-3.0|(?:gnu )?affero general public license(?: agpl)? (?:version |v)?3(?: 0)?
3|affero general public license|agpl-1.0|affero general public license version 1
3|agplv3|agpl-3.0|(?:gnu )?agplv3
3|agpl 3 0|agpl-3.0|agpl 3 0
4|affero general public license|agpl|(?:gnu )?affero general public license
1|identifier bsd 3|bsd-3-clause|spdx license identifier bsd 3 clause
1|identifier bsd 2|bsd-2-clause|spdx license identifier bsd 2 clause
1|identifier bsd 4|bsd-4-clause|spdx license identifier bsd 4 clause
1|identifier 0bsd|0bsd|spdx license identifier 0bsd
1|licenses bsd 3|bsd-3-clause|opensource org licenses bsd 3 clause
1|licenses bsd 2|bsd-2-clause|opensource org licenses bsd 2 clause
2|may be used to endorse or promote|bsd-3-clause|neither the name of (?:[^ ]+ ){1,12}?nor the names of (?:its|any|their) contributors may be used to endorse or promote products derived from this software
2|redistribution and use in source and binary|bsd|redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
2|mentioning features or use of this software|bsd-4-clause|all advertising materials mentioning features or use of this software must display the following acknowledge?ment
2|is hereby granted the above copyright|0bsd|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the above copyright
2|bsd license|bsd|(?:released|licensed|distributed|available|published|provided) under (?:the |a )?(?:terms of the )?bsd license
3|3 clause bsd|bsd-3-clause|3 clause bsd(?: licen[cs]e)?
3|bsd 3 clause|bsd-3-clause|bsd 3 clause(?: licen[cs]e)?
3|new bsd|bsd-3-clause|new bsd licen[cs]e
3|modified bsd|bsd-3-clause|modified bsd licen[cs]e
3|2 clause bsd|bsd-2-clause|2 clause bsd(?: licen[cs]e)?
3|bsd 2 clause|bsd-2-clause|bsd 2 clause(?: licen[cs]e)?
3|simplified bsd|bsd-2-clause|simplified bsd licen[cs]e
3|freebsd license|bsd-2-clause|freebsd license
3|4 clause bsd|bsd-4-clause|4 clause bsd(?: licen[cs]e)?
3|zero clause bsd|0bsd|(?:bsd )?zero clause bsd(?: licen[cs]e)?
4|bsd license|bsd|bsd license
4|bsd licence|bsd|bsd licence
4|bsd style|bsd|bsd style licen[cs]e
1|identifier mpl 2|mpl-2.0|spdx license identifier mpl 2 0
1|identifier mpl 1|mpl-1.1|spdx license identifier mpl 1 1
1|mozilla org mpl 2|mpl-2.0|mozilla org mpl 2 0
2|terms of the mozilla public license|mpl-2.0|this source code form is subject to the terms of the mozilla public license v 2 0
2|subject to the mozilla public license|mpl-1.1|the contents of this file are subject to the mozilla public license version 1 1
3|mozilla public license|mpl-2.0|mozilla public license(?: version| v)? 2(?: 0)?
3|mozilla public license|mpl-1.1|mozilla public license(?: version| v)? 1 1
3|mozilla public license|mpl-1.0|mozilla public license(?: version| v)? 1 0
3|mpl 2 0|mpl-2.0|mpl 2 0
4|mozilla public license|mpl|mozilla public license
1|identifier epl 2|epl-2.0|spdx license identifier epl 2 0
1|identifier epl 1|epl-1.0|spdx license identifier epl 1 0
1|eclipse org legal epl|epl|eclipse org legal epl(?: v10| 2 0| v20)?(?: html)?
2|terms of the eclipse public license|epl|(?:accompanying materials are )?made available under the terms of the eclipse public license
3|eclipse public license|epl-2.0|eclipse public license(?: version| v)? 2(?: 0)?
3|eclipse public license|epl-1.0|eclipse public license(?: version| v)? 1(?: 0)?
3|eclipse distribution license|bsd-3-clause|eclipse distribution license(?: version| v)?(?: 1 0)?
4|eclipse public license|epl|eclipse public license
1|identifier cddl|cddl-1.0|spdx license identifier cddl 1 [01]
3|common development and distribution license|cddl-1.1|common development and distribution license(?: cddl)?(?: version| v)? 1 1
3|common development and distribution license|cddl-1.0|common development and distribution license(?: cddl)?(?: version| v)? 1 0
4|common development and distribution license|cddl|common development and distribution license
1|identifier isc|isc|spdx license identifier isc
2|with or without fee is hereby granted provided|isc|permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
4|isc license|isc|isc license
1|identifier zlib|zlib|spdx license identifier zlib
2|provided as is without any express|zlib|this software is provided as is without any express or implied warranty in no event will the authors be held liable
2|must not be misrepresented|zlib|the origin of this software must not be misrepresented
4|zlib license|zlib|(?:the )?zlib license
3|zlib libpng|zlib|zlib libpng licen[cs]e
1|identifier bsl|bsl-1.0|spdx license identifier bsl 1 0
1|license 1 0 txt|bsl-1.0|boost org license 1 0 txt
2|boost software license|bsl-1.0|distributed under the boost software license version 1 0
4|boost software license|bsl-1.0|boost software license(?: version)?(?: 1 0)?
1|identifier unlicense|unlicense|spdx license identifier unlicense
1|unlicense org|unlicense|unlicense org
2|unencumbered software released|unlicense|this is free and unencumbered software released into the public domain
4|the unlicense|unlicense|the unlicense
1|identifier wtfpl|wtfpl|spdx license identifier wtfpl
3|you want to public license|wtfpl|do what the f[^ ]{0,6} you want to public license
4|wtfpl|wtfpl|wtfpl
1|identifier cc0|cc0-1.0|spdx license identifier cc0 1 0
1|publicdomain zero|cc0-1.0|creativecommons org publicdomain zero 1 0
2|has waived all copyright|cc0-1.0|has waived all copyright and related or neighbou?ring rights
3|cc0|cc0-1.0|(?:creative commons )?cc0(?: 1 0)?(?: universal)?
1|publicdomain mark|public-domain|creativecommons org publicdomain mark 1 0
2|public domain|public-domain|(?:released|placed|dedicated) (?:in|into|to) the public domain
4|public domain|public-domain|public domain
1|identifier cc by nc sa|cc-by-nc-sa-4.0|spdx license identifier cc by nc sa 4 0
1|identifier cc by nc nd|cc-by-nc-nd-4.0|spdx license identifier cc by nc nd 4 0
1|identifier cc by nc 4|cc-by-nc-4.0|spdx license identifier cc by nc 4 0
1|identifier cc by nd|cc-by-nd-4.0|spdx license identifier cc by nd 4 0
1|identifier cc by sa|cc-by-sa-4.0|spdx license identifier cc by sa 4 0
1|identifier cc by 4|cc-by-4.0|spdx license identifier cc by 4 0
1|licenses by nc sa 4|cc-by-nc-sa-4.0|creativecommons org licenses by nc sa 4 0
1|licenses by nc sa 3|cc-by-nc-sa-3.0|creativecommons org licenses by nc sa 3 0
1|licenses by nc nd 4|cc-by-nc-nd-4.0|creativecommons org licenses by nc nd 4 0
1|licenses by nc nd 3|cc-by-nc-nd-3.0|creativecommons org licenses by nc nd 3 0
1|licenses by nc 4|cc-by-nc-4.0|creativecommons org licenses by nc 4 0
1|licenses by nc 3|cc-by-nc-3.0|creativecommons org licenses by nc 3 0
1|licenses by nd 4|cc-by-nd-4.0|creativecommons org licenses by nd 4 0
1|licenses by nd 3|cc-by-nd-3.0|creativecommons org licenses by nd 3 0
1|licenses by sa 4|cc-by-sa-4.0|creativecommons org licenses by sa 4 0
1|licenses by sa 3|cc-by-sa-3.0|creativecommons org licenses by sa 3 0
1|licenses by 4|cc-by-4.0|creativecommons org licenses by 4 0
1|licenses by 3|cc-by-3.0|creativecommons org licenses by 3 0
3|cc by nc sa 4|cc-by-nc-sa-4.0|cc by nc sa 4 0
3|cc by nc sa 3|cc-by-nc-sa-3.0|cc by nc sa 3 0
3|cc by nc nd 4|cc-by-nc-nd-4.0|cc by nc nd 4 0
3|cc by nc nd 3|cc-by-nc-nd-3.0|cc by nc nd 3 0
3|cc by nc 4|cc-by-nc-4.0|cc by nc 4 0
3|cc by nc 3|cc-by-nc-3.0|cc by nc 3 0
3|cc by nd 4|cc-by-nd-4.0|cc by nd 4 0
3|cc by nd 3|cc-by-nd-3.0|cc by nd 3 0
3|cc by sa 4|cc-by-sa-4.0|cc by sa 4 0
3|cc by sa 3|cc-by-sa-3.0|cc by sa 3 0
3|cc by 4|cc-by-4.0|cc by 4 0
3|cc by 3|cc-by-3.0|cc by 3 0
3|attribution noncommercial sharealike|cc-by-nc-sa|(?:creative commons )?attribution noncommercial sharealike(?: [1-4] [05])?(?: international| unported)?
3|attribution noncommercial noderiv|cc-by-nc-nd|(?:creative commons )?attribution noncommercial noderiv[a-z]*(?: [1-4] [05])?(?: international| unported)?
3|attribution noncommercial|cc-by-nc|(?:creative commons )?attribution noncommercial(?: [1-4] [05])?(?: international| unported)?
3|attribution noderiv|cc-by-nd|(?:creative commons )?attribution noderiv[a-z]*(?: [1-4] [05])?(?: international| unported)?
3|attribution sharealike|cc-by-sa|(?:creative commons )?attribution sharealike(?: [1-4] [05])?(?: international| unported)?
3|creative commons attribution|cc-by|creative commons attribution(?: [1-4] [05])?(?: international| unported)?
4|cc by nc sa|cc-by-nc-sa|cc by nc sa
4|cc by nc nd|cc-by-nc-nd|cc by nc nd
4|cc by nc|cc-by-nc|cc by nc
4|cc by sa|cc-by-sa|cc by sa
4|cc by nd|cc-by-nd|cc by nd
4|creative commons|cc|(?:a )?creative commons licen[cs]e
1|identifier python 2|psf-2.0|spdx license identifier python 2 0
2|this psf license agreement|psf-2.0|this psf license agreement
3|python software foundation license|psf-2.0|python software foundation license(?: version 2)?
4|psf license|psf-2.0|psf license
1|identifier artistic|artistic-2.0|spdx license identifier artistic 2 0
3|artistic license|artistic-2.0|artistic license 2(?: 0)?
4|artistic license|artistic|artistic license
4|same terms as perl|perl|(?:under )?the same terms as perl(?: itself)?
1|identifier ofl|ofl-1.1|spdx license identifier ofl 1 1
1|scripts sil org ofl|ofl-1.1|scripts sil org ofl
3|sil open font license|ofl-1.1|sil open font license(?: version)?(?: 1 1)?
4|open font license|ofl-1.1|open font license
1|identifier eupl|eupl-1.2|spdx license identifier eupl 1 2
3|european union public licen|eupl|european union public licen[cs]e(?: v| version)?(?: 1 [12])?
1|identifier ms pl|ms-pl|spdx license identifier ms pl
4|microsoft public license|ms-pl|microsoft public license
4|microsoft reciprocal license|ms-rl|microsoft reciprocal license
1|identifier cpl|cpl-1.0|spdx license identifier cpl 1 0
4|common public license|cpl-1.0|common public license(?: version)?(?: 1 0)?
4|ibm public license|ipl-1.0|ibm public license(?: version)?(?: 1 0)?
4|apple public source license|apsl-2.0|apple public source license(?: version)?(?: [12] [0-2])?
4|sun public license|spl-1.0|sun public license(?: version)?(?: 1 0)?
4|academic free license|afl-3.0|academic free license(?: version| v)?(?: [123] [01])?
4|open software license|osl-3.0|open software license(?: version| v)?(?: [123] [01])?
4|q public license|qpl-1.0|q public license(?: version)?(?: 1 0)?
4|reciprocal public license|rpl-1.5|reciprocal public license(?: version)?(?: 1 [15])?
4|server side public license|sspl-1.0|server side public license(?: version| v)?(?: 1)?
4|business source license|busl-1.1|business source license(?: version)?(?: 1 1)?
4|elastic license|elastic-2.0|elastic license(?: version)?(?: 2 0)?
4|commons clause|commons-clause|commons clause(?: license condition)?
4|gnu free documentation license|gfdl|gnu free documentation license(?: version)?(?: 1 [123])?
4|open database license|odbl-1.0|(?:open data commons )?open database license(?: odbl)?
4|open data commons attribution|odc-by-1.0|open data commons attribution license
4|community data license|cdla|community data license agreement(?: permissive| sharing)?(?: version)?(?: [12] 0)?
4|beerware|beerware|beerware(?: license)?
4|openssl license|openssl|openssl license
4|php license|php-3.01|php license(?: version)?(?: 3 0[01])?
4|postgresql license|postgresql|postgresql license
4|ruby license|ruby|ruby license
4|vim license|vim|vim license
4|w3c software|w3c|w3c software (?:notice and )?(?:and document )?license
4|ncsa open source license|ncsa|(?:university of illinois )?ncsa open source license
4|zope public license|zpl-2.1|zope public license(?: version)?(?: 2 [01])?
4|sleepycat license|sleepycat|sleepycat license
4|libpng license|libpng|libpng license
4|curl license|curl|curl license
4|openrail|openrail|(?:bigscience |creativeml )?openrail(?: m)?(?: license)?
4|community license|llama|llama(?: [23])? community license(?: agreement)?
2|all rights reserved|proprietary|copyright (?:c )?(?:[0-9]{4} ){1,4}(?:by )?(?:[^ ]+ ){1,8}?all rights reserved
3|proprietary and confidential|proprietary|proprietary and confidential
"""

#: Parts of words, of which every keyword holds one: a text without any of them has no licence.
STEMS = (
    "licen", "identifier", "granted", "apache", "gpl", "bsd", "commons", "attribution", "domain", "mozilla", "mpl 2 0", "eclipse", "x11", "portions", "classpath",
    "promote", "redistribution", "mentioning", "express", "misrepresented", "unencumbered", "wtfpl", "waived", "cc0", "perl", "scripts", "beerware", "openrail",
    "reserved", "proprietary", "zlib", "w3c", "cc by",
)


def rules() -> list[tuple[int, str, str, str]]:
    """(tier, keyword, label, regex) in order."""
    parts = [line.split("|", 3) for line in TEXT.strip().splitlines()]
    return [(int(tier), keyword, label, regex) for tier, keyword, label, regex in parts]
