"""Signature rules of the license scan.

One rule a line: label; priority; keyword; pattern. Priorities: 1 a grant or
notice, 2 an identifier line, 3 a name with a version, 4 an address, 5 a bare
name. Patterns run over lower-case words with one space between them; every
match of a pattern holds its keyword. Earlier rules win among equals.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str


_TABLE = r"""
MIT; 1; permission; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction
MIT; 1; license; (?:released|distributed|licensed|available|provided) under (?:the )?(?:terms of the )?(?:expat )?mit license
MIT; 2; spdx; spdx license identifier mit
MIT; 3; license; mit license (?:version )?x11
MIT; 4; license; opensource org licenses? mit(?: license(?: php)?)?
MIT; 5; license; (?:the )?mit license
MIT; 5; license; mit x11 license|x11 license|expat license
MIT; 5; license; license mit
MIT-0; 1; license; mit no attribution license
MIT-0; 2; spdx; spdx license identifier mit 0
MIT-CMU; 1; permission; permission to use copy modify and distribute this software and its (?:associated )?documentation for any purpose and without fee is hereby granted
ISC; 1; permission; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
ISC; 1; license; (?:released|distributed|licensed) under (?:the )?isc license
ISC; 2; spdx; spdx license identifier isc
ISC; 4; license; opensource org licenses? isc(?: license(?: txt)?)?
ISC; 5; license; (?:the )?isc license
0BSD; 1; license; zero clause bsd license|bsd zero clause license
0BSD; 2; spdx; spdx license identifier 0bsd
Apache-2.0; 1; apache; licensed (?:to you )?under the apache license version 2(?: 0)?(?: the license)?
Apache-2.0; 1; license; you may not use this file except in compliance with the license you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0
Apache-2.0; 1; apache; (?:released|distributed|available) under (?:the )?(?:terms of the )?apache (?:software )?license(?: version)? 2(?: 0)?
Apache-2.0; 2; spdx; spdx license identifier apache 2 0
Apache-2.0; 3; apache; apache (?:software )?license(?: version| v)? ?2(?: 0)?
Apache-2.0; 3; apache; apache 2(?: 0)? licen[cs]ed?
Apache-2.0; 4; apache; apache org licenses license 2 0(?: txt| html)?
Apache-2.0; 4; apache; opensource org licenses? apache 2 0
Apache-1.1; 3; apache; apache (?:software )?license(?: version)? 1 1
Apache-1.1; 2; spdx; spdx license identifier apache 1 1
Apache-1.0; 3; apache; apache (?:software )?license(?: version)? 1 0
Apache; 5; apache; apache (?:software )?license
BSD-2-Clause; 1; redistribut; redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by
BSD-2-Clause; 1; bsd; (?:released|distributed|licensed) under (?:the )?(?:simplified|freebsd|2 clause) bsd license
BSD-2-Clause; 2; spdx; spdx license identifier bsd 2 clause(?: patent)?
BSD-2-Clause; 3; bsd; bsd 2 clause(?: license)?|2 clause bsd(?: license)?|two clause bsd(?: license)?
BSD-2-Clause; 4; bsd; opensource org licenses? bsd 2 clause
BSD-2-Clause; 5; bsd; simplified bsd license|freebsd license
BSD-3-Clause; 1; contributors; neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products derived from this software
BSD; 1; redistribut; redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
BSD-3-Clause; 1; bsd; (?:released|distributed|licensed) under (?:the )?(?:new|modified|revised|3 clause) bsd license
BSD-3-Clause; 2; spdx; spdx license identifier bsd 3 clause(?: clear)?
BSD-3-Clause; 3; bsd; bsd 3 clause(?: license)?|3 clause bsd(?: license)?|three clause bsd(?: license)?
BSD-3-Clause; 4; bsd; opensource org licenses? bsd 3 clause
BSD-3-Clause; 5; bsd; (?:new|modified|revised) bsd license
BSD-4-Clause; 1; advertising materials; all advertising materials mentioning features or use of this software must display the following acknowledge?ment
BSD-4-Clause; 2; spdx; spdx license identifier bsd 4 clause(?: uc)?
BSD-4-Clause; 3; bsd; bsd 4 clause(?: license)?|original bsd license|four clause bsd(?: license)?
BSD; 1; bsd; use of this source code is governed by a bsd style license
BSD; 4; bsd; opensource org licenses? bsd license(?: php)?
BSD; 5; bsd; (?:the )?bsd(?: style)? license
GPL-3.0-or-later; 1; general public; redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
GPL-2.0-or-later; 1; general public; redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
GPL-3.0-only; 1; general public; under the terms of (?:the )?gnu general public license version 3(?: 0)? only
GPL-2.0-or-later; 1; general public; under the terms of (?:the )?gnu general public license version 2(?: 0)?(?: as published by the free software foundation)?(?: either version 2(?: 0)?(?: of the license)?)? or (?:at your option )?any later version
GPL-2.0-only; 1; general public; under the terms of (?:the )?gnu general public license version 2(?: 0)?(?: only| as published by the free software foundation)(?! either| or at your option| or any later)
GPL-3.0; 1; general public; (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu general public license(?: as published by the free software foundation)? (?:version|v) ?3(?: 0)?
GPL-2.0; 1; general public; (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu general public license(?: as published by the free software foundation)? (?:version|v) ?2(?: 0)?
GPL-3.0-or-later; 2; spdx; spdx license identifier gpl 3 0 or later
GPL-3.0-only; 2; spdx; spdx license identifier gpl 3 0(?: only)?
GPL-2.0-or-later; 2; spdx; spdx license identifier gpl 2 0 or later
GPL-2.0-only; 2; spdx; spdx license identifier gpl 2 0(?: only)?
GPL-1.0-or-later; 2; spdx; spdx license identifier gpl 1 0 or later
GPL-3.0; 3; general public; (?:gnu )?general public license (?:version |v ?)?3(?: 0)?
GPL-2.0; 3; general public; (?:gnu )?general public license (?:version |v ?)?2(?: 0)?
GPL-1.0; 3; general public; (?:gnu )?general public license (?:version |v ?)?1(?: 0)?
GPL-3.0; 3; gpl; gnu gpl (?:version |v ?)?3(?: 0)?|gplv3(?: 0)?|gpl 3(?: 0)?|gpl version 3
GPL-2.0; 3; gpl; gnu gpl (?:version |v ?)?2(?: 0)?|gplv2(?: 0)?|gpl 2(?: 0)?|gpl version 2
GPL-3.0; 4; gpl; gnu org licenses gpl 3 0(?: en)?(?: html| txt)?
GPL-2.0; 4; gpl; gnu org licenses (?:old licenses )?gpl 2 0(?: en)?(?: html| txt)?
GPL; 4; gpl; gnu org (?:copyleft|licenses) gpl(?: html| txt)?
GPL; 5; general public; gnu general public license
GPL; 5; gpl; gnu gpl|gpl licen[cs]ed?
GPL-classpath-exception; 1; classpath; linking this library statically or dynamically with other modules(?: .{0,200}?)? classpath exception|classpath exception
LGPL-3.0-or-later; 1; lesser general; under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
LGPL-2.1-or-later; 1; lesser general; under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
LGPL-3.0; 1; lesser general; (?:licensed|released|distributed) under (?:the )?(?:terms of the )?gnu lesser general public license (?:version|v) ?3(?: 0)?
LGPL-2.1; 1; lesser general; (?:licensed|released|distributed) under (?:the )?(?:terms of the )?gnu lesser general public license (?:version|v) ?2 1
LGPL-3.0; 2; spdx; spdx license identifier lgpl 3 0(?: only| or later)?
LGPL-2.1; 2; spdx; spdx license identifier lgpl 2 1(?: only| or later)?
LGPL-2.0; 2; spdx; spdx license identifier lgpl 2 0(?: only| or later)?
LGPL-3.0; 3; lesser general; (?:gnu )?lesser general public license (?:version |v ?)?3(?: 0)?
LGPL-2.1; 3; lesser general; (?:gnu )?lesser general public license (?:version |v ?)?2 1
LGPL-2.0; 3; library general; (?:gnu )?library general public license(?: (?:version |v ?)?2(?: 0)?)?
LGPL-3.0; 3; lgpl; lgpl ?v?3(?: 0)?|lgpl version 3
LGPL-2.1; 3; lgpl; lgpl ?v?2 1|lgpl version 2 1
LGPL-3.0; 4; lgpl; gnu org licenses lgpl 3 0(?: en)?(?: html| txt)?
LGPL; 4; gnu org; gnu org (?:copyleft|licenses) (?:lesser|lgpl)(?: html| txt)?
LGPL; 5; lesser general; (?:gnu )?lesser general public license
LGPL; 5; lgpl; gnu lgpl|lgpl licen[cs]ed?
AGPL-3.0-or-later; 1; affero general; under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
AGPL-3.0; 1; affero general; (?:licensed|released|distributed) under (?:the )?(?:terms of the )?gnu affero general public license (?:version|v) ?3(?: 0)?
AGPL-3.0; 2; spdx; spdx license identifier agpl 3 0(?: only| or later)?
AGPL-3.0; 3; affero general; (?:gnu )?affero general public license (?:version |v ?)?3(?: 0)?
AGPL-3.0; 3; agpl; gnu agpl ?v?3(?: 0)?|agplv3(?: 0)?|agpl 3(?: 0)?
AGPL-3.0; 4; agpl; gnu org licenses agpl 3 0(?: en)?(?: html| txt)?
AGPL; 5; affero general; (?:gnu )?affero general public license
AGPL; 5; agpl; gnu agpl|agpl licen[cs]ed?
GFDL-1.3; 1; free documentation; under the terms of the gnu free documentation license version 1 3
GFDL-1.3; 2; spdx; spdx license identifier gfdl 1 3(?: only| or later)?
GFDL-1.2; 3; free documentation; (?:gnu )?free documentation license (?:version |v ?)?1 2
GFDL-1.3; 3; free documentation; (?:gnu )?free documentation license (?:version |v ?)?1 3
GFDL; 5; free documentation; (?:gnu )?free documentation license
MPL-2.0; 1; mozilla; this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0
MPL-2.0; 1; mozilla; (?:licensed|released|distributed) under (?:the )?mozilla public license(?: version| v)? ?2(?: 0)?
MPL-2.0; 2; spdx; spdx license identifier mpl 2 0(?: no copyleft exception)?
MPL-2.0; 3; mozilla; mozilla public license(?: version| v)? ?2(?: 0)?
MPL-2.0; 3; mpl; mpl ?v?2(?: 0)?
MPL-2.0; 4; mozilla; mozilla org mpl 2 0
MPL-1.1; 1; mozilla; the contents of this file are subject to the mozilla public license version 1 1
MPL-1.1; 2; spdx; spdx license identifier mpl 1 1
MPL-1.1; 3; mozilla; mozilla public license(?: version| v)? ?1 1
MPL; 5; mozilla; mozilla public license
EPL-2.0; 1; eclipse; (?:made available|licensed|released) under the terms of the eclipse public license (?:v|version) ?2(?: 0)?
EPL-1.0; 1; eclipse; (?:made available|licensed|released) under the terms of the eclipse public license (?:v|version) ?1(?: 0)?
EPL-2.0; 2; spdx; spdx license identifier epl 2 0
EPL-1.0; 2; spdx; spdx license identifier epl 1 0
EPL-2.0; 3; eclipse; eclipse public license(?: version| v)? ?2(?: 0)?
EPL-1.0; 3; eclipse; eclipse public license(?: version| v)? ?1(?: 0)?
EPL-2.0; 4; eclipse; eclipse org legal epl (?:v20|2 0)(?: html)?
EPL-1.0; 4; eclipse; eclipse org legal epl v10(?: html)?
EPL; 5; eclipse; eclipse public license
EDL-1.0; 3; eclipse; eclipse distribution license(?: version| v)? ?1(?: 0)?
CDDL-1.0; 1; development and distribution; subject to the terms of the common development and distribution license
CDDL-1.0; 2; spdx; spdx license identifier cddl 1 0
CDDL-1.1; 2; spdx; spdx license identifier cddl 1 1
CDDL-1.1; 3; development and distribution; common development and distribution license(?: cddl)?(?: version| v)? ?1 1
CDDL-1.0; 3; development and distribution; common development and distribution license(?: cddl)?(?: version| v)? ?1 0
CDDL; 5; development and distribution; common development and distribution license
CPL-1.0; 2; spdx; spdx license identifier cpl 1 0
CPL-1.0; 3; license; common public license(?: version| v)? ?1(?: 0)?
EUPL-1.2; 1; eupl; licensed under the eupl(?: version| v)? ?1 2
EUPL-1.2; 1; european union; (?:licensed under the )?european union public licen[cs]e(?: version| v)? ?1 2
EUPL-1.2; 2; spdx; spdx license identifier eupl 1 2
EUPL-1.1; 3; european union; european union public licen[cs]e(?: version| v)? ?1 1
EUPL; 5; european union; european union public licen[cs]e
CC0-1.0; 1; creative commons; creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?(?: public domain dedication)?
CC0-1.0; 1; public domain; cc0 1 0 universal(?: cc0 1 0)? public domain dedication
CC0-1.0; 2; spdx; spdx license identifier cc0 1 0
CC0-1.0; 4; creativecommons; creativecommons org publicdomain zero 1 0(?: legalcode)?
CC-BY-4.0; 1; creative commons; creative commons attribution 4 0(?: international)?(?: public)? license
CC-BY-4.0; 2; spdx; spdx license identifier cc by 4 0
CC-BY-4.0; 3; cc by; (?:licensed under |license )?cc by 4 0
CC-BY-4.0; 4; creativecommons; creativecommons org licenses by 4 0(?: legalcode| deed)?
CC-BY-3.0; 1; creative commons; creative commons attribution 3 0(?: unported| united states)?(?: license)?
CC-BY-3.0; 2; spdx; spdx license identifier cc by 3 0
CC-BY-3.0; 3; cc by; (?:licensed under |license )?cc by 3 0
CC-BY-3.0; 4; creativecommons; creativecommons org licenses by 3 0(?: us| legalcode)?
CC-BY-2.5; 3; cc by; cc by 2 5
CC-BY-2.0; 3; cc by; cc by 2 0
CC-BY-2.0; 4; creativecommons; creativecommons org licenses by 2 0
CC-BY-SA-4.0; 1; creative commons; creative commons attribution share ?alike 4 0(?: international)?(?: public)?(?: license)?
CC-BY-SA-4.0; 2; spdx; spdx license identifier cc by sa 4 0
CC-BY-SA-4.0; 3; cc by; (?:licensed under |license )?cc by sa 4 0
CC-BY-SA-4.0; 4; creativecommons; creativecommons org licenses by sa 4 0(?: legalcode| deed)?
CC-BY-SA-3.0; 1; creative commons; creative commons attribution share ?alike 3 0(?: unported)?(?: license)?
CC-BY-SA-3.0; 2; spdx; spdx license identifier cc by sa 3 0
CC-BY-SA-3.0; 3; cc by; (?:licensed under |license )?cc by sa 3 0
CC-BY-SA-3.0; 4; creativecommons; creativecommons org licenses by sa 3 0
CC-BY-NC-4.0; 1; creative commons; creative commons attribution non ?commercial 4 0(?: international)?(?: public)?(?: license)?
CC-BY-NC-4.0; 1; cc by; (?:licensed|released|available) under (?:the )?(?:a )?cc by nc 4 0
CC-BY-NC-4.0; 2; spdx; spdx license identifier cc by nc 4 0
CC-BY-NC-4.0; 3; cc by; cc by nc 4 0
CC-BY-NC-4.0; 4; creativecommons; creativecommons org licenses by nc 4 0(?: legalcode| deed)?
CC-BY-NC-3.0; 3; cc by; cc by nc 3 0
CC-BY-NC-3.0; 4; creativecommons; creativecommons org licenses by nc 3 0
CC-BY-NC-SA-4.0; 1; creative commons; creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: license)?
CC-BY-NC-SA-4.0; 2; spdx; spdx license identifier cc by nc sa 4 0
CC-BY-NC-SA-4.0; 3; cc by; (?:licensed under )?cc by nc sa 4 0
CC-BY-NC-SA-4.0; 4; creativecommons; creativecommons org licenses by nc sa 4 0
CC-BY-NC-SA-3.0; 3; cc by; (?:licensed under )?cc by nc sa 3 0
CC-BY-NC-SA-3.0; 4; creativecommons; creativecommons org licenses by nc sa 3 0
CC-BY-NC-ND-4.0; 1; creative commons; creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: license)?
CC-BY-NC-ND-4.0; 2; spdx; spdx license identifier cc by nc nd 4 0
CC-BY-NC-ND-4.0; 3; cc by; (?:licensed under )?cc by nc nd 4 0
CC-BY-NC-ND-4.0; 4; creativecommons; creativecommons org licenses by nc nd 4 0
CC-BY-NC-ND-3.0; 3; cc by; (?:licensed under )?cc by nc nd 3 0
CC-BY-ND-4.0; 1; creative commons; creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: license)?
CC-BY-ND-4.0; 2; spdx; spdx license identifier cc by nd 4 0
CC-BY-ND-4.0; 3; cc by; (?:licensed under )?cc by nd 4 0
CC-BY-ND-4.0; 4; creativecommons; creativecommons org licenses by nd 4 0
CC-BY-ND-3.0; 3; cc by; cc by nd 3 0
CC; 5; creative commons; creative commons(?: license| attribution)?
PDDL-1.0; 3; public domain; public domain dedication and license
Public-Domain; 1; public domain; (?:released|dedicated|placed) (?:in|into|to) the public domain
Public-Domain; 1; public domain; (?:this|the) (?:work|software|text|file|code) is (?:hereby )?in the public domain
Public-Domain; 5; public domain; public domain
Unlicense; 1; public domain; this is free and unencumbered software released into the public domain
Unlicense; 2; spdx; spdx license identifier unlicense
Unlicense; 4; unlicense; unlicense org
Unlicense; 5; unlicense; the unlicense
WTFPL; 1; license; do what the fuck you want to public license
WTFPL; 2; spdx; spdx license identifier wtfpl
Zlib; 1; warranty; this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
Zlib; 2; spdx; spdx license identifier zlib(?: acknowledgement)?
Zlib; 5; license; zlib (?:libpng )?license
BSL-1.0; 1; license; distributed under the boost software license version 1 0
BSL-1.0; 2; spdx; spdx license identifier bsl 1 0
BSL-1.0; 4; license; boost org license 1 0(?: txt)?
BSL-1.0; 5; license; boost software license
BUSL-1.1; 2; spdx; spdx license identifier busl 1 1
BUSL-1.1; 3; license; business source license(?: version)? 1 1
BUSL-1.1; 5; license; business source license
SSPL-1.0; 2; spdx; spdx license identifier sspl 1 0
SSPL-1.0; 5; license; server side public license
Elastic-2.0; 3; license; elastic license(?: version)? 2(?: 0)?
Elastic-2.0; 5; license; elastic license
Artistic-2.0; 2; spdx; spdx license identifier artistic 2 0
Artistic-2.0; 3; license; artistic license(?: version)? 2(?: 0)?
Artistic-1.0; 2; spdx; spdx license identifier artistic 1 0(?: perl)?
Artistic-1.0; 3; license; artistic license(?: version)? 1(?: 0)?
Artistic; 5; license; (?:perl )?artistic license
Perl; 1; redistribut; you can redistribute it and or modify it under the same terms as perl itself
PSF-2.0; 2; spdx; spdx license identifier (?:psf|python) 2 0
PSF-2.0; 5; license; python software foundation license(?: version 2)?
Ruby; 2; spdx; spdx license identifier ruby
Ruby; 5; license; ruby license
PHP-3.01; 1; license; subject to version 3 01 of the php license
PHP-3.01; 2; spdx; spdx license identifier php 3 01
PHP; 5; license; php license(?: version)?(?: 3(?: 01)?)?
OFL-1.1; 1; license; licensed under the sil open font license(?: version)? 1 1
OFL-1.1; 2; spdx; spdx license identifier ofl 1 1
OFL; 5; license; (?:sil )?open font license
ODbL-1.0; 1; license; available under the open database license
ODbL-1.0; 2; spdx; spdx license identifier odbl 1 0
ODbL-1.0; 5; license; open (?:data commons )?(?:open )?database license
ODC-By-1.0; 2; spdx; spdx license identifier odc by 1 0
ODC-By-1.0; 5; license; open data commons attribution license
NCSA; 2; spdx; spdx license identifier ncsa
NCSA; 5; license; university of illinois (?:ncsa )?open source license
MS-PL; 2; spdx; spdx license identifier ms pl
MS-PL; 5; license; microsoft public license
MS-RL; 2; spdx; spdx license identifier ms rl
MS-RL; 5; license; microsoft reciprocal license
AFL-3.0; 2; spdx; spdx license identifier afl 3 0
AFL-3.0; 3; license; academic free license(?: version| v)? ?3(?: 0)?
OSL-3.0; 2; spdx; spdx license identifier osl 3 0
OSL-3.0; 3; license; open software license(?: version| v)? ?3(?: 0)?
QPL-1.0; 5; license; q public license
IPL-1.0; 5; license; ibm public license
OpenSSL; 5; license; openssl license
Vim; 5; license; vim license
Beerware; 1; license; beer ?ware license
JSON; 1; license; json license
Proprietary; 1; copyright; copyright .{0,80}?all rights reserved
Proprietary; 1; permission; no part of this (?:publication|work|document) may be reproduced .{0,120}?without (?:the )?(?:prior )?(?:written )?permission
Proprietary; 5; confidential and proprietary; (?:strictly )?confidential and proprietary
Unknown; 5; licensed under; licensed under (?:the )?(?:terms of )?[^ ]+(?: [^ ]+){0,3}? licen[cs]e
"""

RULES = tuple(
    Rule(label, int(priority), keyword, pattern)
    for label, priority, keyword, pattern in (line.split("; ", 3) for line in _TABLE.strip().splitlines())
)
#: Phrases whose places are always reported.
BASE_RULES = (
    Rule("mit", 0, "license", "mit license"),
    Rule("apache", 0, "apache", "apache license"),
    Rule("gpl", 0, "general public", "general public license"),
)
#: How sure a detection of each priority is; 0 stands for the base phrases.
WEIGHTS = {0: 0.5, 1: 0.95, 2: 0.9, 3: 0.8, 4: 0.6, 5: 0.4}
