"""Signatures of licences, in order of precedence.

Each line: label | keyword | patterns. A pattern is a regular expression over
lower-case words with one space between them; it is tried only on texts that
have its keyword, or other words that it can't do without if it can without that. Patterns that start with `=` are whole names or notices
(priority 3), with `~` mere mentions (priority 1); others have priority 2.
"""

LINES = """
mit | mit | =spdx license identifier mit | =the mit license( mit)? | =licen[sc]ed under the( terms of the)? mit licen[sc]e | =released under the( terms of the)? mit licen[sc]e | mit licen[sc]e | ~mit style licen[sc]e
mit | mit x11 | mit x11
mit | without restriction | =permission is hereby granted free of charge to any person obtaining a copy | including without limitation the rights to use copy modify merge publish distribute
mit-0 | mit | =spdx license identifier mit 0 | mit 0 licen[sc]e
mit-0 | mit no attribution | =mit no attribution
mit-cmu | cmu | =spdx license identifier mit cmu | =cmu licen[sc]e
x11 | x11 | =spdx license identifier x11 | =x11 licen[sc]e | ~x consortium
apache-2.0 | apache | =spdx license identifier apache 2 0 | =licen[sc]ed under the apache licen[sc]e version 2( 0)? | =apache licen[sc]e version 2( 0)? | =apache software licen[sc]e version 2( 0)? | apache 2( 0)?( licen[sc]e)? | asl 2 0 | www apache org licenses license 2 0
apache-1.1 | apache | =spdx license identifier apache 1 1 | =apache software licen[sc]e version 1 1 | apache licen[sc]e 1 1
apache-1.0 | apache | =spdx license identifier apache 1 0 | =apache software licen[sc]e version 1 0 | apache licen[sc]e 1 0
apache | apache | apache licen[sc]e | apache software licen[sc]e | ~apache style licen[sc]e
gpl-3.0 | gpl | =spdx license identifier gpl 3 0( only| or later)? | gnu gpl v?3( 0)? | gpl( version)? v?3( 0)?( or later)? | gplv3
gpl-3.0 | general public | =gnu general public licen[sc]e version 3 | =general public licen[sc]e v3 | =licen[sc]ed under the gnu general public licen[sc]e version 3 | =gnu general public licen[sc]e either version 3
gpl-2.0 | gpl | =spdx license identifier gpl 2 0( only| or later)? | gnu gpl v?2( 0)? | gpl( version)? v?2( 0)?( or later)? | gplv2
gpl-2.0 | general public | =gnu general public licen[sc]e version 2 | =general public licen[sc]e v2 | =licen[sc]ed under the gnu general public licen[sc]e version 2 | =gnu general public licen[sc]e either version 2
gpl-1.0 | general public | =gnu general public licen[sc]e version 1 | =gnu general public licen[sc]e either version 1
gpl | general public | general public licen[sc]e | gnu general public | =this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
gpl | gpl | ~gnu gpl | ~gpl licen[sc]ed | ~under the gpl
gpl-classpath | classpath | =classpath exception | gpl with classpath exception | as a special exception the copyright holders of this library give you permission to link
lgpl-3.0 | lgpl | =spdx license identifier lgpl 3 0( only| or later)? | lgpl( version)? v?3( 0)? | lgplv3
lgpl-3.0 | lesser general | =gnu lesser general public licen[sc]e version 3 | =lesser general public licen[sc]e v3
lgpl-2.1 | lgpl | =spdx license identifier lgpl 2 1( only| or later)? | lgpl( version)? v?2 1 | lgplv2 1
lgpl-2.1 | lesser general | =gnu lesser general public licen[sc]e version 2 1 | =lesser general public licen[sc]e v2 1
lgpl-2.0 | library general | =gnu library general public licen[sc]e version 2( 0)? | =gnu library general public licen[sc]e
lgpl | lesser general | lesser general public licen[sc]e
lgpl | lgpl | ~gnu lgpl | ~under the lgpl
agpl-3.0 | agpl | =spdx license identifier agpl 3 0( only| or later)? | agpl( version)? v?3( 0)? | agplv3
agpl-3.0 | affero | =gnu affero general public licen[sc]e version 3 | =affero general public licen[sc]e v3 | =remote network interaction use with the gnu general public licen[sc]e
agpl | affero | affero general public licen[sc]e | ~gnu affero
gfdl-1.3 | documentation | =gnu free documentation licen[sc]e version 1 3 | =spdx license identifier gfdl 1 3( only| or later)?
gfdl-1.2 | documentation | =gnu free documentation licen[sc]e version 1 2
gfdl | documentation | gnu free documentation licen[sc]e | ~free documentation licen[sc]e
bsd-2-clause | bsd | =spdx license identifier bsd 2 clause | =simplified bsd licen[sc]e | =freebsd licen[sc]e | =(2|two) clause bsd( licen[sc]e)? | bsd 2 clause
bsd-3-clause | bsd | =spdx license identifier bsd 3 clause | =(new|modified|revised) bsd licen[sc]e | =(3|three) clause bsd( licen[sc]e)? | bsd 3 clause
bsd-4-clause | bsd | =spdx license identifier bsd 4 clause | =(original|old) bsd licen[sc]e | =(4|four) clause bsd( licen[sc]e)? | bsd 4 clause
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
0bsd | bsd | =spdx license identifier 0bsd | =(zero|0) clause bsd( licen[sc]e)? | bsd zero clause
bsd | bsd | bsd licen[sc]e | ~bsd style( licen[sc]e)? | ~berkeley software distribution
bsd | redistribution | =redistribution and use in source and binary forms with or without modification are permitted | redistributions of source code must retain the above copyright notice | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | endorse | neither the name of .{1,80} nor the names of its contributors may be used to endorse | may be used to endorse or promote products derived from this software
isc | isc | =spdx license identifier isc | =isc licen[sc]e | =internet systems consortium licen[sc]e
isc | permission to use | =permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | permission to use copy modify and distribute this software for any purpose
mpl-2.0 | mozilla | =mozilla public licen[sc]e( v| version)? 2( 0)? | =this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0 | mozilla org mpl 2 0
mpl-2.0 | mpl | =spdx license identifier mpl 2 0 | mpl( v| version)? 2( 0)?
mpl-1.1 | mozilla | =mozilla public licen[sc]e( v| version)? 1 1 | mozilla org mpl mpl 1 1
mpl-1.1 | mpl | =spdx license identifier mpl 1 1 | mpl( v| version)? 1 1
mpl-1.0 | mozilla | =mozilla public licen[sc]e( v| version)? 1 0
mpl | mozilla | mozilla public licen[sc]e | ~mozilla licen[sc]e
epl-2.0 | eclipse | =eclipse public licen[sc]e( v| version)? 2( 0)? | eclipse org legal epl 2 0
epl-2.0 | epl | =spdx license identifier epl 2 0 | epl( v| version)? 2 0
epl-1.0 | eclipse | =eclipse public licen[sc]e( v| version)? 1( 0)? | eclipse org legal epl v10
epl-1.0 | epl | =spdx license identifier epl 1 0 | epl( v| version)? 1 0
epl | eclipse | eclipse public licen[sc]e | eclipse distribution licen[sc]e
cddl-1.1 | cddl | =spdx license identifier cddl 1 1 | cddl( v| version)? 1 1
cddl-1.0 | cddl | =spdx license identifier cddl 1 0 | cddl( v| version)? 1 0
cddl | development and distribution | =common development and distribution licen[sc]e
cpl-1.0 | common public | =common public licen[sc]e( v| version)? 1 0 | common public licen[sc]e
ms-pl | microsoft | =microsoft public licen[sc]e | ms pl
ms-rl | microsoft | =microsoft reciprocal licen[sc]e | ms rl
artistic-2.0 | artistic | =artistic licen[sc]e( v| version)? 2( 0)? | =spdx license identifier artistic 2 0
artistic-1.0 | artistic | =artistic licen[sc]e( v| version)? 1( 0)? | =spdx license identifier artistic 1 0
artistic | artistic | artistic licen[sc]e | ~same terms as perl itself
zlib | zlib | =spdx license identifier zlib | =zlib licen[sc]e | =zlib libpng licen[sc]e
zlib | held liable | =this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng | libpng | =libpng licen[sc]e | =png reference library licen[sc]e
bsl-1.0 | boost | =spdx license identifier bsl 1 0 | =boost software licen[sc]e( version)?( 1 0)? | boost org license 1 0
unlicense | unlicense | =spdx license identifier unlicense | =the unlicense | unlicense org
unlicense | public domain | =this is free and unencumbered software released into the public domain | free and unencumbered software
wtfpl | wtfpl | =spdx license identifier wtfpl | wtfpl
wtfpl | want to | =do what the f[a-z]{3} you want to public licen[sc]e
cc0-1.0 | cc0 | =spdx license identifier cc0 1 0 | =cc0 1 0( universal)? | cc0
cc0-1.0 | creative commons | =creative commons zero( v1 0)?( universal)? | =creative commons cc0 | creative commons public domain dedication
cc-by-nc-nd-4.0 | cc | =cc by nc nd 4 0 | =spdx license identifier cc by nc nd 4 0
cc-by-nc-sa-4.0 | cc | =cc by nc sa 4 0 | =spdx license identifier cc by nc sa 4 0
cc-by-nc-4.0 | cc | =cc by nc 4 0 | =spdx license identifier cc by nc 4 0 | =licen[sc]ed under cc by nc 4 0
cc-by-nd-4.0 | cc | =cc by nd 4 0 | =spdx license identifier cc by nd 4 0
cc-by-sa-4.0 | cc | =cc by sa 4 0 | =spdx license identifier cc by sa 4 0
cc-by-4.0 | cc | =cc by 4 0 | =spdx license identifier cc by 4 0
cc-by-nc-nd-3.0 | cc | =cc by nc nd 3 0
cc-by-nc-sa-3.0 | cc | =cc by nc sa 3 0
cc-by-nc-3.0 | cc | =cc by nc 3 0
cc-by-nd-3.0 | cc | =cc by nd 3 0
cc-by-sa-3.0 | cc | =cc by sa 3 0
cc-by-3.0 | cc | =cc by 3 0
cc-by-sa-2.5 | cc | =cc by sa 2 5
cc-by-2.5 | cc | =cc by 2 5
cc-by-sa-2.0 | cc | =cc by sa 2 0
cc-by-2.0 | cc | =cc by 2 0
cc-by-nc-nd | cc | cc by nc nd
cc-by-nc-sa | cc | cc by nc sa
cc-by-nc | cc | cc by nc
cc-by-nd | cc | cc by nd
cc-by-sa | cc | cc by sa
cc-by | cc | cc by
cc-by-nc-nd | creative commons | =creative commons attribution non ?commercial no ?deriv(ative)?s
cc-by-nc-sa | creative commons | =creative commons attribution non ?commercial share ?alike
cc-by-nc | creative commons | =creative commons attribution non ?commercial
cc-by-nd | creative commons | =creative commons attribution no ?deriv(ative)?s
cc-by-sa | creative commons | =creative commons attribution share ?alike
cc-by | creative commons | =creative commons attribution
cc | creative commons | ~creative commons licen[sc]e | ~creativecommons org licenses | ~creative commons
odbl-1.0 | odbl | =spdx license identifier odbl 1 0 | odbl
odbl-1.0 | database | =open database licen[sc]e | opendatacommons org licenses odbl
pddl-1.0 | database | =public domain dedication and licen[sc]e | opendatacommons org licenses pddl
ofl-1.1 | ofl | =sil ofl( 1 1)? | =spdx license identifier ofl 1 1 | scripts sil org ofl
ofl-1.1 | font | =sil open font licen[sc]e( version)?( 1 1)? | open font licen[sc]e
psf-2.0 | python | =python software foundation licen[sc]e( version)?( 2)? | =spdx license identifier psf 2 0 | psf licen[sc]e agreement for python
python-2.0 | python | =spdx license identifier python 2 0 | cnri python licen[sc]e | beopen python open source licen[sc]e
php-3.01 | php | =php licen[sc]e( version)? 3 01 | =spdx license identifier php 3 01 | php licen[sc]e
ruby | ruby | =ruby licen[sc]e | ~same terms as ruby
perl | perl | ~same terms as perl
openssl | openssl | =openssl licen[sc]e | =original ssleay licen[sc]e | openssl toolkit
postgresql | postgresql | =postgresql licen[sc]e | postgresql database management system
ncsa | ncsa | =university of illinois ncsa open source licen[sc]e | ncsa open source licen[sc]e
eupl-1.2 | eupl | =eupl( v| version)? 1 2 | =spdx license identifier eupl 1 2
eupl-1.1 | eupl | =eupl( v| version)? 1 1
eupl | european union | =european union public licen[sc]e
upl-1.0 | universal | =universal permissive licen[sc]e( v| version)?( 1 0)?
afl-3.0 | academic | =academic free licen[sc]e( v| version)?( 3 0)?
osl-3.0 | open software | =open software licen[sc]e( v| version)?( 3 0)?
ecl-2.0 | educational | =educational community licen[sc]e( version)?( 2 0)?
cecill | cecill | =cecill( b| c)? licen[sc]e | cecill
vim | vim | =vim licen[sc]e
curl | curl | =curl licen[sc]e
json | good not evil | =the software shall be used for good not evil
sspl-1.0 | side public | =server side public licen[sc]e( v| version)?( 1)?
sspl-1.0 | sspl | =spdx license identifier sspl 1 0 | ~sspl
elastic-2.0 | elastic | =elastic licen[sc]e( v| version)?( 2 0)?
busl-1.1 | business | =business source licen[sc]e( v| version)?( 1 1)?
blueoak-1.0.0 | blue oak | =blue oak model licen[sc]e( 1 0 0)?
hippocratic | hippocratic | =hippocratic licen[sc]e
openrail | rail | =open rail( m)?( licen[sc]e)? | =openrail( m)?( licen[sc]e)? | =creativeml open rail m | responsible ai licen[sc]e
llama | llama | =llama( 2| 3)? community licen[sc]e( agreement)?
public-domain | public domain | released into the public domain | dedicated to the public domain | placed in the public domain | ~in the public domain | ~public domain
all-rights-reserved | rights reserved | =all rights reserved | ~rights reserved
copyright | copyright | ~copyright c [0-9]{4} | ~copyright [0-9]{4} | ~c copyright
proprietary | proprietary | proprietary and confidential | =this software is proprietary | ~proprietary licen[sc]e
proprietary | unauthorized | =unauthorized copying of this file | unauthorized copying or distribution is prohibited
commercial | commercial | =for non ?commercial use only | commercial licen[sc]e agreement | ~not for commercial use
no-warranty | warranty | ~without warranty of any kind | ~without any warranty | ~no warranty
""".strip()
