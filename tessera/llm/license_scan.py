"""License scan by ordered signature rules, in DataFrame functions only.

A text is read as its words (a-z, 0-9 and all that is not ASCII, lower-cased) with one space between. RULES are regular
expressions over words, written one by one: tags, titles, notices, sentences of license texts, addresses and short mentions.
Words that every match of a rule holds are derived from its pattern; they are the prefilter: of each text only rules all of
whose words it has are run. A rule is one pass over the text; matches are intervals of words. One that lies inside the
interval of a rule of the same or a better priority is suppressed (equal intervals: the better priority, then the earlier rule stays).

Matches are found, ordered and suppressed inside the row, by array functions; nothing is shuffled. Sums and maxima along
a row's matches are taken in chunks, so that a text with very many of them costs no square of their number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_append

#: Confidence of a match by priority (1 is best).
CONFIDENCE = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.8, 5: 0.6}
#: label, priority, pattern over words. {L}: license or licence; {V}: an optional "version" or "v"; {G}: how a grant opens.
RULES = """
mit 1 spdx license identifier mit
mit-0 1 spdx license identifier mit 0
x11 1 spdx license identifier x11
apache-1.0 1 spdx license identifier apache 1 0
apache-1.1 1 spdx license identifier apache 1 1
apache-2.0 1 spdx license identifier apache 2 0
gpl-1.0 1 spdx license identifier gpl 1 0(?: only| or later)?
gpl-2.0 1 spdx license identifier gpl 2 0(?: only| or later)?
gpl-3.0 1 spdx license identifier gpl 3 0(?: only| or later)?
lgpl-2.0 1 spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 1 spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 1 spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3.0 1 spdx license identifier agpl 3 0(?: only| or later)?
gfdl-1.3 1 spdx license identifier gfdl 1 [123](?: only| or later)?
bsd-2-clause 1 spdx license identifier bsd 2 clause
bsd-3-clause 1 spdx license identifier bsd 3 clause
bsd-4-clause 1 spdx license identifier bsd 4 clause
0bsd 1 spdx license identifier 0bsd
isc 1 spdx license identifier isc
mpl-1.1 1 spdx license identifier mpl 1 1
mpl-2.0 1 spdx license identifier mpl 2 0
epl-1.0 1 spdx license identifier epl 1 0
epl-2.0 1 spdx license identifier epl 2 0
cddl-1.0 1 spdx license identifier cddl 1 [01]
cc0-1.0 1 spdx license identifier cc0 1 0
cc-by-4.0 1 spdx license identifier cc by 4 0
cc-by-sa-4.0 1 spdx license identifier cc by sa 4 0
cc-by-nc-4.0 1 spdx license identifier cc by nc 4 0
cc-by-nc-sa-4.0 1 spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0 1 spdx license identifier cc by nc nd 4 0
unlicense 1 spdx license identifier unlicense
wtfpl 1 spdx license identifier wtfpl
zlib 1 spdx license identifier zlib
boost-1.0 1 spdx license identifier bsl 1 0
artistic-2.0 1 spdx license identifier artistic 2 0
python-2.0 1 spdx license identifier python 2 0
postgresql 1 spdx license identifier postgresql
ofl-1.1 1 spdx license identifier ofl 1 1
eupl-1.2 1 spdx license identifier eupl 1 2
ms-pl 1 spdx license identifier ms pl
upl-1.0 1 spdx license identifier upl 1 0
ncsa 1 spdx license identifier ncsa
spdx-tag 5 spdx license identifier [^ ]+
mit 2 permission is hereby granted free of charge to any person obtaining a copy of this software
mit 2 permission is hereby granted free of charge to any person obtaining a copy
mit 2 the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit 2 the software is provided as is without warranty of any kind express or implied
mit 2 {G}(?: the)?(?: terms of)?(?: the)? mit(?: x11| expat)?(?: {L})?
mit 4 (?:the )?mit(?: x11| expat)? {L}
mit 4 (?:the )?mit open source {L}
mit 3 {L}(?: is| type| name)? mit
mit 3 opensource org licenses mit(?: license php)?
mit 4 massachusetts institute of technology {L}
mit-0 3 mit no attribution(?: {L})?
x11 4 x11 {L}
x11 2 except as contained in this notice the name of the x consortium
expat 4 expat {L}
expat 2 {G}(?: the)?(?: terms of)?(?: the)? expat(?: {L})?
apache-2.0 2 licensed under the apache license version 2 0(?: the license)?
apache-2.0 2 you may not use this file except in compliance with the license(?: you may obtain a copy of the license at)?
apache-2.0 2 {G}(?: the)?(?: terms of)?(?: the)? apache(?: software)?(?: {L})? {V}2(?: 0)?
apache-2.0 3 apache(?: software)? {L} {V}2(?: 0)?
apache-2.0 3 apache {V}2 0(?: {L})?
apache-2.0 3 apache org licenses license 2 0(?: txt| html)?
apache-1.1 3 apache(?: software)? {L} {V}1 1
apache-1.0 3 apache(?: software)? {L} {V}1 0
apache 2 {G}(?: the)?(?: terms of)?(?: the)? apache(?: software)?(?: {L})?
apache 4 apache(?: software)? {L}
apache 3 {L}(?: is| type| name)? apache(?: 2(?: 0)?)?
apache 2 this product includes software developed by the apache (?:software foundation|group)
gpl-3.0 2 this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license
gpl-2.0 2 this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license
gpl 2 this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl 2 under the terms of the gnu general public license as published by the free software foundation
gpl 2 you should have received a copy of the gnu general public license along with
gpl 2 {G}(?: the)?(?: terms of)?(?: the)? (?:gnu )?general public(?: {L})?
gpl 2 {G}(?: the)?(?: terms of)?(?: the)? (?:gnu )?gpl
gpl-1.0 3 (?:gnu )?general public {L} {V}1(?: 0)?
gpl-2.0 3 (?:gnu )?general public {L} {V}2(?: 0)?
gpl-3.0 3 (?:gnu )?general public {L} {V}3(?: 0)?
gpl-2.0 3 (?:gnu )?gpl {V}2(?: 0)?(?: only| or later)?
gpl-3.0 3 (?:gnu )?gpl {V}3(?: 0)?(?: only| or later)?
gpl-2.0 3 gplv2
gpl-3.0 3 gplv3
gpl 4 (?:gnu )?general public {L}
gpl 4 gnu gpl
gpl 4 gpl {L}
gpl 3 gnu org licenses(?: old licenses)? gpl(?: [0-9](?: [0-9])?)?(?: html| txt)?
gpl 3 gnu org copyleft gpl html
lgpl-2.1 2 under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license
lgpl 2 under the terms of the gnu (?:lesser|library) general public license
lgpl 2 you should have received a copy of the gnu lesser general public license along with
lgpl 2 {G}(?: the)?(?: terms of)?(?: the)? (?:gnu )?lesser general public(?: {L})?
lgpl 2 {G}(?: the)?(?: terms of)?(?: the)? (?:gnu )?lgpl
lgpl-2.0 3 (?:gnu )?library general public {L} {V}2(?: 0)?
lgpl-2.1 3 (?:gnu )?lesser general public {L} {V}2 1
lgpl-3.0 3 (?:gnu )?lesser general public {L} {V}3(?: 0)?
lgpl 4 (?:gnu )?lesser general public {L}
lgpl 4 (?:gnu )?library general public {L}
lgpl-2.1 3 lgpl {V}2 1(?: only| or later)?
lgpl-3.0 3 lgpl {V}3(?: 0)?(?: only| or later)?
lgpl 4 lgpl {L}
lgpl 3 gnu org licenses(?: old licenses)? lgpl(?: [0-9](?: [0-9])?)?(?: html| txt)?
agpl-3.0 2 under the terms of the gnu affero general public license(?: as published by the free software foundation either version 3)?
agpl 2 {G}(?: the)?(?: terms of)?(?: the)? (?:gnu )?affero general public(?: {L})?
agpl 2 {G}(?: the)?(?: terms of)?(?: the)? (?:gnu )?agpl
agpl-3.0 3 (?:gnu )?affero general public {L} {V}3(?: 0)?
agpl 4 (?:gnu )?affero general public {L}
agpl-3.0 3 agpl {V}3(?: 0)?(?: only| or later)?
agpl-3.0 3 agplv3
agpl 4 agpl {L}
agpl 3 gnu org licenses agpl(?: [0-9](?: [0-9])?)?(?: html| txt)?
gfdl 2 {G}(?: the)?(?: terms of)?(?: the)? (?:gnu )?free documentation(?: {L})?
gfdl 4 (?:gnu )?free documentation {L}
gfdl 2 with no invariant sections no front cover texts and no back cover texts
gfdl 3 gnu org (?:licenses|copyleft) fdl(?: [0-9](?: [0-9])?)?(?: html| txt)?
gfdl 4 gfdl {L}
bsd 2 redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd 2 redistribution and use in source and binary forms with or without modification
bsd 2 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd 2 redistributions in binary form must reproduce the above copyright notice
bsd-3-clause 2 neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-4-clause 2 all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd 2 {G}(?: the)?(?: terms of)?(?: the)? bsd(?: style)?(?: {L})?
bsd-2-clause 2 {G}(?: the)?(?: terms of)?(?: the)? (?:2|two) clause bsd(?: {L})?
bsd-3-clause 2 {G}(?: the)?(?: terms of)?(?: the)? (?:3|three) clause bsd(?: {L})?
bsd-2-clause 3 (?:2|two) clause bsd(?: {L})?
bsd-2-clause 3 bsd (?:2|two) clause(?: {L})?
bsd-2-clause 3 simplified bsd {L}
bsd-2-clause 3 freebsd {L}
bsd-3-clause 3 (?:3|three) clause bsd(?: {L})?
bsd-3-clause 3 bsd (?:3|three) clause(?: {L})?
bsd-3-clause 3 new bsd {L}
bsd-3-clause 3 modified bsd {L}
bsd-3-clause 3 revised bsd {L}
bsd-4-clause 3 (?:4|four) clause bsd(?: {L})?
bsd-4-clause 3 bsd (?:4|four) clause(?: {L})?
bsd-4-clause 3 original bsd {L}
bsd-4-clause 3 old bsd {L}
0bsd 3 zero clause bsd(?: {L})?
0bsd 3 bsd zero clause(?: {L})?
0bsd 3 0bsd(?: {L})?
bsd 4 bsd(?: style)? {L}
bsd 3 {L}(?: is| type| name)? bsd(?: [234] clause)?
bsd 3 opensource org licenses bsd(?: [23] clause| license)?(?: php)?
isc 2 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 2 permission to use copy modify and distribute this software for any purpose with or without fee
isc 2 {G}(?: the)?(?: terms of)?(?: the)? isc(?: {L})?
isc 4 isc {L}
isc 3 {L}(?: is| type| name)? isc
mpl-2.0 2 this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 2 the contents of this file are subject to the mozilla public license version 1 1
mpl 2 subject to the terms of the mozilla public license
mpl 2 {G}(?: the)?(?: terms of)?(?: the)? mozilla public(?: {L})?
mpl 2 {G}(?: the)?(?: terms of)?(?: the)? mpl(?: 2 0)?
mpl-1.0 3 mozilla public {L} {V}1 0
mpl-1.1 3 mozilla public {L} {V}1 1
mpl-2.0 3 mozilla public {L} {V}2(?: 0)?
mpl-2.0 3 mozilla org mpl 2 0
mpl 4 mozilla public {L}
mpl-2.0 3 mpl {V}2 0
epl-1.0 3 eclipse public {L} {V}1(?: 0)?
epl-2.0 3 eclipse public {L} {V}2(?: 0)?
epl 4 eclipse public {L}
epl 2 {G}(?: the)?(?: terms of)?(?: the)? eclipse public(?: {L})?
epl 3 eclipse org legal epl v[12]0(?: html)?
edl-1.0 4 eclipse distribution {L}
cddl-1.1 3 common development and distribution {L} {V}1 1
cddl-1.0 3 common development and distribution {L}(?: {V}1(?: 0)?)?
cddl 2 {G}(?: the)?(?: terms of)?(?: the)? common development and distribution(?: {L})?
cddl-1.0 3 cddl {V}1 [01]
cpl-1.0 4 common public {L}(?: {V}1 0)?
cpal-1.0 4 common public attribution {L}
eupl-1.1 3 european union public licen[cs]e {V}1 1
eupl-1.2 3 european union public licen[cs]e {V}1 2
eupl 4 european union public licen[cs]e
eupl 3 eupl {V}1 [12]
cc0-1.0 2 to the extent possible under law (?:[^ ]+ ){1,12}waived all copyright and related or neighboring rights
cc0-1.0 2 {G}(?: the)?(?: terms of)?(?: the)? cc0(?: 1 0)?(?: universal)?(?: {L})?
cc0-1.0 3 cc0 1 0(?: universal)?(?: {L})?
cc0-1.0 4 cc0 {L}
cc0-1.0 3 creativecommons org publicdomain zero 1 0
cc-by-4.0 2 {G}(?: a| the)?(?: terms of)?(?: the)? cc by(?: {V}4 0)?(?: {L})?
cc-by-4.0 3 cc by {V}4 0(?: {L})?
cc-by-3.0 3 cc by {V}3 0(?: {L})?
cc-by-2.0 3 cc by {V}2 [05](?: {L})?
cc-by 4 cc by {L}
cc-by-sa-4.0 2 {G}(?: a| the)?(?: terms of)?(?: the)? cc by sa(?: {V}4 0)?(?: {L})?
cc-by-sa-4.0 3 cc by sa {V}4 0(?: {L})?
cc-by-sa-3.0 3 cc by sa {V}3 0(?: {L})?
cc-by-sa-2.0 3 cc by sa {V}2 [05](?: {L})?
cc-by-sa 4 cc by sa {L}
cc-by-nc-4.0 2 {G}(?: a| the)?(?: terms of)?(?: the)? cc by nc(?: {V}4 0)?(?: {L})?
cc-by-nc-4.0 3 cc by nc {V}4 0(?: {L})?
cc-by-nc-3.0 3 cc by nc {V}3 0(?: {L})?
cc-by-nc 4 cc by nc {L}
cc-by-nd-4.0 3 cc by nd {V}4 0(?: {L})?
cc-by-nd-3.0 3 cc by nd {V}3 0(?: {L})?
cc-by-nd 4 cc by nd {L}
cc-by-nc-sa-4.0 2 {G}(?: a| the)?(?: terms of)?(?: the)? cc by nc sa(?: {V}4 0)?(?: {L})?
cc-by-nc-sa-4.0 3 cc by nc sa {V}4 0(?: {L})?
cc-by-nc-sa-3.0 3 cc by nc sa {V}3 0(?: {L})?
cc-by-nc-sa 4 cc by nc sa {L}
cc-by-nc-nd-4.0 2 {G}(?: a| the)?(?: terms of)?(?: the)? cc by nc nd(?: {V}4 0)?(?: {L})?
cc-by-nc-nd-4.0 3 cc by nc nd {V}4 0(?: {L})?
cc-by-nc-nd-3.0 3 cc by nc nd {V}3 0(?: {L})?
cc-by-nc-nd 4 cc by nc nd {L}
cc-by-4.0 2 creative commons attribution 4 0(?: international)?(?: public)?(?: {L})?
cc-by-3.0 2 creative commons attribution 3 0(?: unported)?(?: {L})?
cc-by 3 creative commons attribution(?: {L})?
cc-by-sa-4.0 2 creative commons attribution share ?alike 4 0(?: international)?(?: public)?(?: {L})?
cc-by-sa-3.0 2 creative commons attribution share ?alike 3 0(?: unported)?(?: {L})?
cc-by-sa 3 creative commons attribution share ?alike(?: {L})?
cc-by-nc-4.0 2 creative commons attribution non ?commercial 4 0(?: international)?(?: public)?(?: {L})?
cc-by-nc 3 creative commons attribution non ?commercial(?: {L})?
cc-by-nd-4.0 2 creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: public)?(?: {L})?
cc-by-nd 3 creative commons attribution no ?deriv(?:ative)?s(?: {L})?
cc-by-nc-sa-4.0 2 creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: public)?(?: {L})?
cc-by-nc-sa 3 creative commons attribution non ?commercial share ?alike(?: {L})?
cc-by-nc-nd-4.0 2 creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: public)?(?: {L})?
cc-by-nc-nd 3 creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: {L})?
cc 2 {G}(?: a| the)?(?: terms of)?(?: the)? creative commons(?: {L})?
cc 4 creative commons {L}
cc-by-4.0 3 creativecommons org licenses by 4 0
cc-by-3.0 3 creativecommons org licenses by 3 0
cc-by-sa-4.0 3 creativecommons org licenses by sa 4 0
cc-by-sa-3.0 3 creativecommons org licenses by sa 3 0
cc-by-nc-4.0 3 creativecommons org licenses by nc 4 0
cc-by-nd-4.0 3 creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 3 creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 3 creativecommons org licenses by nc nd 4 0
artistic-1.0 3 artistic {L} {V}1 0
artistic-2.0 3 artistic {L} {V}2(?: 0)?
artistic 4 artistic {L}
artistic 2 {G}(?: the)?(?: same)?(?: terms of)?(?: terms as)?(?: the)? artistic(?: {L})?
perl 2 under the same terms as perl(?: itself)?
perl 4 perl {L}
zlib 2 this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib 2 {G}(?: the)?(?: terms of)?(?: the)? zlib(?: libpng)?(?: {L})?
zlib 4 zlib(?: libpng)? {L}
libpng 4 libpng {L}
boost-1.0 2 distributed under the boost software license version 1 0
boost-1.0 3 boost software {L}(?: {V}1 0)?
boost-1.0 3 boost org license 1 0(?: txt)?
boost-1.0 4 boost {L}
unlicense 2 this is free and unencumbered software released into the public domain
unlicense 3 (?:the )?unlicense
unlicense 3 unlicense org
wtfpl 3 do what the fuck you want to public {L}
wtfpl 3 wtf public {L}
wtfpl 3 wtfpl(?: {L})?
python-2.0 3 python software foundation {L}(?: {V}2)?
python-2.0 4 psf {L}(?: agreement)?
python-2.0 4 python {L}
ruby 4 ruby {L}
php-3.01 3 php {L}(?: {V}3 0(?: ?1)?)?
postgresql 4 postgresql {L}
postgresql 2 permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
openssl 3 openssl(?: ssleay)? {L}
openssl 2 this product includes software developed by the openssl project
ssleay 3 ssleay {L}
w3c 4 w3c(?: software)?(?: notice and)? {L}
ofl-1.1 2 this font software is licensed under the sil open font license(?: version 1 1)?
ofl-1.1 3 (?:sil )?open font {L}(?: {V}1 [01])?
ofl-1.1 3 scripts sil org ofl
odbl-1.0 3 open database {L}(?: odbl)?(?: {V}1 0)?
odbl-1.0 3 opendatacommons org licenses odbl(?: 1 0)?
odc-by-1.0 3 open data commons attribution {L}
pddl-1.0 3 public domain dedication and {L}
pddl-1.0 3 opendatacommons org licenses pddl(?: 1 0)?
ms-pl 4 microsoft public {L}
ms-rl 4 microsoft reciprocal {L}
ms-pl 4 ms pl {L}
afl-3.0 4 academic free {L}(?: {V}3 0)?
osl-3.0 4 open software {L}(?: {V}3 0)?
ecl-2.0 4 educational community {L}(?: {V}2 0)?
ncsa 4 university of illinois(?: ncsa)?(?: open source)? {L}
ncsa 4 ncsa(?: open source)? {L}
upl-1.0 4 universal permissive {L}
busl-1.1 3 business source {L}(?: {V}1 1)?
sspl-1.0 3 server side public {L}(?: {V}1)?
elastic-2.0 3 elastic {L} {V}2(?: 0)?
elastic 4 elastic {L}
polyform-nc 4 polyform noncommercial {L}(?: 1 0 0)?
polyform 4 polyform (?:strict|small business|perimeter|shield|free trial|internal use) {L}
commons-clause 3 commons clause(?: {L})? condition(?: v1 0)?
openrail 3 openrail(?: m)?(?: {L})?
openrail 3 open rail(?: m)? {L}
openrail 3 bigscience(?: open)? rail(?: {L})?
openrail 3 creativeml(?: open)? rail(?: m)?(?: {L})?
llama 4 llama(?: [23])? community {L}(?: agreement)?
gemma 4 gemma terms of use
qpl-1.0 4 q public {L}
sleepycat 4 sleepycat {L}
vim 4 vim {L}
beerware 3 beer ware {L}
beerware 3 beerware {L}
beerware 2 if we meet some day and you think this stuff is worth it you can buy me a beer
hippocratic 4 hippocratic {L}
cecill-2.1 4 cecill(?: [abc])?(?: free software)? {L}
json 2 the software shall be used for good not evil
json 4 json {L}
curl 4 curl {L}
icu 4 icu {L}
unicode 4 unicode(?: data files and software)? {L}
unicode 3 unicode org copyright(?: html)?
intel 4 intel(?: simplified)? open source {L}
nvidia 4 nvidia(?: source code| software)? {L}
ibm-pl 4 ibm public {L}
apsl 4 apple public source {L}
npl 4 netscape public {L}
sun-sissl 4 sun industry standards source {L}
lppl 4 latex project public {L}
lppl 2 this work may be distributed and or modified under the conditions of the latex project public license
mulan-psl-2.0 4 mulan(?: permissive)?(?: software)? {L}
naist-2003 4 naist {L}
zope 4 zope public {L}
cern-ohl 4 cern open hardware {L}
tapr-ohl 4 tapr open hardware {L}
open-gov-3.0 3 open government {L}(?: {V}[123] 0)?
etalab-2.0 4 etalab(?: open)? {L}
dl-de 4 datenlizenz deutschland
public-domain 2 (?:released|dedicated|placed) (?:in|into|to) the public domain
public-domain 3 (?:in|into|to) the public domain
public-domain 3 has been dedicated to the public domain
public-domain 3 no copyright is claimed
public-domain 4 public domain (?:work|software|text|mark|image|notice)
all-rights-reserved 5 copyright(?: c)? [0-9]{4}(?: [0-9]{4})? (?:[^ ]+ ){0,8}all rights reserved
all-rights-reserved 5 all rights reserved
copyright 5 copyright(?: c)? [0-9]{4}(?: [0-9]{4})?
proprietary 5 proprietary(?: software)? {L}
proprietary 5 commercial(?: software)? {L}
proprietary 5 closed source(?: software)? {L}
proprietary 4 proprietary and confidential
proprietary 4 unauthori[sz]ed (?:copying|use|reproduction|distribution) (?:of this (?:file|software|work|document) )?is (?:strictly )?prohibited
end-user 4 end user {L} agreement
end-user 5 software {L} agreement
shareware 5 shareware {L}
freeware 5 freeware {L}
copyleft 5 copyleft
dual-license 5 dual licensed
dual-license 5 dually licensed
royalty-free 5 royalty free(?: {L})?
permissive 5 permissive(?: software)? {L}
open-source 5 open source {L}
see-license 5 see(?: the)?(?: accompanying)? license(?: file)? (?:for|in) (?:the )?(?:license|details|terms|more|root)
see-license 5 license(?: information)? can be found in
attribution 5 free to (?:use|share|copy)(?: and adapt| and modify)? (?:with|provided) (?:proper |appropriate )?(?:attribution|credit)
non-commercial 5 for non ?commercial use only
non-commercial 5 personal and non ?commercial use
research-only 5 for research(?: purposes| use) only
no-derivatives 5 no derivative works
warranty-disclaimer 5 without (?:any )?warranty(?: of any kind)?
"""
#: Phrases that always count, by whole words.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_SHORT = {"{L}": "(?:license|licence)", "{V}": "(?:version |v |v)?", "{G}": "(?:licensed|released|distributed|published|available|provided|covered|made available|redistributed)(?: only)? (?:under|by|with)"}
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words that a rule is gated by, at most.
GATE_WORDS = 3
#: Matches that are summed up together.
CHUNK = 64
_OPEN, _CLOSE = "\x01", "\x02"


#: Words that say nothing about licenses; a gate has them only where a rule has no others.
_COMMON = frozenset("the of to in by and or for is a any with under as be no on at".split())


def _variants(pattern: str, at: int = 0) -> tuple[list[str], int]:
    """All texts that a pattern stands for, a class as the sign NUL and a repetition once, and where its part ends (at a closing parenthesis)."""
    done, now = [], [""]
    while at < len(pattern) and pattern[at] != ")":
        c = pattern[at]
        if c == "|":
            done, now, at = done + now, [""], at + 1
            continue
        if c == "(":
            some, at = _variants(pattern, at + 3)
            at += 1
        elif c == "[":
            some, at = ["\0"], pattern.index("]", at) + 1
        else:
            some, at = [c], at + 1
        after = pattern[at : at + 1]
        if after == "?":
            some = ["", *some]
        if after == "{":
            at = pattern.index("}", at)
        at += after in ("?", "+", "{") and after != ""
        now = [x + y for x in now for y in some]
    return done + now, at


@lru_cache(maxsize=1)
def rules() -> list[tuple[int, str, list[str], int, float, str]]:
    """(number, label, words of its gate, priority, confidence, pattern over words), in order. The gate's words are the longest of those that every match has."""
    out = []
    for i, line in enumerate(RULES.strip().split("\n")):
        label, priority, pattern = line.split(" ", 2)
        for short, long in _SHORT.items():
            pattern = pattern.replace(short, long)
        every = set.intersection(*({w for w in x.split(" ") if w and "\0" not in w} for x in _variants(pattern)[0]))
        words = sorted(every - _COMMON or every, key=lambda w: (-len(w), w))[:GATE_WORDS]
        if not words:
            raise ValueError(f"no word that every match has: {line}")
        out.append((i, label, words, int(priority), CONFIDENCE[int(priority)], pattern))
    return out


def _whole(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _before(xs: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element of xs the merge of all before it (merge is associative, zero its neutral element); CHUNK by CHUNK, null for an empty array."""
    none = F.slice(F.array(zero), 1, 0)

    def scan(part: Column) -> Column:
        return F.aggregate(part, F.struct(zero.alias("sum"), none.alias("out")), lambda a, x: F.struct(merge(a["sum"], x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda c: scan(F.slice(xs, c * CHUNK + 1, CHUNK)))
    joined = F.arrays_zip(chunks.alias("chunk"), scan(F.transform(chunks, lambda c: c["sum"]))["out"].alias("first"))
    return F.when(F.size(xs) > 0, F.flatten(F.transform(joined, lambda z: F.transform(z["chunk"]["out"], lambda x: merge(z["first"], x)))))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of docs with n_words, n_base, first_word, last_word, base_labels, labels, detections and score.

    detections: array of (start, end, priority, rule, label, confidence), words [start, end), in order of start; base
    phrases are counted apart. score: the best confidence, 0.8 at least where a base phrase stands, else 0. A null or empty
    text has no words: counts 0, first and last word null, label strings empty, score 0. Repeated rows each have a row,
    no rows give none. Columns of docs with the new names are replaced.
    """
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "detections", "score"]
    kept = [c for c in docs.columns if c not in new]
    lowered = F.translate(F.coalesce(F.col("_t"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(f"`{text}`").cast("string").alias("_t"))
    df = held.select("_row", F.regexp_replace(F.concat(F.lit(" "), lowered, F.lit(" ")), _NOT_WORD, " ").alias("_w"))
    gates = sorted({w for _, _, words, *_ in rules() for w in words} | {w for phrase in BASE for w in phrase.split()})
    # the words of the text that some rule is gated by
    df = df.select("_row", "_w", F.greatest(_spaces(F.col("_w")) - 1, F.lit(0)).cast("long").alias("n_words"), F.array_intersect(F.split("_w", " "), F.array(*[F.lit(w) for w in gates])).alias("_has"))

    # base phrases: places of each as the words before them
    found, first, last = {}, [], []
    for phrase, label in BASE.items():
        hit = F.array_contains("_has", phrase.split()[-1]) & F.contains("_w", F.lit(f" {phrase} "))
        pieces = F.split("_w", _whole(phrase), -1)
        found[label] = F.when(hit, F.size(pieces) - 1).otherwise(0)
        first.append(F.when(hit, _spaces(pieces[0]) - 1))
        last.append(F.when(hit, F.col("n_words") - len(phrase.split()) - (_spaces(F.element_at(pieces, -1)) - 1)))
    df = df.withColumn("n_base", sum(found.values(), F.lit(0)).cast("long")).withColumn("first_word", F.least(*first).cast("long")).withColumn("last_word", F.greatest(*last).cast("long"))
    df = df.withColumn("_base", F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for label, n in found.items()])))

    # only literal structs: the planner folds them into one constant array
    table = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.array(*[F.lit(x) for x in words]).alias("words"), F.lit(priority).alias("priority"), F.lit(sure).alias("confidence"), F.lit(_whole(pattern)).alias("pattern")) for i, label, words, priority, sure, pattern in rules()])

    def matches(r: Column) -> Column:
        # one pass marks all matches; a piece after the first begins with one
        pieces = F.split(F.regexp_replace(F.col("_w"), r["pattern"], F.lit(f"{_OPEN}$0{_CLOSE}")), _OPEN, -1)

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            start = at - 1
            end = start + _spaces(F.substring_index(x, _CLOSE, 1)) + 1
            out = F.struct(start.alias("start"), (-end).alias("neg_end"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"), r["confidence"].alias("confidence"))
            return at + _spaces(x), F.when(F.contains(x, F.lit(_CLOSE)), out)

        return F.array_compact(fold_append(pieces, F.lit(0), "struct<start:int,neg_end:int,priority:int,rule:int,label:string,confidence:double>", step))

    none = F.array().cast("array<struct<start:int,neg_end:int,priority:int,rule:int,label:string,confidence:double>>")
    candidates = F.filter(table, lambda r: F.forall(r["words"], lambda w: F.array_contains(F.col("_has"), w)))
    df = df.withColumn("_all", F.when(F.size("_has") > 0, F.array_sort(F.flatten(F.transform(candidates, matches)))))
    df = df.withColumn("_all", F.coalesce("_all", none))

    # the furthest end so far of intervals with priority up to p + 1, for each p; earlier ones start no later
    levels = max(p for _, _, _, p, _, _ in rules())
    ends = F.transform("_all", lambda d: F.transform(F.sequence(F.lit(1), F.lit(levels)), lambda p: F.when(p >= d["priority"], -d["neg_end"]).otherwise(-1)))
    reach = _before(ends, F.array(*[F.lit(-1)] * levels), lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    zipped = F.arrays_zip(F.col("_all").alias("d"), reach.alias("reach"))
    df = df.withColumn("_kept", F.when(F.size("_all") > 0, F.transform(F.filter(zipped, lambda z: F.element_at(z["reach"], z["d"]["priority"]) < -z["d"]["neg_end"]), lambda z: z["d"])).otherwise(none))
    sure = F.coalesce(F.array_max(F.transform("_kept", lambda d: d["confidence"])), F.lit(0.0))
    return df.select(
        *[F.col("_row")[c].alias(c) for c in kept], "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_base", F.transform("_kept", lambda d: d["label"])))), ",").alias("labels"),
        F.transform("_kept", lambda d: F.struct(d["start"].alias("start"), (-d["neg_end"]).alias("end"), d["priority"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label"), d["confidence"].alias("confidence"))).alias("detections"),
        F.greatest(sure, F.when(F.col("n_base") > 0, 0.8).otherwise(0.0)).alias("score"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's columns but detections for every document; null and empty texts as in scan(), repeated rows each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
