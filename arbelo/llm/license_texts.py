"""Sentences, notices and addresses by which license texts are known: label and words, written by hand.

Words are in lower case and joined by single spaces, as in a scanned text.
"""

from __future__ import annotations

#: Label, words.
SIGNATURES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise"),
    ("mit", "opensource org licenses mit"),
    ("x11", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
    ("ncsa", "to deal with the software without restriction including without limitation the rights to use copy modify merge publish"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("isc", "opensource org licenses isc"),
    ("hpnd", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("w3c", "permission to copy modify and distribute this software and its documentation with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd", "this software is provided by the regents and contributors as is and any express or implied warranties"),
    ("bsd", "this software is provided by the author as is and any express or implied warranties"),
    ("bsd", "use of this source code is governed by a bsd style license that can be found in the license file"),
    ("bsd-2-clause", "the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies"),
    ("bsd-2-clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "opensource org licenses bsd 3 clause"),
    ("bsd-3-clause-clear", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-4-clause", "this product includes software developed by the university of california berkeley and its contributors"),
    ("apache-1.0", "this product includes software developed by the apache group for use in the apache http server project"),
    ("apache-1.1", "this product includes software developed by the apache software foundation"),
    ("apache-1.1", "the names apache and apache software foundation must not be used to endorse or promote products derived from this software"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0", "you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-2.0", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "www apache org licenses license 2 0"),
    ("apache-2.0", "opensource org licenses apache 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "www gnu org licenses gpl"),
    ("gpl-1", "the license agreements of most software companies try to keep users at the mercy of those companies"),
    ("gpl-2", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2", "activities other than copying distribution and modification are not covered by this license they are outside its scope"),
    ("gpl-2", "you must cause the modified files to carry prominent notices stating that you changed the files and the date of any change"),
    ("gpl-2", "www gnu org licenses old licenses gpl 2 0"),
    ("gpl-3", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3", "the licenses for most software and other practical works are designed to take away your freedom to share and change the works"),
    ("gpl-3", "you may convey a covered work in object code form under the terms of sections 4 and 5"),
    ("gpl-3", "no covered work shall be deemed part of an effective technological measure under any applicable law"),
    ("gpl-3", "www gnu org licenses gpl 3 0"),
    ("gpl-classpath-exception", "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-gcc-exception", "this gcc runtime library exception exception is an additional permission under section 7 of the gnu general public license"),
    ("gpl-linux-syscall-note", "this copyright does not cover user programs that use kernel services by normal system calls"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu"),
    ("lgpl", "www gnu org licenses lgpl"),
    ("lgpl-2", "this is the first released version of the library gpl it is numbered 2 because it goes with version 2 of the ordinary gpl"),
    ("lgpl-2.1", "this is the first released version of the lesser gpl it also counts as the successor of the gnu library public license"),
    ("lgpl-2.1", "the lesser general public license applies to some specially designated software packages typically libraries"),
    ("lgpl-3", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("agpl-3", "specifically designed to ensure cooperation with the community in the case of network server software"),
    ("agpl-3", "if your software can interact with users remotely through a computer network you should also make sure that it provides a way for users to get its source"),
    ("agpl-3", "www gnu org licenses agpl"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", "www gnu org licenses fdl"),
    ("mpl-1.1", "see the license for the specific language governing rights and limitations under the license"),
    ("mpl-1.1", "www mozilla org mpl mpl 1 1"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-2.0", "mozilla org mpl 2 0"),
    ("npl", "the contents of this file are subject to the netscape public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl-1.0", "www eclipse org legal epl v10"),
    ("epl-2.0", "this source code may also be made available under the following secondary licenses when the conditions for such availability set forth in the eclipse public license"),
    ("epl-2.0", "www eclipse org legal epl 2 0"),
    ("edl", "this program and the accompanying materials are made available under the terms of the eclipse distribution license"),
    ("cpl", "this program and the accompanying materials are made available under the terms of the common public license"),
    ("ipl", "the accompanying program is provided under the terms of this ibm public license"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", "when distributing covered code include this cddl header in each file"),
    ("boost", "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("boost", "www boost org license 1 0"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", "the png reference library is supplied as is"),
    ("libpng", "this code is released under the libpng license"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"),
    ("unlicense", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("unlicense", "unlicense org"),
    ("cc", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons"),
    ("cc", "you are free to share copy and redistribute the material in any medium or format"),
    ("cc", "the work as defined below is provided under the terms of this creative commons public license"),
    ("cc-by", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by", "creativecommons org licenses by 4 0"),
    ("cc-by", "creativecommons org licenses by 3 0"),
    ("cc-by", "creativecommons org licenses by 2 0"),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-by-sa", "creativecommons org licenses by sa"),
    ("cc-by-nc", "you may not use the material for commercial purposes"),
    ("cc-by-nc", "creativecommons org licenses by nc"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-nd", "creativecommons org licenses by nd"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("cc0", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons org publicdomain mark 1 0"),
    ("public-domain", "this file is in the public domain"),
    ("public-domain", "has been placed in the public domain"),
    ("public-domain", "is a work of the united states government and is in the public domain"),
    ("public-domain", "the author disclaims copyright to this source code in place of a legal notice here is a blessing"),
    ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("artistic-2.0", "opensource org licenses artistic 2 0"),
    ("perl", "it under the same terms as perl itself"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl", "the fonts including any derivative works can be bundled embedded redistributed and or sold with any software"),
    ("ofl", "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("ofl", "scripts sil org ofl"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("wtfpl", "www wtfpl net"),
    ("python", "this license agreement is between the python software foundation psf and the individual or organization licensee"),
    ("python-cnri", "this license agreement is between the corporation for national research initiatives"),
    ("python-beopen", "beopen python open source license agreement version 1"),
    ("php", "this product includes php software freely available from"),
    ("php", "the name php must not be used to endorse or promote products derived from this software"),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "this package is an ssl implementation written by eric young"),
    ("postgresql", "the university of california specifically disclaims any warranties including but not limited to the implied warranties"),
    ("postgresql", "in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("curl", "all rights reserved permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("tcl", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("vim", "vim is charityware you can use and copy it as much as you like"),
    ("ftl", "portions of this software are copyright the freetype project"),
    ("ijg", "this software is based in part on the work of the independent jpeg group"),
    ("bzip2", "this program bzip2 the associated library libbzip2 and all documentation are copyright"),
    ("unicode", "unicode inc hereby grants the right to freely use the information supplied in this file in the creation of products supporting the unicode standard"),
    ("unicode", "unicode data files and software"),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code for the db software"),
    ("qpl", "the q public license version 1 0"),
    ("zpl", "zope public license zpl version 2 1"),
    ("apsl", "this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"),
    ("afl-3.0", "licensed under the academic free license version 3 0"),
    ("osl-3.0", "licensed under the open software license version 3 0"),
    ("cecill", "this software is governed by the cecill license under french law and abiding by the rules of distribution of free software"),
    ("eupl", "licensed under the eupl"),
    ("eupl", "this european union public licence the eupl applies to the work as defined below"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-rl", "reciprocal grants for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code"),
    ("nasa-1.3", "nasa open source agreement version 1 3"),
    ("rpl-1.5", "reciprocal public license version 1 5"),
    ("upl-1.0", "the universal permissive license upl version 1 0"),
    ("blueoak-1.0", "blue oak model license version 1 0 0"),
    ("blueoak-1.0", "each contributor licenses you to do everything with this software that would otherwise infringe that contributor s copyright in it"),
    ("mulan-2", "mulan permissive software license version 2"),
    ("json", "the software shall be used for good not evil"),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("odbl", "this database is made available under the open database license"),
    ("odbl", "opendatacommons org licenses odbl"),
    ("odc-by", "opendatacommons org licenses by"),
    ("pddl", "opendatacommons org licenses pddl"),
    ("cdla-permissive", "community data license agreement permissive version 2 0"),
    ("cdla-sharing", "community data license agreement sharing version 1 0"),
    ("ogl-uk", "contains public sector information licensed under the open government licence"),
    ("sspl", "if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available"),
    ("elastic", "you may not provide the software to third parties as a hosted or managed service where the service provides users with access to any substantial set of the features"),
    ("busl", "effective on the change date or the fourth anniversary of the first publicly available distribution of a specific version of the licensed work"),
    ("commons-clause", "without limiting other conditions in the license the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("polyform-nc", "polyform noncommercial license 1 0 0"),
    ("openrail", "use based restrictions as referenced in paragraph 5 must be included as an enforceable provision"),
    ("openrail", "creativeml open rail m"),
    ("llama", "llama 2 community license agreement"),
    ("llama", "meta llama 3 community license agreement"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "this software is the confidential and proprietary information of"),
    ("proprietary", "no part of this publication may be reproduced stored in a retrieval system or transmitted in any form or by any means"),
]
