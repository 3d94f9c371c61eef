"""What the licence classifier is trained on: notices and clauses of licence families, of other licences, and prose.

All of it is text in natural order.  Entries are lower case or mixed, as the classifier folds case; entries of one
family differ in wording, so that some can be left out of a fit and stand for notices not seen yet.
"""

from __future__ import annotations

#: Notices and clauses of each licence family (fixed values).
NOTICES = {
    "agpl": [
        "licensed under the gnu affero general public license version 3",
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version",
        "you should have received a copy of the gnu affero general public license along with this program. if not, see https://www.gnu.org/licenses/",
        "agpl 3.0 or later",
        "spdx-license-identifier: agpl-3.0-or-later",
        "released under the agplv3",
        "your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the corresponding source",
    ],
    "apache": [
        "licensed under the apache license, version 2.0 (the \"license\"); you may not use this file except in compliance with the license",
        "you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0",
        "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied",
        "see the license for the specific language governing permissions and limitations under the license",
        "released under the apache 2.0 license",
        "spdx-license-identifier: apache-2.0",
        "licensed to the apache software foundation (asf) under one or more contributor license agreements",
        "this project is licensed under the apache license 2.0",
        "apache license version 2.0, january 2004",
    ],
    "artistic": [
        "this library is free software; you may redistribute it and/or modify it under the same terms as perl itself",
        "licensed under the artistic license 2.0",
        "this is free software, licensed under the artistic license",
        "spdx-license-identifier: artistic-2.0",
    ],
    "boost": [
        "distributed under the boost software license, version 1.0. see accompanying file license_1_0.txt or copy at https://www.boost.org/license_1_0.txt",
        "boost software license - version 1.0 - august 17th, 2003",
        "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the software",
        "use, modification and distribution are subject to the boost software license",
        "spdx-license-identifier: bsl-1.0",
        "released under the boost license",
    ],
    "bsd": [
        "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption)",
        "released under the bsd license",
        "licensed under the bsd 3-clause license",
        "licensed under the 2-clause bsd license",
        "use of this source code is governed by a bsd-style license that can be found in the license file",
        "spdx-license-identifier: bsd-3-clause",
        "spdx-license-identifier: bsd-2-clause",
    ],
    "cc0": [
        "to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "released under cc0 1.0 universal",
        "dedicated to the public domain under creative commons zero",
        "this work is dedicated to the public domain by waiving all rights under the cc0 1.0 public domain dedication",
        "spdx-license-identifier: cc0-1.0",
    ],
    "cc_by": [
        "licensed under cc by 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
        "distributed under the terms of the creative commons attribution license, which permits unrestricted use, distribution, and reproduction in any medium, provided the original work is properly credited",
        "spdx-license-identifier: cc-by-4.0",
        "https://creativecommons.org/licenses/by/4.0/",
        "this article is published under a creative commons attribution 3.0 license",
    ],
    "cc_by_nc": [
        "licensed under cc by-nc 4.0",
        "this work is licensed under a creative commons attribution-noncommercial 4.0 international license",
        "https://creativecommons.org/licenses/by-nc/4.0/",
        "creative commons attribution-noncommercial-sharealike license, cc by-nc-sa 4.0",
        "spdx-license-identifier: cc-by-nc-4.0",
    ],
    "cc_by_sa": [
        "licensed under cc by-sa 4.0",
        "this work is licensed under a creative commons attribution-sharealike 4.0 international license",
        "text is available under the creative commons attribution-sharealike license",
        "https://creativecommons.org/licenses/by-sa/3.0/",
        "spdx-license-identifier: cc-by-sa-4.0",
        "content is available under cc by-sa 3.0 unless otherwise noted",
    ],
    "cddl": [
        "the contents of this file are subject to the terms of the common development and distribution license (the \"license\")",
        "licensed under the common development and distribution license version 1.0, cddl",
        "you can obtain a copy of the license at usr/src/opensolaris.license or http://www.opensolaris.org/os/licensing",
        "spdx-license-identifier: cddl-1.0",
    ],
    "epl": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "licensed under the eclipse public license",
        "spdx-license-identifier: epl-2.0",
        "distributed under the epl 1.0",
    ],
    "eupl": [
        "licensed under the eupl, version 1.2 or as soon they will be approved by the european commission - subsequent versions of the eupl (the \"licence\")",
        "you may not use this work except in compliance with the licence. you may obtain a copy of the licence at https://joinup.ec.europa.eu/software/page/eupl",
        "licensed under the european union public licence",
        "released under the european union public license version 1.1",
        "spdx-license-identifier: eupl-1.2",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license, version 3",
        "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version",
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version",
        "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu general public license for more details",
        "you should have received a copy of the gnu general public license along with this program. if not, see http://www.gnu.org/licenses/",
        "licensed under the gpl version 2",
        "released under gpl v3",
        "released under the gplv3",
        "distributed under the gplv2+",
        "this software is licensed under the terms of the gnu gpl",
        "spdx-license-identifier: gpl-2.0-only",
        "spdx-license-identifier: gpl-3.0-or-later",
    ],
    "isc": [
        "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action",
        "released under the isc license",
        "licensed under the isc license",
        "spdx-license-identifier: isc",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license, version 2.1",
        "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or (at your option) any later version",
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version",
        "this library is distributed in the hope that it will be useful, but without any warranty. see the gnu lesser general public license for more details",
        "you should have received a copy of the gnu lesser general public license along with this library",
        "released under the lgpl",
        "released under lgplv3",
        "distributed under the lgplv2.1+",
        "spdx-license-identifier: lgpl-2.1-or-later",
        "under the terms of the gnu library general public license",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
        "in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software",
        "licensed under the mit license",
        "this software is under the terms of the mit license",
        "the mit license (mit)",
        "spdx-license-identifier: mit",
        "this project is available under the mit license",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/",
        "licensed under the mozilla public license 2.0",
        "the contents of this file are subject to the mozilla public license version 1.1 (the \"license\"); you may not use this file except in compliance with the license",
        "released under the mpl 2.0",
        "spdx-license-identifier: mpl-2.0",
    ],
    "odbl": [
        "this database is made available under the open database license: http://opendatacommons.org/licenses/odbl/1.0/",
        "data available under the open database license, odbl",
        "any rights in individual contents of the database are licensed under the database contents license",
    ],
    "ofl": [
        "this font software is licensed under the sil open font license, version 1.1",
        "this license is available with a faq at http://scripts.sil.org/ofl",
        "the font software may be sold as part of a larger software package but no copy may be sold by itself",
        "spdx-license-identifier: ofl-1.1",
    ],
    "proprietary": [
        "all rights reserved",
        "copyright 2020 all rights reserved",
        "copyright 1999 the company and others. all rights reserved",
        "all rights are reserved by the publisher",
        "copyright (c) 2019 example corporation. all rights reserved",
        "unauthorized copying of this file, via any medium is strictly prohibited",
        "proprietary and confidential",
        "no part of this publication may be reproduced, stored in a retrieval system or transmitted in any form or by any means without the prior written permission of the publisher",
        "this software is the confidential and proprietary information of the company. you shall not disclose such confidential information",
        "alle rechte vorbehalten",
        "copyright 2011 alle rechte vorbehalten",
        "reproducción total o parcial prohibida",
        "tous droits réservés",
        "todos los derechos reservados",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
        "released under the unlicense",
        "for more information, please refer to http://unlicense.org/",
        "spdx-license-identifier: unlicense",
    ],
    "wtfpl": [
        "do what the fuck you want to public license",
        "everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
        "licensed under the wtfpl version 2",
        "spdx-license-identifier: wtfpl",
    ],
    "zlib": [
        "this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software",
        "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "the origin of this software must not be misrepresented; you must not claim that you wrote the original software",
        "altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
        "this notice may not be removed or altered from any source distribution",
        "released under the zlib license",
        "spdx-license-identifier: zlib",
    ],
}

#: Notices that speak of a licence of no family above (fixed values).
UNKNOWN = [
    "licensed under the example community license",
    "released under a custom license of the company",
    "released under the example source license version 1.2",
    "subject to the license agreement between you and the vendor",
    "this license grants no rights to any trademark",
    "licensed under the zephyr license v2",
    "this software is licensed under the qux public license",
    "use of this product is governed by the end user license agreement",
    "by installing the software you agree to be bound by the terms of this license",
    "the licensee shall not sublicense, rent or lease the software",
    "distributed under the terms of a private license",
    "you may use this dataset under the terms of the data use agreement",
    "this material may be freely used for teaching as long as the source is named",
    "redistribution is subject to the vendor terms of service",
    "spdx-license-identifier: licenseref-internal",
    "licencia de uso del producto",
    "diese software steht unter einer eigenen lizenz",
    "ce logiciel est distribué sous une licence particulière",
]

#: Short names of each family, and of licences that are none of them (fixed values).
NAMES = {
    "agpl": ["agpl", "agplv3", "agpl 3.0", "gnu affero general public license", "gnu agpl"],
    "apache": ["apache license", "apache 2.0", "apache 2 license", "apache licence 2.0", "asl 2.0"],
    "artistic": ["artistic license", "artistic 2.0", "perl artistic license"],
    "boost": ["boost license", "boost software license", "bsl 1.0"],
    "bsd": ["bsd", "bsd license", "new bsd license", "bsd 3 clause license", "bsd 2 clause", "simplified bsd license"],
    "cc0": ["cc0", "cc0 1.0", "creative commons zero", "cc0 public domain dedication"],
    "cc_by": ["cc by", "cc by 4.0", "creative commons attribution license", "creative commons attribution 4.0"],
    "cc_by_nc": ["cc by nc", "cc by nc 4.0", "cc by nc sa 4.0", "creative commons attribution noncommercial license"],
    "cc_by_sa": ["cc by sa", "cc by sa 4.0", "creative commons attribution sharealike license"],
    "cddl": ["cddl", "cddl 1.0", "common development and distribution license"],
    "epl": ["epl", "epl 2.0", "eclipse public license", "eclipse license"],
    "eupl": ["eupl", "eupl 1.2", "european union public licence"],
    "gpl": ["gpl", "gplv2", "gplv3", "gplv2+", "gplv3+", "gpl 3.0", "gnu gpl", "gnu general public license", "gpl version 3"],
    "isc": ["isc license", "isc licence", "isc"],
    "lgpl": ["lgpl", "lgplv2.1", "lgplv2.1+", "lgplv3", "lgplv3+", "lgpl 2.1", "lgpl 3.0 only", "gnu lesser general public license"],
    "mit": ["mit", "mit license", "mit licence", "expat license", "mit x11 license"],
    "mpl": ["mpl", "mpl 2.0", "mozilla public license", "mozilla public license 2.0"],
    "odbl": ["odbl", "open database license", "odbl 1.0"],
    "ofl": ["sil open font license", "ofl", "ofl 1.1", "open font license"],
    "unlicense": ["unlicense", "the unlicense"],
    "wtfpl": ["wtfpl", "wtfpl license"],
    "zlib": ["zlib license", "zlib", "zlib libpng license"],
    "unknown": ["zorro license", "company license", "vendor license agreement", "custom license", "community license 1.0", "acme public license", "source available license v2", "private license", "open game license", "terms of use"],
}
#: How a short notice names its licence (fixed values).
FRAMES = [
    "licensed under the {}",
    "licensed under {}",
    "released under the {}",
    "released under {}",
    "distributed under the terms of the {}",
    "available under {}",
    "published under the {}",
    "you can use it under the {}",
    "this project is made available under the {}",
    "license: {}",
    "spdx-license-identifier: {}",
    "{}. see the license file",
]

#: Prose that has words of licences and is no notice (fixed values).
OTHERS = [
    "the driver renewed the license last week",
    "she holds a fishing license",
    "the restaurant lost its liquor license",
    "copyright law is taught in the third year",
    "he gave permission to the children",
    "the apache helicopter landed near the village",
    "students at mit built a robot",
    "the general public was invited to the free concert",
    "the mozilla festival opened in london",
    "a creative commons search finds pictures",
    "redistribution of wealth was debated",
    "the rights of the people are reserved for later chapters",
    "licensed premises must close at eleven",
    "terms and conditions apply to this offer",
    "the source of the river is public domain land",
    "she works as a licensed nurse under a doctor",
    "the software was released in the spring",
    "the report was released under pressure from the press",
    "they met at the corner of the public library",
    "version 2.0 of the program came out in may",
    "the general manager signed the contract for the software",
    "all the rooms are reserved for guests",
    "free copies of the book were distributed to schools",
    "the authors thank the reviewers for useful comments",
    "the foundation supports free software in schools",
    "the license plate was stolen and the police took a copy of the file",
    "in no event was the ship to leave the harbour before noon",
    "the damages after the storm were limited to the roof",
    "a person is liable for what a person does",
    "the name of the holder is printed on the ticket",
    "without fee or charge the museum opens on sundays",
    "the work was provided by the city",
    "this form is used to modify or distribute payments",
    "eclipse watchers came from all over the european union",
    "the boost in sales was above expectations",
    "an artistic director chose the font for the poster",
    "the database holds names, contents and other data",
    "the commercial success of the original version surprised the publisher",
    "you may use the pool in the morning, and you may not run there",
    "see the file for details",
    "the source code is kept in a repository and built every night",
    "the following conditions were observed during the trial",
    "the warranty covers parts and labour for two years",
    "this page was last modified on monday",
    "the content of the article was based on interviews",
    "the court held that the copyright had expired",
    "they applied for a licence to sell wine",
    "the notice on the door said closed",
    "any person could enter the library",
    "the public sector must disclose such information",
    "the distribution of rain over the year is uneven",
    "commons and lords voted on the bill",
    "researchers at mit published a general study of public transport",
    "mit students and the local community built the open source robot",
    "apache tribes lived in the south west, and the apache web server was named after them",
    "the gnu project started a free operating system",
    "the eclipse of the sun was seen in may",
    "the european union published a general report on public software",
    "mozilla published version 3 of the browser",
    "perl is a language for text and the artistic works of programmers",
    "an open database of films and fonts",
    "zero copies were sold, and the license to print was lost",
    "a company may not use a name that another company has",
    "he used the software with permission of the authors",
    "the files are stored without a name in the public folder",
    "rights and liberties of the people under the law",
]

#: Words too common to be a feature by themselves, or together with another one of them (fixed values).
STOP = "a an and any are as at be been but by for from had has have he her his if in into is it its not of on or other our out she so such that the their them then there these they this to up was we were which who will with without you your".split() + "ce de del der des die do el est et la le les los o os por sous su un una une und unter zu".split()
