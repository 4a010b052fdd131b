"""Operator 2 on the usual comment headers, SPDX lines and notices that are none."""

import re

from quarry.llm import licences

GNU = "This {what} is free software; you can redistribute it and/or\nmodify it under the terms of the GNU {of}General Public\nLicense as published by the Free Software Foundation; either\nversion {v} of the License, or (at your option) any later version.\n\nThis {what} is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0'
ASF = 'Licensed to the Apache Software Foundation (ASF) under one\nor more contributor license agreements.  See the NOTICE file\ndistributed with this work for additional information\nregarding copyright ownership.  The ASF licenses this file\nto you under the Apache License, Version 2.0 (the\n"License"); you may not use this file except in compliance\nwith the License.  You may obtain a copy of the License at'
HEADERS = [
    ("Apache-2.0", APACHE),
    ("Apache-2.0", ASF),
    ("GPL-2.0", GNU.format(what="program", of="", v="2")),
    ("GPL-3.0", GNU.format(what="program", of="", v="3")),
    ("LGPL-2.1", GNU.format(what="library", of="Lesser ", v="2.1")),
    ("LGPL-3.0", GNU.format(what="library", of="Lesser ", v="3")),
    ("AGPL-3.0", GNU.format(what="program", of="Affero ", v="3")),
    ("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version\n1.1 (the "License"); you may not use this file except in compliance with\nthe License. You may obtain a copy of the License at\nhttp://www.mozilla.org/MPL/'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file."),
    ("MIT", "Use of this source code is governed by an MIT-style\nlicense that can be found in the LICENSE file or at\nhttps://opensource.org/licenses/MIT."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-3.0", "Licensed under CC BY 3.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
]
SPDX = [
    ("MIT", "SPDX-License-Identifier: MIT"), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"), ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0+"), ("Apache-2.0", "SPDX-License-Identifier: (Apache-2.0 OR MIT)"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
]
NONE = [
    "This file is not licensed under the MIT License.", "You need a driving license, version 2, to rent a car.", "Licensed under CC BY 2.5.", "SPDX-License-Identifier: NOASSERTION",
    "Use of this source code is governed by a custom license that can be found in the LICENSE file.", "Licensed under the GNU General Public License, version 7.", "", None,
]


def commented(text, mark):
    lines = "\n".join(f"{mark} {x}".rstrip() for x in text.split("\n"))
    return f"{mark}\n{lines}\n{mark}\n\nimport something\n\ndef run(x):\n    return x\n"


def test_headers_get_their_licence_and_version(spark):
    cases = [(n, t) for n, t in HEADERS] + [(n, commented(t, m)) for n, t in HEADERS for m in ("#", " *", "//")]
    cases += [(n, f"Some prose about nothing at all.\n// {t}\nMore of it, and more of the same.\n") for n, t in SPDX] + [(None, t) for t in NONE]
    prose = [(None, re.sub("e", str(k), "the weather was fine and the train went to the coast")) for k in range(40)]
    rows = [(k, f"d{k}/x.py", t) for k, (_, t) in enumerate(cases + prose)]
    found = {r["doc_id"]: r["licence"] for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [(n, found[k], t) for k, (n, t) in enumerate(cases + prose) if found[k] != n] == []
