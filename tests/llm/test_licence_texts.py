"""Licence statements in texts from elsewhere: headers, package files and notes as they are found, and prose about licences."""

from __future__ import annotations

import time

from quillspark.llm import licences

STATED = [
    ("MIT", "MIT License\n\nCopyright (c) 2019 Jane Roe"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "## License\nMIT License\n"),
    ("MIT", "License: MIT"),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE.md file for details"),
    ("MIT", "// SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"),
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004"),
    ("Apache-2.0", " * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License."),
    ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"),
    ("BSD", "BSD 3-Clause License"),
    ("BSD", "/* SPDX-License-Identifier: BSD-2-Clause */"),
    ("BSD", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"),
    ("GPL", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007"),
    ("GPL", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License"),
    ("GPL", "License: GPLv3+"),
    ("GPL", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("LGPL", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("AGPL", "licensed under the GNU Affero General Public License v3.0"),
    ("AGPL", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this"),
    ("EPL", "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at"),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that"),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "Text is licensed under CC BY-SA 4.0"),
    ("CC0", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright 2020 Example Corp. All rights reserved."),
]
TOLD = [
    "The committee has all rights reserved by law for its members.", "MIT students protest the new license fees.", "He got his driving license in Massachusetts.",
    "In 1991 he wrote that version 2 of the GPL had been released to much debate.", "The Apache tribe lived in the southern plains.",
    "She compared the MIT License with the licenses of other projects in her thesis.", "The Mozilla Foundation is a non-profit organization.",
    "A total eclipse was seen by the public in May.", "Creative people of the commons met in the town hall.", "The software is free of charge for any student.",
    "The GNU project was announced in 1983.", "You may obtain a copy of the report at the office.", "Permission was granted to film in the museum free of charge.",
    "The licence of the pub was not renewed by the city.", "Redistribution of wealth was a topic of the general debate.", "Version 2.0 of the game is available under the counter.",
    "The public domain is larger in this country than elsewhere.", "Rights reserved for walkers are shown on the map.",
]


def families(texts):
    return [{k for k, _, _ in found} for found in licences.statements(texts, licences.fitted())]


def test_recall_and_precision_on_foreign_texts():
    """Of 28 statements at least 26 are found with their family and no other; of 18 sentences that only speak of such things none is."""
    found = families([t for _, t in STATED])
    right = sum(k == {want} for k, (want, _) in zip(found, STATED, strict=True))
    assert right >= 26, [(want, k) for k, (want, _) in zip(found, STATED, strict=True) if k != {want}]
    assert not [t for t, k in zip(TOLD, families(TOLD), strict=True) if k]


def test_headings_count_as_whole_lines_only():
    assert families(["MIT License", "x\n# MIT License\ny", "The MIT License is short", "MIT License fees rise"]) == [{"MIT"}, {"MIT"}, set(), set()]


def test_time_grows_with_the_statements():
    lines = ["released under the MIT License", "Permission is hereby granted, free of charge, to any person", "obtaining a copy of this software and associated documentation files"]

    def took(n):
        start = time.process_time()
        found = licences.statements(["\n".join(lines * n)], licences.fitted())
        assert len(found[0]) >= 2 * n - 1
        return time.process_time() - start

    took(50)
    assert took(1600) < 8 * took(400) + 0.5
