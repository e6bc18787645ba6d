"""The license scan's own templates: whole texts (licenses/*.txt), usual notices with their versions, SPDX identifiers.

Names are ``<license>-text`` for whole texts, ``<license>-notice`` for notices and ``spdx-<identifier>`` for SPDX lines."""
from __future__ import annotations

import json
import re
from pathlib import Path

FOLDER = Path(__file__).resolve().parent / "licenses"
_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
_GNU = {"gpl": ("GNU General Public License", ("1", "2", "3")), "lgpl": ("GNU Lesser General Public License", ("2.1", "3")), "lgpl-library": ("GNU Library General Public License", ("2",)),
        "agpl": ("GNU Affero General Public License", ("1", "3")), "gfdl": ("GNU Free Documentation License", ("1.1", "1.2", "1.3"))}
#: Names under which a work can be licensed.
_NAMES = {
    "apache-1.1": ("Apache License, Version 1.1", "Apache Software License, Version 1.1"), "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"),
    "mit": ("MIT License", "MIT licence", "Expat License"), "bsd": ("BSD License",), "bsd-2-clause": ("BSD 2-Clause License", "2-clause BSD License", "Simplified BSD License"),
    "bsd-3-clause": ("BSD 3-Clause License", "3-clause BSD License", "New BSD License", "Modified BSD License"), "isc": ("ISC License",), "zlib": ("zlib License", "zlib/libpng License"),
    "unlicense": ("Unlicense License", "The Unlicense"), "bsl-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"), "artistic-1.0": ("Artistic License 1.0",), "artistic-2.0": ("Artistic License 2.0", "Artistic License, Version 2.0"),
    "mpl-1.1": ("Mozilla Public License Version 1.1", "Mozilla Public License, v. 1.1", "MPL 1.1"), "mpl-2.0": ("Mozilla Public License Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "epl-1.0": ("Eclipse Public License v1.0", "Eclipse Public License 1.0", "Eclipse Public License, Version 1.0", "Eclipse Public License v. 1.0"), "epl-2.0": ("Eclipse Public License v2.0", "Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License v. 2.0"),
    "cddl-1.0": ("Common Development and Distribution License, Version 1.0", "Common Development and Distribution License 1.0"), "eupl-1.2": ("European Union Public Licence v. 1.2", "European Union Public License 1.2", "EUPL 1.2"),
    "cc0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal"), "odbl-1.0": ("Open Database License 1.0", "Open Database License (ODbL) v1.0"), "ofl-1.1": ("SIL Open Font License, Version 1.1",),
}
#: Standard notices that aren't built of a name.
_NOTICES = {
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl-1.0-notice": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "isc-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "bsl-1.0-notice": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
}


def _words(text: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def texts() -> dict[str, str]:
    """Whole license texts, by name."""
    return {f"{p.stem}-text": p.read_text(encoding="utf-8") for p in sorted(FOLDER.glob("*.txt"))}


def notices() -> dict[str, str]:
    """Notices that are matched word by word up to the threshold."""
    out = dict(_NOTICES)
    for key, (name, versions) in _GNU.items():
        for v in versions:
            if key != "gfdl":
                what = "library" if key.startswith("lgpl") else "program"
                for link in ("free software; you", "free software: you"):
                    out[f"{key}-{v}-or-later-notice"] = f"This {what} is {link} can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
                out[f"{key}-{v}-only-notice"] = f"This {what} is free software; you can redistribute it and/or modify it under the terms of the {name} version {v} as published by the Free Software Foundation."
    return out


def exact() -> dict[str, list[str]]:
    """Notices of a few words, in which every word counts: the forms of each license."""
    names = {k: list(v) for k, v in _NAMES.items()}
    for key, (name, versions) in _GNU.items():
        names[key] = [name]
        short = key.split("-")[0].upper()
        for v in versions:
            for form in {v, v if "." in v else f"{v}.0"}:
                names.setdefault(f"{key}-{v}", []).extend([f"{name}, version {form}", f"{name} v{form}", f"{name} {form}", f"{short} version {form}", f"{short} v{form}", f"{short}-{form}"])
    for key, name in _CC.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            names[f"cc-{key}-{v}"] = [f"CC {key} {v}", *(f"Creative Commons {n} {v}{more}" for n in {name, name.replace("NoDerivatives", "NoDerivs"), name.replace("ShareAlike", "Share Alike")} for more in ("", " International", " Unported", " Generic"))]
    out: dict[str, list[str]] = {}
    for key, forms in names.items():
        phrases = set()
        for form in forms:
            for lead in ("under ", "under the ", "under a ", "under the terms of the "):
                phrase = _words(lead + form)
                phrases |= {phrase} if phrase.count(" ") > 2 else {f"{verb} {phrase}" for verb in ("licensed", "released", "distributed", "available", "provided")}
        out[f"{key}-notice"] = sorted(p for p in phrases if p.count(" ") > 2)
    for key in _CC:
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out[f"cc-{key}-{v}-notice"].append(_words(f"creativecommons.org/licenses/{key}/{v}"))
    out["cc0-1.0-notice"].append(_words("creativecommons.org/publicdomain/zero/1.0"))
    return out


_LINE = re.compile(r"(?ai:SPDX-License-Identifier):[\x20\t]*")
_ID, _JOIN = re.compile(r"[\x20\t(]*([A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?)"), re.compile(r"[\x20\t)]*\b(?ai:AND|OR|(WITH))\b")
_KNOWN: dict[str, frozenset] = {}


def known() -> dict[str, frozenset]:
    """The identifiers of the SPDX list, in lower case."""
    if not _KNOWN:
        _KNOWN.update({k: frozenset(x.lower() for x in v) for k, v in json.loads((FOLDER / "spdx.json").read_text()).items()})
    return _KNOWN


def spdx(text: str | None, ids: dict[str, frozenset]) -> list[tuple[str, float, int, int]]:
    """(name, 1.0, start, end) of the licenses of each SPDX line's expression; exceptions (WITH) have no row."""
    out = []
    for m in _LINE.finditer(text or ""):
        at, exception = m.end(), False
        while got := _ID.match(text, at):
            name = got[1].lower()
            name = name if name in ids["licenses"] or not name.endswith("+") else name[:-1]
            if not exception and (name in ids["licenses"] or re.fullmatch(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+", name)):
                out.append((f"spdx-{name}".replace(":", "/"), 1.0, got.start(1), got.end(1)))
            elif not exception:
                break
            joint = _JOIN.match(text, got.end())
            if not joint:
                break
            at, exception = joint.end(), bool(joint[1])
    return out
