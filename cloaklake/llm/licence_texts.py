"""Wordings of public licences: (label, wording, mandatory key phrases). What they must say is given by the licences themselves."""

from __future__ import annotations

# Headings, grants, conditions and notices as the licences have them.
WORDINGS = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ["permission is hereby granted free of charge", "without restriction"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("mit", "licensed under the MIT License", ["mit license"]),
    ("mit", "released under the MIT License", ["mit license"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["for any purpose with or without fee is hereby granted"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ["redistribution and use in source and binary forms", "provided that the following conditions are met"]),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software without specific prior written permission"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ["permission is granted to anyone to use this software for any purpose including commercial applications"]),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software", ["any person or organization obtaining a copy of the software and accompanying documentation"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ["free and unencumbered software", "public domain"]),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", ["do what the fuck you want to public license"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["apache license version 2 0"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("apache-2.0", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.", ["terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document"]),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["gnu general public license", "either version 3"]),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ["gnu general public license", "either version 2"]),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ["gnu general public license", "either version 3"]),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ["gnu general public license", "either version 2"]),
    ("lgpl-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", ["gnu lesser general public license", "either version 3"]),
    ("lgpl-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", ["gnu lesser general public license", "either version 2 1"]),
    ("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ["gnu affero general public license", "either version 3"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ["mozilla public license v 2 0"]),
    ("epl", "made available under the terms of the Eclipse Public License", ["eclipse public license"]),
    ("cc0-1.0", "dedicated to the public domain under CC0 1.0 Universal", ["cc0 1 0 universal"]),
]

# Families of licences with their versions, and names in the SPDX list.
FAMILIES = [
    ("gpl", "GNU General Public License", ["2.0", "3.0"]), ("lgpl", "GNU Lesser General Public License", ["2.1", "3.0"]), ("agpl", "GNU Affero General Public License", ["3.0"]),
    ("apache", "Apache License", ["1.1", "2.0"]), ("mpl", "Mozilla Public License", ["1.1", "2.0"]), ("epl", "Eclipse Public License", ["1.0", "2.0"]), ("bsl", "Boost Software License", ["1.0"]),
]
SPDX = ["MIT", "ISC", "Zlib", "Unlicense", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0"]
CREATIVE_COMMONS = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"]
LONG_NAMES = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
ALONE = [("isc", "ISC License"), ("unlicense", "The Unlicense"), ("zlib", "zlib License"), ("bsl-1.0", "Boost Software License"), ("wtfpl", "WTFPL"), ("mit", "license: MIT"), ("mit", "MIT licensed")]


def templates() -> list[tuple[str, str, list[str]]]:
    """All wordings, and by rule: a family's name with each version as it is usually written, names alone, SPDX lines, CC names."""
    out = list(WORDINGS)
    for family, name, versions in FAMILIES:
        for v in versions:
            for written in dict.fromkeys((v, v.removesuffix(".0"))):
                for style in ("version {}", "v{}", "v {}", "{}"):
                    out.append((f"{family}-{v}", f"{name} {style.format(written)}", [f"{name} {style.format(written)}"]))
    out += [(family, name, [name]) for family, name, _ in FAMILIES if family in ("lgpl", "agpl", "mpl")]
    for x in SPDX:
        out.append((x.lower(), f"SPDX-License-Identifier: {x}", [f"SPDX-License-Identifier: {x}"]))
    for x in (x for x in SPDX if any(c.isdigit() for c in x)):  # in expressions; names without a version are words of some language
        for written in (f"OR {x}", f"AND {x}", f"{x} OR MIT", f"license: {x}"):
            out.append((x.lower(), written, [written]))
            if written.endswith("OR MIT"):
                out.append(("mit", written, [written]))
    for kind in CREATIVE_COMMONS:
        name = "-".join(LONG_NAMES[k] for k in kind.split("-"))
        for v in ("3.0", "4.0"):
            out.append((f"cc-{kind.lower()}-{v}", f"Licensed under CC {kind} {v}", [f"CC {kind} {v}"]))
            out.append((f"cc-{kind.lower()}-{v}", f"Creative Commons {name} {v}", [f"Creative Commons {name} {v}"]))
    for short, versions in (("GPL", ["2", "3"]), ("LGPL", ["2.1", "3"]), ("AGPL", ["3"])):
        for v in versions:
            label = f"{short.lower()}-{v if '.' in v else v + '.0'}"
            for written in (f"{short}v{v}", f"{short} v{v}", f"{short} {v}", f"{short} version {v}"):
                out.append((label, written, [written]))
    for n in (2, 3):
        for written in (f"BSD {n}-Clause", f"{n}-Clause BSD", f"BSD-{n} License"):
            out.append((f"bsd-{n}-clause", written, [written]))
    out += [(label, name, [name]) for label, name in ALONE]
    return out
