"""Licence templates: whole texts, headers that sources carry, and titles of licence files.

Whole texts are the files of `licenses`, named by licence. The words that a header or title starts
with (`ANCHORS`) tell where in a file it may stand; it is compared with as many words as the template has.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

_FOLDER = Path(__file__).parent / "licenses"


def _gnu(work: str, name: str, version: str, later: bool = True) -> list[str]:
    """The first paragraph of a GNU header, and all three."""
    old = version.startswith(("1", "2"))
    grant = f"; either version {version} of the License, or (at your option) any later version." if later else f"; version {version} of the License."
    first = (
        f"This {work} is free software{';' if old else ':'} you can redistribute it and/or modify it under the terms of the GNU {name} "
        f"as published by the Free Software Foundation{grant}"
    )
    rest = (
        f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
        f"You should have received a copy of the GNU {name} along with this {work}"
    )
    end = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA" if old else ". If not, see <https://www.gnu.org/licenses/>."
    return [first, f"{first} {rest}{end}"]


_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_NEITHER = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. "
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)
_APACHE_REST = (
    " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
    "language governing permissions and limitations under the License."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
    '(the "Software"), to deal in the Software without restriction'
)
_MIT_REST = (
    ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
    "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_GNU = [
    ("GPL-1.0", "program", "General Public License", "1"), ("GPL-2.0", "program", "General Public License", "2"),
    ("GPL-3.0", "program", "General Public License", "3"), ("LGPL-2.0", "library", "Library General Public License", "2"),
    ("LGPL-2.1", "library", "Lesser General Public License", "2.1"), ("LGPL-3.0", "library", "Lesser General Public License", "3"),
    ("AGPL-3.0", "program", "Affero General Public License", "3"),
]
HEADERS = tuple(
    [(licence, text) for licence, work, name, version in _GNU for later in (True, False) for text in _gnu(work, name, version, later)]
    + [
        ("Apache-2.0", _APACHE), ("Apache-2.0", _APACHE + _APACHE_REST),
        ("MIT", _MIT), ("MIT", _MIT + _MIT_REST), ("ISC", _ISC),
        ("BSD-2-Clause", _BSD + _DISCLAIMER), ("BSD-3-Clause", _BSD + _NEITHER + _DISCLAIMER),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
        ("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/'),
        ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
        ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
        ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ]
)
TITLES = (
    ("GPL-1.0", "GNU General Public License Version 1, February 1989"), ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"), ("LGPL-2.0", "GNU Library General Public License Version 2, June 1991"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"), ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"), ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSL-1.0", "Boost Software License Version 1.0"), ("EPL-2.0", "Eclipse Public License v 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("CC0-1.0", "CC0 1.0 Universal"),
    ("MIT", "The MIT License"), ("ISC", "ISC License"),
)
ANCHORS = {
    "header": (
        "is free software you", "is free software under", "licensed under", "released under", "distributed under", "is dedicated to",
        "permission is hereby granted", "permission to use", "redistribution and use", "source code form is subject",
        "contents of this file are subject", "accompanying materials are made available", "free and unencumbered software",
    ),
    "title": (
        "gnu general public license", "gnu library general", "gnu lesser general", "gnu affero general", "apache license", "mozilla public license",
        "boost software license", "eclipse public license", "bsd 2 clause", "bsd 3 clause", "cc0 1 0", "mit license", "isc license",
    ),
}


@cache
def whole_texts() -> tuple[tuple[str, str], ...]:
    """(licence, text) of every whole licence: those of the folder, and those short enough to be headers."""
    files = [(f.stem, f.read_text("utf-8")) for f in sorted(_FOLDER.glob("*.txt"))]
    return (*files, ("ISC", _ISC), ("BSD-2-Clause", _BSD + _DISCLAIMER), ("BSD-3-Clause", _BSD + _NEITHER + _DISCLAIMER))
