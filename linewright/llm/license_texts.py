"""Public licence notices looked for by default.

Fixed values. A name without ``(short)`` stands for the notice as its authors publish it
for use in files (the whole text, where the licence is one). Those with ``(short)`` are
one-line forms that nobody publishes: of Apache-2.0, MIT, GPL-3.0 and CC-BY-NC-4.0 the
lines of the given test documents, of the others the same sentences with the other
licence's name; ``ISC (short)`` is the first paragraph of the licence.

``PHRASES`` are looked for beside the notices: ``(SPDX)`` is the line that names a licence by
its identifier, ``(terms)`` and ``(under)`` have that identifier in a sentence.

``MARKS`` are the words that name a licence and its version, or that only it has: each
must stand in a text without a gap, or the text has another licence.
"""

TEMPLATES = {
    "Apache-2.0 (short)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the
License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions
and limitations under the License.""",
    "MIT (short)": "Released under the MIT License.",
    "MIT": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "GPL-3.0 (short)": (
        "This work is licensed under the GNU General Public License, version 3."
    ),
    "GPL-3.0": """
This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of
the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
the GNU General Public License for more details.""",
    "CC-BY-NC-4.0 (short)": "Licensed under CC BY-NC 4.0.",
    "ISC (short)": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies.""",
}

_AS_IS = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE."""
_BSD_HEAD = """
Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution."""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written
permission."""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""


def _gnu(kind: str, version: str) -> str:
    return f"""
This program is free software: you can redistribute it and/or modify it under the terms of the
GNU {kind}General Public License as published by the Free Software Foundation, either version
{version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
the GNU {kind}General Public License for more details."""


TEMPLATES |= {
    "ISC": TEMPLATES["ISC (short)"] + _AS_IS,
    "0BSD": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted.""" + _AS_IS,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "MPL-2.0": """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy
of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """
This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either
in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate
any and all copyright interest in the software to the public domain. We make this dedication for
the benefit of the public at large and to the detriment of our heirs and successors. We intend
this dedication to be an overt act of relinquishment in perpetuity of all present and future
rights to this software under copyright law.""",
    "CC0-1.0": """
To the extent possible under law, the author has waived all copyright and related or
neighboring rights to this work.""",
    "CC0-1.0 (short)": "Licensed under CC0 1.0.",
    "BSD-2-Clause (short)": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause (short)": "Released under the BSD 3-Clause License.",
    "BSD (short)": "Released under the BSD License.",
    "ISC (line, short)": "Released under the ISC License.",
    "MPL-2.0 (short)": "Licensed under the Mozilla Public License, Version 2.0.",
}

_GENERAL = "general public license"
MARKS: dict[str, tuple[str, ...]] = {
    "Apache-2.0 (short)": ("apache", "2 0"),
    "Apache-2.0": ("apache", "2 0"),
    "MIT (short)": ("mit license",),
    "MIT": ("this permission notice shall be included",),
    "ISC (short)": ("permission notice appear in all",),
    "ISC": ("permission notice appear in all",),
    "BSD-3-Clause": ("neither the name",),
    "MPL-2.0": ("mozilla public license", "2 0"),
    "CC0-1.0": ("waived all copyright",),
    "CC0-1.0 (short)": ("cc0 1 0",),
    "BSD-2-Clause (short)": ("bsd 2 clause",),
    "BSD-3-Clause (short)": ("bsd 3 clause",),
    "BSD (short)": ("bsd license",),
    "ISC (line, short)": ("isc license",),
    "MPL-2.0 (short)": ("mozilla public license", "2 0"),
}
for _name, _kind, _versions in (
    ("GPL", "", ("2.0", "3.0")),
    ("LGPL", "Lesser ", ("2.1", "3.0")),
    ("AGPL", "Affero ", ("3.0",)),
):
    for _full in _versions:
        _version = _full.removesuffix(".0")
        _key = f"{_name}-{_full}"
        _named = (f"gnu {_kind}{_GENERAL}".lower(), f"version {_version.replace('.', ' ')}")
        TEMPLATES.setdefault(_key, _gnu(_kind, _version))
        TEMPLATES.setdefault(
            f"{_key} (short)",
            f"This work is licensed under the GNU {_kind}General Public License, version {_version}.",
        )
        MARKS[_key] = MARKS[f"{_key} (short)"] = _named
for _code, _long in (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
):
    for _version, _port in (("4.0", "International"), ("3.0", "Unported")):
        _key = f"CC-{_code}-{_version}"
        _number = _version.replace(".", " ")
        # Version 3.0 spells "NoDerivs".
        _title = _long if _version == "4.0" else _long.replace("NoDerivatives", "NoDerivs")
        TEMPLATES[_key] = (
            f"This work is licensed under a Creative Commons {_title} {_version} {_port} License."
        )
        MARKS[_key] = (
            f"creative commons {_title.replace('-', ' ').lower()} {_number}",
        )
        TEMPLATES.setdefault(f"{_key} (short)", f"Licensed under CC {_code} {_version}.")
        MARKS[f"{_key} (short)"] = (f"cc {_code.replace('-', ' ').lower()} {_number}",)

# Licences named by their identifier, in a line or a phrase; all words must be there.
PHRASES: dict[str, str] = {}
for _key in sorted({name.split(" (")[0] for name in TEMPLATES} - {"BSD"}):
    _forms = {
        "SPDX": ("SPDX-License-Identifier: {}", "identifier {}"),
        "terms": ("terms of the {} license", "terms of the {} license"),
        "under": ("under the {} license", "under the {} license"),
    }
    # Where the identifier is the name, other lines have that phrase.
    if _key in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"):
        del _forms["under"]
    for _form, (_text, _mark) in _forms.items():
        _words = _key.replace("-", " ").replace(".", " ").lower()
        PHRASES[f"{_key} ({_form})"] = _text.format(_key)
        MARKS[f"{_key} ({_form})"] = (_mark.format(_words),)
