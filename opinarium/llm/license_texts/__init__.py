"""Whole license texts and the usual short notices of public licenses.

Each entry is ``(license, text, marks)``. Marks are runs of three words that a hit
must hold whatever else is missing: the words that tell near templates apart.
"""

from pathlib import Path

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. """
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_AGPL_13 = """Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software."""

# File, license and marks of the texts beside this module.
_FILES = [
    ("apache-2.0", "apache-2.0", []),
    ("gpl-2", "gpl-2.0", []),
    ("gpl-3", "gpl-3.0", ["13 use with"]),
    ("lgpl-2", "lgpl-2.0", ["gnu library general"]),
    ("lgpl-2.1", "lgpl-2.1", ["gnu lesser general"]),
    ("lgpl-3", "lgpl-3.0", ["gnu lesser general"]),
    ("mpl-2.0", "mpl-2.0", []),
]
_GNU = {
    "gpl": ("GNU General Public License", "gnu general public", ["1", "2", "3"]),
    "lgpl": ("GNU Lesser General Public License", "gnu lesser general", ["2.1", "3"]),
    "agpl": ("GNU Affero General Public License", "gnu affero general", ["3"]),
}
_CC = ["", "-NonCommercial", "-ShareAlike", "-NoDerivatives", "-NonCommercial-ShareAlike", "-NonCommercial-NoDerivatives"]
_SHORT = {"-NonCommercial": "-nc", "-ShareAlike": "-sa", "-NoDerivatives": "-nd"}
_NAMES = {
    "mit": ["under the MIT License", "terms of the MIT License", "under MIT License", "under an MIT License", "The MIT License (MIT)", "MIT License Copyright (c)"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0"],
    "isc": ["under the ISC License", "terms of the ISC License", "under ISC License", "ISC License Copyright (c)"],
    "bsd-2-clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "bsd-3-clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "mpl-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"],
}
_SPDX = ["MIT", "ISC", "Apache-2.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause"]


def _notices():
    for family, (name, mark, versions) in _GNU.items():
        for v in versions:
            license = f"{family}-{v if '.' in v else v + '.0'}"
            for form in {v, license.split("-")[1]}:
                yield license, f"{name} version {form}", [mark, f"license version {form}"]
                yield license, f"{name} v{form}", [mark, f"public license v{form}"]
                yield license, f"{name} {form}", [mark, f"public license {form}"]
                yield license, f"GNU {family} v{form}", []
                yield license, f"GNU {family} version {form}", []
            published = f"under the terms of the {name} as published by the Free Software Foundation"
            yield license, f"{published}, either version {v} of the License, or (at your option) any later version", [mark, f"either version {v}"]
            yield license, f"{published}; version {v}", [mark, f"foundation version {v}"]
            yield license, f"under the terms of version {v} of the {name}", [mark, f"version {v} of"]
            yield license, f"SPDX-License-Identifier: {license}", []
    for kind in _CC:
        short = "by"
        for word, code in _SHORT.items():
            short += code if word in kind else ""
        # The letters of these licenses come in the order nc, nd or sa.
        for version, port in (("4.0", "International"), ("3.0", "Unported"), ("2.0", "Generic")):
            yield f"cc-{short}-{version}", f"Creative Commons Attribution{kind} {version}", []
            yield f"cc-{short}-{version}", f"Creative Commons Attribution{kind} {version} {port} License", []
            yield f"cc-{short}-{version}", f"CC {short} {version}", []
    for license, texts in _NAMES.items():
        for text in texts:
            yield license, text, []
    for name in _SPDX:
        yield name.lower(), f"SPDX-License-Identifier: {name}", []


def entries() -> list[tuple[str, str, list[str]]]:
    here = Path(__file__).parent
    whole = [(license, (here / f"{file}.txt").read_text(encoding="utf-8"), marks) for file, license, marks in _FILES]
    whole += [("mit", _MIT, []), ("isc", _ISC, []), ("bsd-2-clause", _BSD_HEAD + _BSD_TAIL, []), ("agpl-3.0", _AGPL_13, [])]
    whole += [("bsd-3-clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL, ["neither the name"])]
    return whole + sorted(set((a, b, tuple(c)) for a, b, c in _notices()))
