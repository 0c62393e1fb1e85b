"""Licence texts, headers and sentences that declare a licence: fixed values, copyright lines left out."""

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following
disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies
or derivative works are solely in the form of machine-executable object code generated by a source language processor."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution. """
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission. """
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER
OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
or implied. See the License for the specific language governing permissions and limitations under the License."""
_APACHE_START = """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND
DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1
through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.
"Legal Entity" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with
that entity."""

_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
means."""

_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_MPL_START = """Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates,
contributes to the creation of, or owns Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of others (if any)
used by a Contributor and that particular Contributor's Contribution."""


def _gnu(kind: str, version: str, library: bool = False) -> str:
    """The notice that the GNU licences ask for in each file."""
    what = "library" if library else "program"
    return (f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as "
            f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {what} "
            "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
            f"FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details.")


def _gnu_start(kind: str, version: str, date: str, first: str = "") -> str:
    return (f"GNU {kind} PUBLIC LICENSE Version {version}, {date} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and "
            f"distribute verbatim copies of this license document, but changing it is not allowed. {first}")


def _gnu_texts(kind: str, version: str, date: str, first: str, library: bool = False) -> tuple[str, ...]:
    header = _gnu(kind, version, library)
    return (f"This work is licensed under the GNU {kind} Public License, version {version}.",
            f"Licensed under the GNU {kind} Public License v{version}.", header, header.split(" This program is distributed")[0].split(" This library is distributed")[0],
            _gnu_start(kind, version, date, first))


def _creative(code: str, name: str) -> tuple[str, ...]:
    return (f"Licensed under CC {code} 4.0.", f"This work is licensed under a Creative Commons {name} 4.0 International License.",
            f"This work is licensed under the Creative Commons {name} 4.0 International License. To view a copy of this license, visit "
            f"http://creativecommons.org/licenses/{code.lower()}/4.0/ or send a letter to Creative Commons, PO Box 1866, "
            "Mountain View, CA 94042, USA.",
            f"Creative Commons {name} 4.0 International Public License By exercising the Licensed Rights (defined below), You accept and agree to be "
            f"bound by the terms and conditions of this Creative Commons {name} 4.0 International Public License (\"Public License\"). To the extent "
            "this Public License may be interpreted as a contract, You are granted the Licensed Rights in consideration of Your acceptance of these "
            "terms and conditions, and the Licensor grants You such rights in consideration of benefits the Licensor receives from making the "
            "Licensed Material available under these terms and conditions.")


_FREE = "Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."
_AFFERO = ("Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed "
           "to ensure cooperation with the community in the case of network server software.")
_OLD = ("Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public "
        "License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.")
_OLD_LESSER = ("This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, "
               "hence the version number 2.1.")
_LESSER = ("This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public "
           "License, supplemented by the additional permissions listed below.")

#: licences that resemble each other stand side by side, so that the closer one is found
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": _gnu_texts("Affero General", "3", "19 November 2007", _AFFERO),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", _APACHE_HEADER, _APACHE_HEADER.split("You may obtain")[0], _APACHE_START),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", _BSD_START + _BSD_END),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted",
                     "Licensed under the BSD 3-Clause License.", _BSD_START + _BSD_THIRD + _BSD_END),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", _BOOST),
    "CC-BY-4.0": _creative("BY", "Attribution"),
    "CC-BY-NC-4.0": _creative("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-ND-4.0": _creative("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _creative("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": _creative("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-SA-4.0": _creative("BY-SA", "Attribution-ShareAlike"),
    "GPL-2.0": _gnu_texts("General", "2", "June 1991", _OLD),
    "GPL-3.0": _gnu_texts("General", "3", "29 June 2007", _FREE),
    "ISC": ("Released under the ISC License.", _ISC),
    "LGPL-2.1": _gnu_texts("Lesser General", "2.1", "February 1999", _OLD_LESSER, library=True),
    "LGPL-3.0": _gnu_texts("Lesser General", "3", "29 June 2007", _LESSER),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", _MIT),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", _MPL_HEADER, _MPL_START),
    "Unlicense": (_UNLICENSE,),
}
