"""Licence templates: notices made by rule from the licences' names, and the wording of headers and short licences."""

from __future__ import annotations

#: Licence id, name as notices have it, and the words of it that a notice can't do without (fixed values).
NAMES = (
    ("Apache-2.0", "Apache License, Version 2.0", "apache license"),
    ("MIT", "MIT License", "mit license"),
    ("BSD-2-Clause", "BSD 2-Clause License", "bsd 2"),
    ("BSD-3-Clause", "BSD 3-Clause License", "bsd 3"),
    ("ISC", "ISC License", "isc license"),
    ("Zlib", "zlib License", "zlib license"),
    ("Unlicense", "Unlicense", "unlicense"),
    ("BSL-1.0", "Boost Software License, Version 1.0", "boost"),
    ("GPL-2.0", "GNU General Public License, version 2", "gnu general 2"),
    ("GPL-3.0", "GNU General Public License, version 3", "gnu general 3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1", "lesser 2 1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3", "lesser 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3", "affero 3"),
    ("MPL-2.0", "Mozilla Public License, version 2.0", "mozilla 2"),
    ("EPL-2.0", "Eclipse Public License 2.0", "eclipse 2"),
    ("CC0-1.0", "CC0 1.0 Universal", "cc0"),
)
#: Parts of Creative Commons licences: short and long.
CC_PARTS = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
CC_VERSIONS = ("3.0", "4.0")

_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
_MIT_REST = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
_GNU_HEADER = "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
#: Wording by licence id, and the words that it can't do without (fixed values: the licences' own wording).
WORDINGS = (
    ("Apache-2.0", "apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "", _MIT_GRANT),
    ("MIT", "", f"{_MIT_GRANT}: {_MIT_REST}"),
    ("BSD-2-Clause", "redistribution", f"{_BSD_GRANT}: {_BSD_TWO} {_BSD_REST}"),
    ("BSD-3-Clause", "redistribution", _BSD_GRANT),
    ("BSD-3-Clause", "redistribution neither", f"{_BSD_GRANT}: {_BSD_TWO} {_BSD_THREE} {_BSD_REST}"),
    ("ISC", "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."),
    ("Zlib", "", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("GPL-2.0", "gnu general 2", _GNU_HEADER.format(name="GNU General Public License", version="2")),
    ("GPL-3.0", "gnu general 3", _GNU_HEADER.format(name="GNU General Public License", version="3")),
    ("LGPL-3.0", "lesser 3", _GNU_HEADER.format(name="GNU Lesser General Public License", version="3")),
    ("AGPL-3.0", "affero 3", _GNU_HEADER.format(name="GNU Affero General Public License", version="3")),
    ("GPL-3.0", "gnu general", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("MPL-2.0", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "eclipse", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC0-1.0", "cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 public domain dedication"),
    ("Proprietary", "rights reserved", "All rights reserved"),
    ("Proprietary", "rights reserved", "Copyright. All rights reserved. No part of this publication may be reproduced or distributed without the prior written permission of the publisher."),
)


def templates() -> list[tuple[str, str, str]]:
    """(licence, words that must occur, text) of every template."""
    out = []
    for licence, name, must in NAMES:
        out += [(licence, must, f"Licensed under the {name}"), (licence, must, f"Released under the {name}"), (licence, must, f"This work is licensed under the {name}")]
        out.append((licence, "spdx " + licence, f"SPDX-License-Identifier: {licence}"))
    for short, long in CC_PARTS:
        for version in CC_VERSIONS:
            licence = f"CC-{short}-{version}"
            out += [(licence, licence, f"Licensed under CC {short} {version}"), (licence, "spdx " + licence, f"SPDX-License-Identifier: {licence}")]
            out.append((licence, f"commons {long} {version}", f"This work is licensed under a Creative Commons {long} {version} International License"))
    return out + [(licence, must, text) for licence, must, text in WORDINGS]
