"""The wording of licenses and of the notices that name them, by label.

``[[...]]`` stands around words that may be missing, ``{{n}}`` for up to n words of any kind.
Case and punctuation do not count.
"""

_NO_WARRANTY = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE {{12}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""

_BSD_GRANT = """
Redistribution and use [[of this software]] in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
[[1]] Redistributions of source code must retain the [[above]] copyright notice, this list of conditions and the following disclaimer.
[[2]] Redistributions in binary form must reproduce the [[above]] copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
"""

_BSD_NAMES = """
[[3]] [[Neither the name of {{12}} nor the names of its contributors may be used]] [[The names of {{12}} may not be used]] to endorse or promote products derived from this software
without specific prior written permission.
"""

_BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY {{16}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL {{16}} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""

_GNU_NOTICE = """
[[This]] {{6}} is free software[[;]] you can redistribute it and/or modify it under the terms of the GNU {{1}} General Public License as published by the Free Software Foundation; either version {V}[[.0]] of the License,
or (at your option) any later version. [[This]] {{6}} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {{1}} General Public License for more details.
"""

TEMPLATES = [
    # Whole texts.
    ("mit", """
[[The MIT License]] [[(MIT)]] [[Copyright (c) {{20}}]]
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the Software.
""" + _NO_WARRANTY),
    ("x11", """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
""" + _NO_WARRANTY + """
Except as contained in this notice, the name of {{12}} shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from
"""),
    ("isc", """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND {{8}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{8}} BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""),
    ("0bsd", """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND {{8}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
"""),
    ("bsd-2-clause", _BSD_GRANT + _BSD_WARRANTY),
    ("bsd-3-clause", _BSD_GRANT + _BSD_NAMES + _BSD_WARRANTY),
    ("zlib", """
This software is provided 'as-is', without any express or implied warranty. In no event will the {{1}} be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
[[1]] The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
would be appreciated but is not required. [[2]] Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
[[3]] This notice may not be removed or altered from any source distribution.
"""),
    ("unlicense", """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means.
"""),
    ("bsl-1.0", """
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
"""),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    # Notices that stand for a license kept elsewhere.
    ("apache-2.0", """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this {{3}} except in compliance with the License. You may obtain a copy of the License at {{8}}
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.
"""),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("gpl-2.0", _GNU_NOTICE.replace("{V}", "2")),
    ("gpl-3.0", _GNU_NOTICE.replace("{V}", "3")),
    ("lgpl-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("lgpl-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3[[.0]] of the License, or (at your option) any later version"),
    ("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation[[,]] either version 3[[.0]] of the License, or (at your option) any later version"),
    # Short statements.
    ("apache-2.0", "licensed under the apache license [[version]] 2 0 [[the license]]"),
    ("apache-2.0", "spdx license identifier apache 2 0"),
    ("gpl-2.0", "[[this {{3}} is]] licensed under [[the terms of]] the gnu general public license [[as published by the free software foundation]] [[either]] [[version]] 2 [[0]]"),
    ("gpl-3.0", "[[this {{3}} is]] licensed under [[the terms of]] the gnu general public license [[as published by the free software foundation]] [[either]] [[version]] 3 [[0]]"),
    ("gpl-2.0", "spdx license identifier gpl 2 0 [[or later]] [[only]]"),
    ("gpl-3.0", "spdx license identifier gpl 3 0 [[or later]] [[only]]"),
    ("mit", "[[this {{3}} is]] [[released]] [[licensed]] under the mit license"),
    ("mit", "spdx license identifier mit"),
    ("isc", "spdx license identifier isc"),
    ("bsd-2-clause", "spdx license identifier bsd 2 clause"),
    ("bsd-3-clause", "spdx license identifier bsd 3 clause"),
    ("mpl-2.0", "spdx license identifier mpl 2 0"),
    ("cc-by-4.0", "licensed under [[a {{4}}]] cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under [[a {{4}}]] cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under [[a {{4}}]] cc by sa 4 0"),
    ("cc-by-4.0", "licensed under [[a {{2}}]] creative commons attribution 4 0 [[international]] [[license]]"),
    ("cc0-1.0", "[[to the extent possible under law]] {{12}} has waived all copyright and related or neighboring rights to"),
]
