"""Passages of public licences and the identifiers that name them, for ``licenses``."""

from __future__ import annotations

# Passages of the public licences' own texts, which name the licence by themselves. After a passage, the phrases
# without which it isn't that licence; where none are given, its first and its last five words.
PASSAGES: list[tuple[str, ...]] = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
     "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
     "furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
     "disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-2-clause", "and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
     "CONTRIBUTORS \"AS IS\"", "provided with the distribution this software is provided by"),
    ("bsd-3-clause", "nor the names of its contributors may be used to endorse or promote products derived from this software without "
     "specific prior written permission"),
    ("bsd-4-clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable "
     "copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the "
     "Work and such Derivative Works in Source or Object form"),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the "
     "License", "gnu general public license", "version 2 of the license"),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
     "License", "gnu general public license", "version 3 of the license"),
    ("gpl-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU "
     "General Public License is intended to guarantee your freedom to share and change free software"),
    ("gpl-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
     "gnu lesser general public license"),
    ("lgpl", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General "
     "Public License, supplemented by the additional permissions listed below"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
     "gnu affero general public license"),
    ("agpl", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically "
     "designed to ensure cooperation with the community in the case of network server software"),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0"),
    ("isc", "for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
     "appear in all copies"),
    ("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
     "accompanying documentation covered by this license"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
     "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("cc0", "Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of "
     "Affirmer's Copyright and Related Rights"),
    ("epl", "the accompanying program is provided under the terms of this Eclipse Public License"),
]

# Identifiers after "SPDX-License-Identifier:", and their labels.
IDENTIFIERS = {
    "MIT": "mit", "Apache-2.0": "apache-2.0", "BSD-2-Clause": "bsd-2-clause", "BSD-3-Clause": "bsd-3-clause", "GPL-2.0": "gpl-2.0",
    "GPL-3.0": "gpl-3.0", "LGPL": "lgpl", "AGPL": "agpl", "MPL-2.0": "mpl-2.0", "ISC": "isc", "Zlib": "zlib", "BSL-1.0": "bsl-1.0",
    "Unlicense": "unlicense", "CC0-1.0": "cc0", "CC-BY-NC": "cc-by-nc", "CC-BY-SA": "cc-by-sa", "CC-BY-ND": "cc-by-nd", "EPL": "epl",
}
