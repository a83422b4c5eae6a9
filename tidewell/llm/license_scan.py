"""Licence scans: whole texts in a canonical form, joined by digest to known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: In Spark's patterns only a line feed ends a line, as in others' without this.
UNIX = "(?d)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines that name the holder of the rights, which differ from copy to copy, and lines that only reserve them.
COPYRIGHT_LINE = (
    r"(?m)^[^A-Za-z0-9\n]*((?i:copyright)[\x20\x09]*((?i:\(c\))|\x{00A9}|[0-9][0-9][0-9][0-9]|(?i:<year>|\[year\]|\[yyyy\]))|(?i:\(c\))|\x{00A9})[^\n]*"
    r"|(?m)^[^A-Za-z0-9\n]*(?i:copyright)[\x20\x09]+((?i:by)[\x20\x09]+)?([A-Z][a-z][^\x20\n]*|and|of|the|&|[A-Z]\.)([\x20\x09,]+([A-Z][^\x20\n]*|and|of|the|&|<[^>\n]*>))*[\x20\x09]*$"
    r"|(?m)^[^A-Za-z0-9\n]*(?i:all rights reserved)[^A-Za-z0-9\n]*$"
)
#: What lists begin their entries with.
LIST_MARK = r"(?m)^[\x20\x09]*(\(?([0-9]|[a-h]|i|ii|iii|iv|v|vi)[.)]|[*\x{2022}\x{00B7}-])[\x20\x09]+"
#: Spellings that count as equal, after punctuation has become blanks.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("https ", "http "), ("organisation", "organization"), ("favour", "favor"), ("honour", "honor"), ("noninfringement", "non infringement"), ("copyright owner", "copyright holder"), ("copyright holder s ", "copyright holders "), ("per cent", "percent"),
    ("whilst", "while"), ("acknowledgement", "acknowledgment"), ("modelled", "modeled"), ("analyse", "analyze"), ("judgement", "judgment"), ("fulfil ", "fulfill "), ("labour", "labor"), ("merchantibility", "merchantability"), ("sub licensable", "sublicensable"), ("wilful", "willful"),
)
#: A table of known licences is broadcast up to so many rows; beyond, it is joined by shuffling.
BROADCAST_ROWS = 20_000

_WARRANTY_MIT = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_WARRANTY_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_WARRANTY_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
_APACHE_NOTICE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'

_BOOST = 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_UNLICENSE = 'This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\nFor more information, please refer to <https://unlicense.org>'
_WTFPL = "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n0. You just DO WHAT THE FUCK YOU WANT TO."
_GPL_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the {name} Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} Public License for more details.\nYou should have received a copy of the {name} Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
_MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."

#: The public texts of short licences with the titles that copies may have, and short statements that name one.
_TEXTS = (
    ("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License", "The Expat License"), _MIT + _WARRANTY_MIT),
    ("ISC", ("ISC License", "The ISC License", "ISC License (ISC)"), _ISC + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _WARRANTY_ISC),
    ("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD"), _ISC + ".\n" + _WARRANTY_ISC),
    ("BSD-2-Clause", ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", "Simplified BSD License", "FreeBSD License"), _BSD_2 + _WARRANTY_BSD),
    ("BSD-3-Clause", ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "New BSD License", "Modified BSD License"), _BSD_2 + _BSD_3 + _WARRANTY_BSD),
    ("Zlib", ("zlib License", "The zlib License", "zlib/libpng License"), _ZLIB),
    ("BSL-1.0", ("Boost Software License", "Boost Software License - Version 1.0 - August 17th, 2003"), _BOOST),
    ("Unlicense", ("The Unlicense", "Unlicense"), _UNLICENSE),
    ("WTFPL", (), _WTFPL),
    ("Apache-2.0", (), _APACHE_NOTICE),
    ("GPL-2.0-or-later", (), _GPL_NOTICE.format(name="GNU General", n="2")),
    ("GPL-3.0-or-later", (), _GPL_NOTICE.format(name="GNU General", n="3")),
    ("LGPL-3.0-or-later", (), _GPL_NOTICE.format(name="GNU Lesser General", n="3")),
    ("AGPL-3.0-or-later", (), _GPL_NOTICE.format(name="GNU Affero General", n="3")),
    ("MPL-2.0", (), _MPL_NOTICE),
    ("Apache-2.0", (), "Licensed under the Apache License, Version 2.0."),
    ("MIT", (), "Released under the MIT License."),
    ("CC-BY-NC-4.0", (), "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-only", (), "This work is licensed under the GNU General Public License, version 3."),
)
KNOWN = tuple((name, f"{title}\n{text}" if title else text) for name, titles, text in _TEXTS for title in ("", *titles))
#: SHA-256 of the canonical form of the full texts that are too long to hold here. tests/llm computes them again where the texts are at hand.
KNOWN_DIGESTS = (
    ("Apache-2.0", "0767a15f6a1414801c4a78b00ef7542aed022f93a0169cf370643bf41adbfa4c"),
    ("Artistic-1.0-Perl", "bab936ce959e6cc79ba3d1891ba2e5fe421a5894e1b8bb42f223b937f48c9b1e"),
    ("BSD-3-Clause-UC", "d0a339eb5454123c6a1f2696aace557e0561866f3fe33b93ffad58ecfcab7060"),
    ("CC0-1.0", "063ef9425f02eb7190286db98f8241f0ad967c5bb544922e83e734b66cf84f54"),
    ("GFDL-1.2", "2fc7c57afb46646224f7b696b1d0f3e16b239bf1c862711cc7eee1d1b82ba33d"),
    ("GFDL-1.3", "13f1404160e93f61830e40325c75a1b0e0d4023d6d07a6b5f0f4aab31f5c6982"),
    ("GPL-1.0", "61f0e225c6539f1efb9b6e261f07ac1bff52ceab2094210d8b149e4c4e8aa8e7"),
    ("GPL-2.0", "715b4321661b12ef1d65fa94b4555c8bda4744a8ccd7d61179051d09373b23ee"),
    ("GPL-3.0", "f7a3495b88d59e8f7cff0226a44e0a4fed01957896497becceb83abf7596a4be"),
    ("LGPL-2.0", "757dcc30152d17bd1b04fb0d8048f77818d11a4a34e63300f9bd894fbc0950d9"),
    ("LGPL-2.1", "3b9412172917f8c82dfd39a2da4e651c57b9600fedd1dd4f896b2bfd89b4048f"),
    ("LGPL-3.0", "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45"),
    ("MPL-1.1", "e6730200ab596a1b0bce2cd4765e8c2f606271d2da197eea0240bc7b1242b38b"),
    ("MPL-2.0", "e49c097eaea4be93cf84c757a662f4e84dc1d6539440b79129467af8f3e5d489"),
)


def canonical(text: Column) -> Column:
    """The canonical form; null for null.

    Copyright lines go, and what lists begin their entries with; A-Z are lower-cased, punctuation and blanks become single blanks, and
    equal spellings one. A text without a letter or digit is empty.
    """
    out = F.regexp_replace(F.regexp_replace(text, UNIX + COPYRIGHT_LINE, ""), UNIX + LIST_MARK, "")
    out = F.concat(F.lit(" "), F.regexp_replace(F.translate(out, UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{00A0}-\x{00BF}\x{2010}-\x{2027}]+", " "), F.lit(" "))
    for one, other in SPELLINGS:
        out = F.replace(out, F.lit(one), F.lit(other))
    return F.trim(F.regexp_replace(out, "  +", " "))


def known_licenses(spark: SparkSession) -> DataFrame:
    """license_id and license_text of the built-in texts; those of KNOWN_DIGESTS are known by digest only."""
    return spark.createDataFrame(list(KNOWN), "license_id string, license_text string")


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, canonical_chars, digest and license_id, null where the whole text is no known licence.

    known: license_id and license_text; by default the built-in table and KNOWN_DIGESTS. Of several licences with one canonical form the smallest id holds;
    those that are empty in canonical form or have a null are ignored. The digest is the SHA-256 of the canonical form, null for a null
    text and for one without a letter or digit, which match nothing. Repeated rows and null ids are passed through.
    """
    built_in = known is None
    known = known_licenses(docs.sparkSession) if built_in else known
    form = canonical(F.col("license_text"))
    table = known.where("license_id IS NOT NULL").select("license_id", form.alias("form")).where("form <> ''").groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))
    if built_in:
        table = table.union(docs.sparkSession.createDataFrame([(digest, name) for name, digest in KNOWN_DIGESTS], "digest string, license_id string"))
    if known.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    out = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col)).alias("form"))
    out = out.select("doc_id", F.coalesce(F.length("form"), F.lit(0)).cast("long").alias("canonical_chars"), F.when(F.col("form") != "", F.sha2("form", 256)).alias("digest"))
    # texts without a digest have keys of their own, which nothing matches, so that they are not all one key
    out = out.withColumn("key", F.coalesce("digest", F.md5(F.col("doc_id").cast("string")), F.lit("")))
    return out.join(table.withColumnRenamed("digest", "key"), "key", "left").select("doc_id", "canonical_chars", "digest", "license_id")
