"""Known licences by the digest of their canonical text.

Two texts that differ in case, punctuation, white space, copyright lines or in spellings that
licence matching treats as equal have one canonical text and one digest, so a scan is a hash join of
digests. A document is looked up as a whole, and each of its lines as a whole too, which finds the
one-line notices that documents carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorkit.llm.rows import named
from anchorkit.operators.joins import balanced_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Typographic signs read as punctuation beside the ASCII ones.
SIGNS = "‘’“”–—•… «»"
#: Letters and digits: ASCII ones in lower case, and the blocks of other scripts.
LETTERS = "a-z0-9\u00c0-\u1fff\u2c00-\U0010ffff"
#: Words after "copyright" or "(c)" in the body of a licence, where no holder is named.
_BODY = ("notices? holders? owners? ownership laws? licen[cs]e[sd]? licensors? statements? acts? treat(?:y|ies) interests? protections? "
         "infringements? information claims? disclaimers? rights? patents? trademarks? materials? works? software programs? and or in to on "
         "as for that which this shall may must will but").split()
_ITEM = "the you your any all an? if it its each every no not when where use uses".split()
_NEXT = f"[^{LETTERS}\n]*(?:{'|'.join(_BODY)})(?![{LETTERS}])"
#: A line that states a holder: a line of a licence's body may begin with "copyright" too, depending on where it is wrapped.
HOLDER_LINE = (
    rf"(^|\n)[^a-z0-9\n]*(copyright(s|ed)?(?![a-z0-9])(?=[^\n]*[©{LETTERS}])(?!{_NEXT})"
    rf"|\(c\)((?=[^\n]*(19|20)[0-9]{{2}}(?![0-9]))|(?=[^\n]*[{LETTERS}])(?!{_NEXT}|[^{LETTERS}\n]*(?:{'|'.join(_ITEM)})(?![{LETTERS}])))"
    r"|©|all rights reserved)[^\n]*")
#: Spellings treated as equal, whole words of canonical text, in this order.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("sub licenses", "sublicenses"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"),
    ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("honour", "honor"),
    ("merchantibility", "merchantability"), ("copyright owner", "copyright holder"), ("per cent", "percent"),
    ("whilst", "while"), ("http", "https"),
]

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC_TERMS = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted")
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE.")
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.\n")
#: Public licence texts without their copyright lines, and the usual one-line notices.
KNOWN = [
    ("MIT", "MIT License\n\n" + (_MIT := (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY))),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", _MIT),
    ("ISC", "ISC License\n\n" + (_ISC := (
        _ISC_TERMS + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY))),
    ("ISC", _ISC),
    ("0BSD", _ISC_TERMS + ".\n\n" + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_TERMS + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_TERMS + (
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.\n") + _BSD_WARRANTY),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
]


def _plain(text: Column) -> Column:
    """Lower case without lines that state a holder; in a line, two spaces stand for each run of other signs than letters and digits."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), HOLDER_LINE, "\n")
    return F.regexp_replace(low, f"[^{LETTERS}\n]+", "  ")


def _joined(plain: Column) -> Column:
    """The lines of a plain text as one line between spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, r"[ \n]+", "  ")), F.lit(" "))


def _respelled(plain: Column) -> Column:
    """Canonical text of a plain one; the two spaces let neighbouring words both be replaced."""
    for other, word in SPELLINGS:
        plain = F.replace(plain, F.lit(f" {'  '.join(other.split())} "), F.lit(f" {'  '.join(word.split())} "))
    return F.trim(plain)


def canonical(text: Column) -> Column:
    """Canonical text: lower case, no copyright lines, punctuation and white space as one gap, equal spellings as one."""
    return _respelled(_joined(_plain(text)))


def digest(text: Column) -> Column:
    """Hex SHA-256 of the canonical text."""
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | DataFrame = KNOWN) -> DataFrame:
    """(digest, licence, plain) of licence texts given as pairs or as a table (licence, text).

    Texts that are empty once canonical name no licence. Several licences with one digest: the first by name.
    """
    if not isinstance(known, DataFrame):
        known = spark.createDataFrame(known, "licence string, text string")
    pairs = known.where(F.col("licence").isNotNull()).select("licence", canonical(F.col("text")).alias("plain")).where("plain <> ''")
    return pairs.groupBy(F.sha2(F.col("plain").cast("binary"), 256).alias("digest")).agg(
        F.min("licence").alias("licence"), F.first("plain").alias("plain"))


def _heads(known: DataFrame) -> list[str]:
    """First words with which a text can begin that has a known canonical text: one word per known text at most."""
    heads = {r[0] for r in known.select(F.substring_index("plain", " ", 1)).distinct().collect()}
    while more := {o.split()[0] for o, w in SPELLINGS if w.split()[0] in heads} - heads:
        heads |= more
    return sorted(heads)


def scan_licences(df: DataFrame, known: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``df`` with the columns ``keep`` (default: all but ``text``) and

    * ``licence``: the known licence whose text the whole document is, else null (null and empty texts too);
    * ``digest``: its digest, else null;
    * ``notices``: licences stated by a line of its own, distinct, sorted, joined by ``;``, else null;
    * ``n_notices``: lines that state one (long).

    Kept columns with these names are replaced. Texts and lines meet the digests one by one and are
    summed up where they were read, so texts aren't shuffled; ``known`` is broadcast only when measured
    small, otherwise frequent lines are joined apart (:func:`balanced_join`). What begins with a word
    that begins no known text equals none and isn't hashed.
    """
    own = {"digest", "licence", "notices", "n_notices"}
    keep = [c for c in (keep or [c for c in df.columns if c != text]) if c.lower() not in own]
    rows = df.select(F.monotonically_increasing_id().alias("row_no"), F.struct(F.lit(0).alias("_"), *[
        named(df, c).alias(c) for c in keep]).alias("kept"), _plain(named(df, text)).alias("plain"))
    units = rows.select("row_no", "kept", F.posexplode(F.concat(F.array("plain"), F.split("plain", "\n"))).alias("place", "unit"))
    head = F.substring_index(F.regexp_extract("unit", r"^[ \n]*([^ \n]*)", 1), " ", 1)
    units = units.select("row_no", "kept", (F.col("place") == 0).alias("is_whole"), "unit", head.isin(_heads(known)).alias("can_be"))
    units = units.where("is_whole or can_be").select("row_no", "kept", "is_whole", F.when(F.col("can_be"), F.sha2(
        _respelled(_joined(F.col("unit"))).cast("binary"), 256)).alias("digest"))
    met = balanced_join(units, known.select("digest", "licence"), ["digest"], "left")
    whole, line = F.col("is_whole"), ~F.col("is_whole")
    out = met.groupBy("row_no").agg(
        F.first("kept").alias("kept"), F.max(F.when(whole & F.col("licence").isNotNull(), F.col("digest"))).alias("digest"),
        F.max(F.when(whole, F.col("licence"))).alias("licence"),
        F.collect_set(F.when(line, F.col("licence"))).alias("names"),
        F.count(F.when(line, F.col("licence"))).alias("n_notices"))
    return out.select(*[F.col("kept").getField(c).alias(c) for c in keep], "digest", "licence", F.when(
        F.size("names") > 0, F.array_join(F.array_sort("names"), ";")).alias("notices"), "n_notices")
