"""Licence scans by canonical digest: texts are normalised, hashed and hash-joined to the digests of known licences.

Normalising drops copyright notices (but no line of a sentence that happens to begin with the word), lower-cases, unifies equivalent spellings and keeps letters and digits only, with one blank
between words. A document is looked up as an entire text, and so is each of its blocks: its lines, and its paragraphs between lines
without letters or digits. A block is hashed only if a known block is as long, which loses none. All lookups are one hash join with
the registry, a constant of this module or of the caller.

The registry knows entire licences by text (TEXTS, whose paragraphs of MIN_WORDS words and more are blocks too, unless licences
share them), further ones by the digest of their published text alone (DIGESTS), and notices that stand for a licence (NOTICES).

Defined cases: null, empty and markless texts have the digest of the empty text and no licence; repeated rows are scanned one by
one; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Wording of public licences and notices; <owner> and <year> lines are dropped by the normalising.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ZERO_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Entire licence texts, by SPDX identifier.
TEXTS: dict[str, tuple[str, ...]] = {
    "BSD-2-Clause": (_BSD_2 + _BSD_WARRANTY, "BSD 2-Clause License\n\n" + _BSD_2 + _BSD_WARRANTY),
    "BSD-3-Clause": (_BSD_2 + _BSD_3 + _BSD_WARRANTY, "BSD 3-Clause License\n\n" + _BSD_2 + _BSD_3 + _BSD_WARRANTY),
    "MIT": ("MIT License\n\n" + _MIT_GRANT, "The MIT License (MIT)\n\n" + _MIT_GRANT, _MIT_GRANT),
    "ISC": ("ISC License\n\n" + _ISC_GRANT + "\n\n" + _ISC_WARRANTY, _ISC_GRANT + "\n\n" + _ISC_WARRANTY),
    "0BSD": ("BSD Zero Clause License\n\n" + _ZERO_GRANT + "\n\n" + _ISC_WARRANTY, _ZERO_GRANT + "\n\n" + _ISC_WARRANTY),
    "Zlib": ("zlib License\n\n" + _ZLIB, _ZLIB),
}
#: Digests of the canonical form of published licences, entire and up to the end of their terms, by SPDX identifier.
DIGESTS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6", "f9138026e58bdb767e6c6e974637ff9aacbaedf2695e30fef144e5d7d84448ff", "6fb8411669deea22294b6190fad00b8e39899d0b7b6c5cf97a3b15b47e129c38",),
    "Artistic-1.0-Perl": ("e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",),
    "CC0-1.0": ("cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",),
    "GFDL-1.2": ("15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b",),
    "GFDL-1.3": ("2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d",),
    "GPL-1.0": ("8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70",),
    "GPL-2.0": ("efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808",),
    "GPL-3.0": ("eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191",),
    "LGPL-2.0": ("61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2",),
    "LGPL-2.1": ("4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df",),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-1.1": ("cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6",),
    "MPL-2.0": ("f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",),
}
#: Words from which a paragraph of a known text is a block of its own.
MIN_WORDS = 20
#: Notices that stand for a licence on a line of their own, by SPDX identifier.
NOTICES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."),
}
#: Equivalent spellings, after lower-casing: the left is written as the right.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licenc", "licens"),
    ("sub[^\\p{L}\\p{N}]{1,12}licens", "sublicens"),
    ("non[^\\p{L}\\p{N}]{1,12}commercial", "noncommercial"),
    ("non[^\\p{L}\\p{N}]{1,12}infringement", "noninfringement"),
    ("merchantib", "merchantab"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("https:", "http:"),
    ("&", " and "),
)
#: A registry, and its digests at most, as it is sent to every executor.
KNOWN, MOST_KNOWN = "kind string, digest string, licence string, length int", 50_000
#: A line is a copyright notice if it begins with the sign, with (c) and a year, with the word and then a sign, a year or a place to
#: fill in, or with the word and reserves all rights; and so is a paragraph of one line that begins with the word.
NOTICE_LINE = (
    "(?m)^[^\\p{L}\\n(©<\\[{]*(?:©[^\\n]*|\\(c\\)[ :,]*(?:copyright|[0-9<\\[{])[^\\n]*|copyright[ :,]*(?:©|\\(c\\)|[0-9<\\[{])[^\\n]*"
    "|copyright[^\\n]*all rights reserved[^\\n]*|all rights reserved[^\\p{L}\\n]*)$"
)
NOTICE_PARAGRAPH = "(^[^\\p{L}\\p{N}]*|\\n[^\\p{L}\\p{N}\\n]*\\n)[^\\p{L}\\p{N}\\n]*copyright [^\\n]*(\\n[^\\p{L}\\p{N}\\n]*\\n|$)"


def canonical_lines(text: Column) -> Column:
    """The normalised text with its line ends; what the others derive from."""
    # (?d): only a line feed ends a line, as in the SQL form.
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?d)" + NOTICE_LINE, " ")
    out = F.regexp_replace(out, "(?d)" + NOTICE_PARAGRAPH, "$1$2")
    for old, new in SPELLINGS:
        out = F.regexp_replace(out, old, new)
    return F.regexp_replace(out, "[^\\p{L}\\p{N}\n]+", " ")


def _flat(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \n]+", " "))


def canonical(text: Column) -> Column:
    return _flat(canonical_lines(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def blocks(lines: Column) -> Column:
    """Canonical forms of the lines and paragraphs of a text in canonical lines."""
    return F.array_distinct(F.concat(F.transform(F.split(lines, "\n"), lambda x: F.trim(x)), F.transform(F.split(lines, "\n(?: *\n)+"), _flat)))


def registry(spark: SparkSession, texts: dict[str, tuple[str, ...]] | None = None, notices: dict[str, tuple[str, ...]] | None = None, digests: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(kind, digest, licence, length): entire texts and blocks of known licences, one row per kind and digest.

    Of texts that differ in what normalising drops, the first identifier stays. Blocks that several licences have are left out.
    """
    texts, notices, digests = (own if given is None else given for own, given in ((TEXTS, texts), (NOTICES, notices), (DIGESTS, digests)))
    given = [(kind, name, t) for kind, table in (("text", texts), ("notice", notices)) for name, own in sorted(table.items()) for t in own]
    rows = spark.createDataFrame(given, "kind string, licence string, text string").withColumn("lines", canonical_lines(F.col("text")))
    whole = rows.select("kind", "licence", _flat(F.col("lines")).alias("form"))
    parts = rows.filter("kind = 'text'").select(F.lit("block").alias("kind"), "licence", F.explode(blocks(F.col("lines"))).alias("form")).filter(F.size(F.split("form", " ")) >= MIN_WORDS)
    known = whole.unionByName(parts).groupBy("kind", "form").agg(F.min("licence").alias("licence"), F.countDistinct("licence").alias("n"))
    known = known.filter("form <> '' and (kind <> 'block' or n = 1)")
    known = known.select(F.when(F.col("kind") == "text", "text").otherwise("block").alias("kind"), F.sha2("form", 256).alias("digest"), "licence", F.length("form").alias("length")).distinct()
    more = [("text", d, name, None) for name, own in sorted(digests.items()) for d in own]
    return known.unionByName(spark.createDataFrame(more, KNOWN))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, text_digest, licence, whole, notices: one row per document.

    ``licence`` is that of the entire text (whole is true), else that which the blocks name if they name one alone; ``notices`` are the
    sorted licences of all blocks. ``known`` is a registry; its size is that of a constant or of the caller's table, and is checked.
    """
    known = registry(docs.sparkSession) if known is None else known
    rows = known.select("kind", "digest", "licence", "length").limit(MOST_KNOWN + 1).collect()
    if len(rows) > MOST_KNOWN:
        raise ValueError(f"a registry has at most {MOST_KNOWN} digests")
    sent = F.broadcast(docs.sparkSession.createDataFrame(rows, KNOWN).select("kind", "digest", F.col("licence").alias("found")))
    lengths = sorted({r["length"] for r in rows if r["kind"] == "block"})
    lines = docs.select(F.col("doc_id").alias("doc_id"), F.monotonically_increasing_id().alias("row"), canonical_lines(F.col("text")).alias("lines"))
    likely = F.filter(blocks(F.col("lines")), lambda x: F.length(x).isin(lengths)) if lengths else F.array().cast("array<string>")
    units = F.concat(F.array(F.struct(F.lit("text").alias("kind"), F.sha2(_flat(F.col("lines")), 256).alias("digest"))), F.transform(likely, lambda x: F.struct(F.lit("block").alias("kind"), F.sha2(x, 256).alias("digest"))))
    looked = lines.select("doc_id", "row", F.explode(units).alias("u")).select("doc_id", "row", "u.kind", "u.digest").join(sent, ["kind", "digest"], "left")
    own = F.col("kind") == "text"
    met = looked.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max(F.when(own, F.col("digest"))).alias("text_digest"),
        F.max(F.when(own, F.col("found"))).alias("entire"),
        F.sort_array(F.collect_set(F.when(~own, F.col("found")))).alias("notices"),
    )
    licence = F.coalesce("entire", F.when(F.size("notices") == 1, F.col("notices")[0]))
    return met.select("doc_id", "text_digest", licence.alias("licence"), F.col("entire").isNotNull().alias("whole"), "notices")
