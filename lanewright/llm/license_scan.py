"""Licence scan by canonical digest: a text's canonical form is hashed whole and joined to digests of known texts.

The canonical form is lower case, without copyright notices, with one spelling for equivalent words, and with every run
of other characters than letters and digits as one space. The unit is an entire text: a whole document, and each whole
line (a licence notice stands on a line of its own).

A copyright notice is a line that starts with the sign, "(c)" or the word *and* goes on with a year or the sign, or one that
starts with "all rights reserved"; a line of a licence's body that happens to start with "copyright" is none. The licences'
own notices of the Free Software Foundation go wherever they stand in a line. So the form is the same however a body's lines
are broken, as long as a notice stays on one line and nothing else is put on that line.

A document's notices are joined back by the MD5 of its text, so copies share one row there.

Defined cases: null or empty text, or one of punctuation only, has an empty canonical form, digest null and no licence;
repeated rows give equal rows; if several known texts share a digest the least licence name counts; an empty table
gives an empty result; very long texts are hashed whole; other columns are ignored.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.llm.common import broadcast_if_small, texts, written

#: Rows of notices by text that are broadcast at most.
BROADCAST_ROWS = 200_000

# Words that licence texts spell in several ways, and the spelling kept.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("colour", "color"),
    ("customisation", "customization"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("merchantibility", "merchantability"),
    ("noninfringement", "non infringement"),
    ("organisation", "organization"),
    ("programme", "program"),
    ("recognise", "recognize"),
    ("v2", "version 2"),
    ("v3", "version 3"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
# Whole licence texts that come without a file.
BODIES = (
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _WARRANTY),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
)
# The names by which notices call a licence, and the sentences that notices are made of.
NAMES = (
    ("MIT", ("MIT License", "MIT")),
    ("ISC", ("ISC License", "ISC")),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0")),
    ("GPL-2.0", ("GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0")),
    ("GPL-3.0", ("GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0")),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3", "LGPL-3.0")),
    ("MPL-2.0", ("Mozilla Public License, version 2.0", "MPL-2.0")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "BSD-2-Clause")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "BSD-3-Clause")),
    ("CC0-1.0", ("CC0 1.0", "CC0-1.0")),
    ("CC-BY-4.0", ("CC BY 4.0", "Creative Commons Attribution 4.0 International License")),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License")),
)
SENTENCES = ("Released under {}", "Licensed under {}", "Distributed under {}", "This work is licensed under {}", "This project is licensed under {}", "This software is licensed under {}", "This file is licensed under {}", "SPDX-License-Identifier: {}")
# Notices that name a licence by a sentence of their own.
OTHER_NOTICES = (("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."), ("Unlicense", "This is free and unencumbered software released into the public domain."))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Removed in this order: the foundation's notice in the text of its licences, then lines that are notices.
FSF_NOTICE = r"copyright[^0-9a-z\n]*(\(c\)|©)?[^0-9a-z\n]*[0-9][^a-z\n]*free software foundation(, inc)?"
COPYRIGHT_LINE = r"(^|\n)[^0-9a-z\n]*(copyright[ \t:]*(\(c\)|©)?[ \t]*([0-9][0-9]|[\[{(<]?yyyy|[\[{(]year|<year>[ \t,]*<(owner|holder|copyright|full))|copyright[ \t]*©|copyright[ \t]*\(c\)[ \t]+(the [a-z]|by [a-z])|\(c\)[ \t]*(copyright|[0-9][0-9][0-9][0-9])|©|all rights reserved)[^\n]*"
NOT_WORD = r"[^0-9a-z\n\x{80}-\x{10FFFF}]+"

# Files of whole texts, their own leading title lines, and titles that stand before texts without one.
FILES = (
    ("Apache-2.0", 3, ()),
    ("BSD-2-Clause", 0, ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License")),
    ("CC-BY-SA-4.0", 2, ("Creative Commons Attribution-ShareAlike 4.0 International Public License",)),
    ("CC0-1.0", 2, ("CC0 1.0 Universal",)),
    ("GPL-2.0", 2, ()),
    ("GPL-3.0", 2, ()),
    ("LGPL-3.0", 2, ()),
    ("MPL-2.0", 2, ()),
    ("Unlicense", 0, ("The Unlicense", "Unlicense")),
)
TITLES = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"), "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"), "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License")}
FSF = "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
FSF_OTHERS = ("59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "<https://fsf.org/>", "")
CLAUSE_3 = "3. Neither the name of the {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def _whole() -> list[tuple[str, str]]:
    """Whole texts with and without title, appendix and numbers, with http or https, in their usual addresses; line breaks do not matter."""
    texts: list[tuple[str, str]] = [(license, f"{title}\n{x}") for license, x in BODIES for title in ("", *TITLES[license])]
    for name, own, titles in FILES:
        full = (Path(__file__).parent / "licenses" / f"{name}.txt").read_text().strip("\n")
        bare = "\n".join([x for x in full.split("\n") if x.strip()][own:])
        bodies = [full, bare, *(f"{title}\n{bare}" for title in titles)]
        bodies += [m[0] for x in (full, bare) if (m := re.match(r"(?s).*END OF TERMS AND CONDITIONS", x))]
        bodies += [x.replace(a, b) for x in bodies for a, b in (("http:", "https:"), ("https:", "http:"))]
        if name == "GPL-2.0":
            bodies += [x.replace(FSF, other, 1) for x in bodies for other in FSF_OTHERS] + [x.replace(FSF, FSF_OTHERS[0]) for x in bodies]
        if name == "CC0-1.0":
            bodies += [x.replace("Creative Commons Legal Code", "", 1) for x in bodies]
        texts += [(name, x) for x in bodies]
        if name == "BSD-2-Clause":
            before, after = bare.split("THIS SOFTWARE IS PROVIDED")
            for holder in ("copyright holder", "copyright holders"):
                texts += [("BSD-3-Clause", "\n".join((title, before, CLAUSE_3.format(holder), f"THIS SOFTWARE IS PROVIDED{after}"))) for title in ("", *TITLES["BSD-3-Clause"])]
            regents = after.replace("THE COPYRIGHT HOLDERS AND", "THE REGENTS AND").replace("THE COPYRIGHT HOLDER OR", "THE REGENTS OR")
            texts += [("BSD-3-Clause", "\n".join((title, before, CLAUSE_3.format("University"), f"THIS SOFTWARE IS PROVIDED{regents}"))) for title in ("", *TITLES["BSD-3-Clause"])]
    texts += [(license, re.sub(r"(?m)^[123]\. ", "", x)) for license, x in texts if license.startswith("BSD")]
    return list(dict.fromkeys(texts))


WHOLE = tuple(_whole())
KNOWN = WHOLE + OTHER_NOTICES + tuple((license, sentence.format(article + name)) for license, names in NAMES for name in names for sentence in SENTENCES for article in ("", "the ", "a ", "the terms of the "))


def canonical_lines(rows: DataFrame, out: str = "forms") -> DataFrame:
    """Adds the canonical forms of the lines of `text` that have any; joined by blanks they are the form of the whole text.

    A column per step, so that each step is computed once. Words stand apart by two blanks until spellings are replaced.
    """
    rows = rows.withColumn(out, F.translate("text", UPPER, LOWER))
    x = F.col(out)
    # The pattern runs only over texts that can match it.
    some = F.contains(x, F.lit("copyright")) | F.contains(x, F.lit("(c)")) | F.contains(x, F.lit("©")) | F.contains(x, F.lit("all rights"))
    rows = rows.withColumn(out, F.when(some, F.regexp_replace(F.regexp_replace(x, FSF_NOTICE, ""), COPYRIGHT_LINE, "$1")).otherwise(x))
    x = F.concat(F.lit(" "), F.replace(F.regexp_replace(out, NOT_WORD, "  "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for other, kept in SPELLINGS:
        x = F.replace(x, F.lit(f" {other} "), F.lit(f" {kept} "))
    return rows.withColumn(out, F.array_remove(F.transform(F.split(F.replace(x, F.lit("  "), F.lit(" ")), "\n"), lambda line: F.trim(line)), ""))


def digest(form: Column) -> Column:
    return F.when(form != "", F.sha2(form, 256))


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    rows = canonical_lines(spark.createDataFrame(list(known), "license string, text string"))
    rows = rows.select(digest(F.array_join("forms", " ")).alias("digest"), "license")
    return rows.where("digest is not null").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, digest and license of the whole text, and notices: the licences of its lines."""
    spark = docs.sparkSession
    # The built-in table is a fixed list of rows; a caller's own is joined as Spark sees fit.
    known = F.broadcast(known_digests(spark)) if known is None else known
    rows = canonical_lines(texts(docs).withColumn("key", F.md5("text")))
    # One pass: each document's first line carries the digest of the whole; other lines stay only if they are known.
    lines = rows.select("doc_id", "key", digest(F.array_join("forms", " ")).alias("digest"), F.posexplode_outer("forms").alias("at", "form"))
    lines = lines.withColumn("line", F.sha2("form", 256)).join(known.select(F.col("digest").alias("line"), F.col("license").alias("notice")), "line", "left")
    first = F.coalesce("at", F.lit(0)) == 0
    lines = written(lines.where(first | F.col("notice").isNotNull()).select("doc_id", "key", F.when(first, F.col("digest")).alias("digest"), first.alias("first"), "notice"))
    found = lines.where("notice is not null").groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("notice")), ",").alias("notices"))
    whole = lines.where("first").select("doc_id", "key", "digest").join(known, "digest", "left")
    out = whole.join(broadcast_if_small(found, BROADCAST_ROWS), "key", "left")
    return out.select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))
