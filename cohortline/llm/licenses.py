"""Licence scans by canonical digests, in DataFrame expressions only.

A text is brought to one form: lower case A-Z, copyright lines left out, equivalent spellings
made one, everything but letters and digits a single space. The SHA-256 of that form is
joined to the digests of known licences. A whole document and each of its lines are looked
up as entire texts, so a one-line notice inside a document is found as well. A full text
inside a longer document is found as a run of whole lines, however these are wrapped.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortline.core.workspace import materialise
from cohortline.llm.common import id_and_text, join_small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rule of the SQL, which also takes lines of a licence's body that a wrap begins with such words.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}©(]*(copyright|\(c\)|©|all rights reserved)"
#: Words after "copyright" in the body of licences; a name of a holder doesn't begin with them.
_BODY_WORDS = (
    "acts?|and|applies|are|as|at|claims?|conditions?|disclaimers?|doctrines?|for|from|has|holders?|if|in|infringement|interests?|is|"
    "laws?|licen[cs]e[esd]*|licensors?|line|management|may|notices?|of|on|or|owners?|ownership|permissions?|resulting|the (library|program|software|work)|"
    "protections?|restrictions?|rights?|shall|statements?|status|terms?|that|to|treat(y|ies)|under|will|with"
)
#: Lines that name a holder of rights and differ from one copy of a licence to the next: a mark
#: with a year or holder. "(c)" alone may be an item of a list, so it needs a year or a firm.
NOTICE_LINE = (
    r"^[^\p{L}\p{N}©(]*(?:all rights reserved|©|copyright\s*(?:\(c\)|©|:)"
    rf"|copyright\s+(?!(?:{_BODY_WORDS})(?![\p{{L}}\p{{N}}]))[\p{{L}}\p{{N}}<\[{{(]"
    r"|\(c\)\s*(?:copyright|\d{4}|.{0,60}\b(?:inc|ltd|llc|corp|corporation|gmbh|foundation|authors|contributors)\b))"
)
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Spellings that count as equal, applied in this order.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("https:", "http:"),
    ("&", " and "),
)

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
    "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD '
    "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN "
    "NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
    "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
    "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Licence texts and notices, as published.
LICENSES = (
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining "
        'a copy of this software and associated documentation files (the "Software"), to deal '
        "in the Software without restriction, including without limitation the rights to use, "
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject "
        "to the following conditions:\n\nThe above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY,
    ),
    (
        "ISC",
        "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for "
        "any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY,
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted.\n\n" + _ISC_WARRANTY,
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no "
        "event will the authors be held liable for any damages arising from the use of this "
        "software.\n\nPermission is granted to anyone to use this software for any purpose, "
        "including commercial applications, and to alter it and redistribute it freely, subject "
        "to the following restrictions:\n\n1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use "
        "this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required.\n2. Altered source versions must be plainly marked as "
        "such, and must not be misrepresented as being the original software.\n3. This notice "
        "may not be removed or altered from any source distribution.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)


#: Known by their full texts in ``license_texts``, as published.
PUBLISHED = ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")
#: Headings under which short texts are published; each text is known without one as well.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD (0BSD)"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"),
}
#: Texts of at least so many words are looked for inside documents.
FULL_WORDS = 40


def _bsd(clauses: int, marks: tuple[str, ...], liable: str) -> str:
    conditions = (
        "Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used "
        "to endorse or promote products derived from this software without specific prior "
        "written permission.",
    )
    listed = "\n\n".join(f"{mark} {text}" for mark, text in zip(marks, conditions[:clauses]))
    return (
        "Redistribution and use in source and binary forms, with or without modification, are "
        f"permitted provided that the following conditions are met:\n\n{listed}\n\n"
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY '
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
        f"THE COPYRIGHT {liable} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
        "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
        "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    )


def full_texts() -> list[tuple[str, str]]:
    """``license_id, text`` of the short texts without and with titles, and of the published ones."""
    bodies = []
    for name, text in LICENSES:
        if len(text.split()) >= FULL_WORDS:
            head, _, rest = text.partition("\n\n")
            bodies.append((name, rest if head in TITLES[name] else text))
    for liable in ("HOLDER", "HOLDERS", "OWNER"):
        for marks in (("1.", "2.", "3."), ("*", "*", "*")):
            bodies += [("BSD-2-Clause", _bsd(2, marks, liable)), ("BSD-3-Clause", _bsd(3, marks, liable))]
    found = [(n, head + text) for n, text in bodies for head in ("", *(t + "\n\n" for t in TITLES[n]))]
    folder = files("cohortline.llm") / "license_texts"
    for name in PUBLISHED:
        text = (folder / f"{name}.txt").read_text(encoding="utf-8")
        found.append((name, text))
        # Also without the advice on its use that follows the terms.
        terms, end, advice = text.partition("END OF TERMS AND CONDITIONS")
        if advice:
            found += [(name, terms + end), (name, terms)]
    return found


def line_form(line: Column) -> Column:
    """The canonical form of one line whose A-Z are in lower case; empty for a notice of copyright."""
    form = line
    for found, written in SPELLINGS:
        form = F.replace(form, F.lit(found), F.lit(written))
    form = F.trim(F.regexp_replace(form, NOT_WORD, " "))
    return F.when(line.rlike(NOTICE_LINE), F.lit("")).otherwise(form)


def line_forms(text: Column) -> Column:
    """Canonical forms of the lines that have one, in order."""
    lines = F.split(F.translate(text, UPPER, LOWER), "\n", -1)
    return F.filter(F.transform(lines, line_form), lambda form: form != "")


def digest(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def known_digests(licenses: DataFrame) -> DataFrame:
    """``digest, license_id`` of ``license_id, text``; the first id by name for equal texts."""
    form = F.array_join(line_forms(F.col("text")), " ")
    known = licenses.filter("text is not null").select("license_id", form.alias("form"))
    known = known.filter("form != ''").groupBy(digest(F.col("form")).alias("digest"))
    return known.agg(F.min("license_id").alias("license_id"))


def inner_texts(licenses: DataFrame) -> DataFrame:
    """``license_id, form`` of the full texts, without those that hold another of their licence."""
    form = F.array_join(line_forms(F.col("text")), " ")
    full = licenses.filter("text is not null").select("license_id", form.alias("form")).distinct()
    full = full.filter(F.size(F.split("form", " ")) >= FULL_WORDS)
    other = full.select(F.col("license_id").alias("_id"), F.col("form").alias("_form"))
    same = (F.col("license_id") == F.col("_id")) & (F.col("form") != F.col("_form"))
    return full.join(other, same & F.contains(F.col("form"), F.col("_form")), "left_anti")


def _whole_lines(forms: Column, joined: Column, form: Column) -> Column:
    """Whether ``form`` is a run of whole lines of ``forms``, which ``joined`` has in one."""
    size = F.greatest(F.size(forms), F.lit(1))
    ends = F.transform(F.sequence(F.lit(1), size), lambda i: F.length(F.array_join(F.slice(forms, F.lit(1), i), " ")))

    def found(i: Column) -> Column:
        start = F.when(i == 1, 1).otherwise(F.length(F.array_join(F.slice(forms, F.lit(1), i - 1), " ")) + 2)
        last = start + F.length(form) - 1
        return (F.substr(joined, start, F.length(form)) == form) & F.array_contains(ends, last)

    return F.exists(F.sequence(F.lit(1), size), found)


def built_in(spark: SparkSession) -> DataFrame:
    known = dict.fromkeys([*LICENSES, *full_texts()])
    return spark.createDataFrame(list(known), "license_id string, text string")


def scan_licenses(
    docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, digest, license_id, line_licenses`` of every row of ``docs``.

    ``license_id`` is the licence whose text the whole document is, else null;
    ``line_licenses`` lists those that one of its lines is, and those whose full text (of at
    least ``FULL_WORDS`` words) is a run of lines of a document that isn't a known text as a
    whole, each once and in order, joined by commas (empty if none). A null or empty text, or one of copyright lines only, has
    the digest of the empty text and no licence. Repeated rows keep one row each and find
    the same; a null id keeps its row.

    ``licenses`` is joined by digest; it is broadcast within the bound of rows, else
    shuffled. Lines without a known digest never leave their task in the first case.
    """
    known = materialise(known_digests(licenses), "digests")
    inner = materialise(inner_texts(licenses), "inner-texts")
    formed = id_and_text(docs, id_col, text_col).withColumn("forms", line_forms(F.col("text")))
    read = formed.select(
        "doc_id",
        F.xxhash64("doc_id", "text").alias("row"),
        digest(F.array_join("forms", " ")).alias("digest"),
        F.transform("forms", digest).alias("lines"),
    )
    whole = known.withColumnRenamed("license_id", "whole_id")
    read = join_small(read, whole, "digest", "left")
    # Only rows with a line that may be known go into the second step.
    lines = read.select("row", F.explode(F.array_distinct("lines")).alias("digest"))
    found = join_small(lines, known, "digest").select("row", "license_id")
    held = formed.select(
        F.xxhash64("doc_id", "text").alias("row"), "forms", F.array_join("forms", " ").alias("joined")
    )
    # Lines are only looked at where the text is held at all.
    forms, joined, form = F.col("forms"), F.col("joined"), F.col("form")
    runs = F.when(F.contains(joined, form), _whole_lines(forms, joined, form)).otherwise(F.lit(False))
    held = held.join(F.broadcast(inner), runs)
    held = held.withColumn("digest", digest(joined))
    held = join_small(held, known.select("digest"), "digest", "left_anti").select("row", "license_id")
    found = found.union(held).groupBy("row").agg(
        F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("line_licenses")
    )
    found = materialise(found, "line-licenses")
    return join_small(read, found, "row", "left").select(
        "doc_id",
        "digest",
        F.col("whole_id").alias("license_id"),
        F.coalesce("line_licenses", F.lit("")).alias("line_licenses"),
    )
