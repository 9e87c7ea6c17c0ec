"""License scans by canonical digests.

A text's canonical form has its case, punctuation, copyright lines, numbering
and equivalent spellings (within a line) taken away, once for the whole text;
the SHA-256 digest of a unit of it is joined with the digests of known license
texts and notices. What is looked up are entire texts: the whole document, each
of its paragraphs (runs of lines between blank ones), each of its lines, and
runs of paragraphs. A paragraph's digest finds its places in known texts of
several; a run is found where all of a text's paragraphs stand one after the
other, which is counted by text and distance, so the work grows with the
paragraphs and not with the runs. Everything is built-in column expressions.
A text in other wording, or with its paragraphs parted elsewhere, is not found,
nor one whose line break puts "copyright" at the head of a line of its terms.

Defined results: a null text is an empty one; texts whose canonical form is
empty match nothing. Rows repeated or with a null key each give a row. A license
known under two names with one canonical text is listed under both. An empty
table of licenses gives no matches.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.tables import bare
from pageloom.session import materialize

# License texts, a file each: its SPDX identifiers, then ~ and a word where a text has several layouts.
TEXTS = Path(__file__).parent / "license_texts"
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "ISC License (ISC)"], "0BSD": ["BSD Zero Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"]}
TERMS_END = "END OF TERMS AND CONDITIONS"  # an appendix behind it may be missing

# Notices and short license texts, by SPDX identifier.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."],
    "GPL-3.0-only": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3."],
    "GPL-2.0-only": ["This work is licensed under the GNU General Public License, version 2."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License."],
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
}

# Spellings that count as one, on canonical words between spaces.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "authorisation": "authorization", "authorised": "authorized",
    "organisation": "organization", "sublicence": "sublicense", "sub license": "sublicense", "non infringement": "noninfringement",
    "merchantibility": "merchantability", "per cent": "percent", "favour": "favor", "whilst": "while", "v2": "version 2", "v3": "version 3",
}

# Fixed patterns, in the syntax that Java, RE2 and Python share.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n(©]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*\n?"
NUMBERING = r"(?m)^[ \t]*(?:\(?(?:[0-9]{1,2}|[a-z])[.)]|[*•-])[ \t]+"
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text, line by line: words of a line between single spaces."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    out = F.regexp_replace(F.regexp_replace(out, NUMBERING, ""), NOT_WORD, " ")
    out = F.concat(F.lit(" "), F.replace(out, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for other, usual in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {usual} "))
    return out


def digest(form: Column) -> Column:
    """The digest of a unit of a canonical form, null if no word is in it; where its lines end does not count."""
    words = F.trim(F.regexp_replace(form, r"\s+", " "))
    return F.when(words != "", F.sha2(words, 256))


def _layouts(text: str) -> set[str]:
    """A text as it stands, and with each paragraph or numbered item in one line; both also without an appendix."""
    texts = {text, text[: text.find(TERMS_END)], text[: text.find(TERMS_END) + len(TERMS_END)]} if TERMS_END in text else {text}
    return texts | {re.sub(r"\n(?!\n| *(?:\(?(?:[0-9]{1,2}|[a-z])[.)]|[*•-]) )(?<!\n\n) *", " ", t) for t in texts}


def known_licenses(spark: SparkSession) -> DataFrame:
    """The notices above and the texts of the folder ``license_texts`` as a table (``license_id``, ``text``)."""
    texts = [(name, path.read_text()) for path in sorted(TEXTS.glob("*.txt")) for name in path.stem.split("~")[0].split(",")]
    texts = [(name, layout) for name, text in texts for layout in sorted(_layouts(text))] + [("0BSD", NOTICES["0BSD"][0])]
    texts += [(name, f"{title}\n\n{text}") for name, text in texts for title in TITLES.get(name, [])]
    rows = [(name, text) for name, texts in NOTICES.items() for text in texts] + texts
    return spark.createDataFrame(rows, "license_id string, text string")


def _paragraphs(form: Column) -> Column:
    """The paragraphs of a canonical form that hold a word."""
    return F.filter(F.split(form, r"\n *\n", -1), lambda p: F.trim(F.replace(p, F.lit("\n"), F.lit(" "))) != "")


def _known(licenses: DataFrame) -> DataFrame:
    """By digest: ``ids`` of the texts that it is of, and ``runs``, the places it has as a paragraph of texts of several."""
    forms = licenses.select("license_id", canonical(F.col("text")).alias("form")).select("license_id", "form", digest(F.col("form")).alias("unit"))
    forms = forms.filter("unit is not null")
    whole = forms.groupBy("unit").agg(F.array_sort(F.collect_set("license_id")).alias("ids"))
    several = forms.select("license_id", F.transform(_paragraphs(F.col("form")), digest).alias("parts")).filter("size(parts) > 1")
    several = several.groupBy("parts").agg(F.array_sort(F.collect_set("license_id")).alias("ids"))
    several = several.select(F.sha2(F.array_join("parts", ","), 256).alias("of"), "ids", F.size("parts").alias("n"), F.posexplode("parts").alias("place", "unit"))
    runs = several.groupBy("unit").agg(F.collect_list(F.struct("of", "place", "n", "ids")).alias("runs"))
    # One row for each digest, so that a unit joins once; written, so that its size is known.
    return materialize(whole.join(runs, "unit", "full"), "licenses")


def scan_licenses(docs: DataFrame, licenses: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document ``digest``, ``whole_licenses`` (its whole text is one), ``n_matches`` and ``licenses`` found in it.

    A list of licenses is small and Spark broadcasts it by its size; a large one
    is joined by shuffling, where units without a digest are dealt out by row.
    """
    known = _known(licenses)
    read = bare(docs, key, text).toDF("key", "text").withColumn("text", canonical(F.coalesce("text", F.lit(""))))
    lines = F.split("text", r"\n", -1)
    paragraphs = F.filter(F.split("text", r"\n *\n", -1), lambda p: F.instr(p, "\n") > 0)

    def unit(kind: str, u: Column, place: Column | None = None, n: Column | None = None) -> Column:
        nothing = F.lit(None).cast("int")
        return F.struct(F.lit(kind).alias("kind"), u.alias("unit"), (nothing if place is None else place).alias("place"), (nothing if n is None else n).alias("n"))

    none = F.array().cast("array<string>")
    split = F.when(F.col("text").rlike(r"\n *\n"), _paragraphs(F.col("text"))).otherwise(none)
    units = F.concat(
        F.array(unit("whole", F.col("text"))),
        F.transform(F.when(F.instr("text", "\n") > 0, F.concat(lines, paragraphs)).otherwise(none), lambda u: unit("part", u)),
        F.transform(F.when(F.size("split") > 1, F.col("split")).otherwise(none), lambda u, i: unit("run", u, i, F.size("split"))))
    rows = (
        read.withColumn("split", split).withColumn("row", F.monotonically_increasing_id()).select("row", "key", F.explode(units).alias("u"))
        .select("row", "key", "u.kind", "u.place", "u.n", digest(F.col("u.unit")).alias("unit"))
        .withColumn("at", F.coalesce("unit", F.col("row").cast("string"))))
    run = F.col("kind") == "run"
    found = rows.join(known.withColumnRenamed("unit", "at"), "at", "left").filter(~run | F.col("runs").isNotNull())
    # A run's paragraphs keep their distance from those of the known text; the whole document is not a run of its own.
    found = found.select("row", "key", "kind", "unit", "place", "n", F.when(~run, F.col("ids")).alias("ids"), F.explode_outer(F.when(run, F.col("runs"))).alias("r"))
    places = found.groupBy("row", "key", F.col("r.of").alias("of"), (F.col("place") - F.col("r.place")).alias("distance")).agg(
        F.max(F.when(F.col("kind") == "whole", F.col("unit"))).alias("digest"),
        F.max(F.when(F.col("kind") == "whole", F.col("ids"))).alias("whole"),
        F.count_if((F.col("kind") == "part") & F.col("ids").isNotNull()).alias("n_parts"),
        F.collect_set("ids").alias("ids"),
        F.count("r.place").alias("n_places"), F.max("r.n").alias("n_known"), F.max("n").alias("n"), F.max("r.ids").alias("run_ids"))
    complete = (F.col("n_places") == F.col("n_known")) & (F.col("n_known") < F.col("n"))
    # Of runs inside others, such as a text without its title or its appendix, the longest counts.
    far = F.when(F.size("whole") > 0, F.col("n")).otherwise(0)
    counted = F.aggregate("runs", F.struct(F.lit(0).alias("n"), far.alias("far")), lambda s, r: F.when(
        r["start"] - r["less"] > s["far"], F.struct((s["n"] + 1).alias("n"), (r["start"] - r["less"]).alias("far"))).otherwise(s))["n"]
    return places.groupBy("row", "key").agg(
        F.max("digest").alias("digest"), F.max("whole").alias("whole"), F.sum("n_parts").alias("n_parts"), F.coalesce(F.max("n"), F.lit(0)).alias("n"),
        F.array_sort(F.collect_list(F.when(complete, F.struct(F.col("distance").alias("start"), (-F.col("n_known")).alias("less"))))).alias("runs"),
        F.array_distinct(F.concat(F.flatten(F.flatten(F.collect_set("ids"))), F.flatten(F.collect_set(F.when(complete, F.col("run_ids")))))).alias("licenses")
    ).select(
        F.col("key").alias(key), "digest", F.coalesce("whole", none).alias("whole_licenses"),
        (F.col("n_parts") + counted + F.when(F.size("whole") > 0, 1).otherwise(0)).alias("n_matches"), F.array_sort("licenses").alias("licenses"))
