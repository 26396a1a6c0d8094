"""License scans: parts of a text compared with license templates by the Dice coefficient of their word bigrams.

A text is lower-cased and everything but letters, digits and line ends becomes a blank. Its parts are each line, each
paragraph of several lines, and the whole. For a part with a distinct bigrams and a template with b, Dice is
2 x common / (a + b), so a match at threshold t needs b t / (2 - t) <= a <= b (2 - t) / t. Three bounds drop parts before any
bigram is made: n words give n - 1 bigrams at most; d different words give d - 1 different bigrams at least; and
as a match has a t / (2 - t) common bigrams at least, and u different words that no template has spoil u / 2 bigrams at least,
u is at most 4 (n - 1) (1 - t) / (2 - t). The bigrams of what is left only meet the templates whose bounds hold their part. The
templates' bigrams are a constant table, which is broadcast; a part's bigrams meet it by equality, so no part is compared with a
template that shares nothing with it. A part counts for its best template. Everything is DataFrame functions.

Templates are short notices, and license texts in ``licenses/``: each as a whole, and each of its paragraphs that has
``LEAST_PARAGRAPH`` bigrams or more. A license without a template isn't found; nor is a notice within a line of other prose.

Defined results: a null or empty text has no matches; a row that is repeated gives its matches once, as
results are by id; columns other than the id and the text aren't read, so their names can't clash; ties between templates of
equal score are all returned.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: (license, text) of notices and short texts.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.",
    ),
    (
        "MIT",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


LEAST_PARAGRAPH = 12


@lru_cache(4096)
def template_bigrams(text: str) -> tuple[str, ...]:
    words = re.findall(r"[^\W_]+", text.lower())
    return tuple(sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}))


def _whole_texts() -> list[tuple[str, str]]:
    """The texts beside this module, and their paragraphs, each once a license."""
    found = []
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        paragraphs = [p for p in re.split(r"\n\s*\n", text) if len(template_bigrams(p)) >= LEAST_PARAGRAPH]
        found += [(path.stem, p) for p in dict.fromkeys([text, *paragraphs])]
    return found


TEMPLATES = (*NOTICES, *_whole_texts())


def _bounds(n: int, t: float) -> tuple[int, int]:
    return math.ceil(n * t / (2 - t) - 1e-9), math.floor(n * (2 - t) / t + 1e-9)


def scan(
    docs: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows of ``id_col``, ``license``, ``dice`` (of its best part) and ``n_parts`` (parts at the threshold or above)."""
    spark = docs.sparkSession
    sizes = [len(template_bigrams(text)) for _, text in templates]
    least, most = min(_bounds(b, threshold)[0] for b in sizes), max(_bounds(b, threshold)[1] for b in sizes)
    vocabulary = sorted({w for _, text in templates for g in template_bigrams(text) for w in g.split()})
    table = spark.createDataFrame(
        [(k, license_, len(grams), *_bounds(len(grams), threshold), " ".join(grams)) for k, (license_, text) in enumerate(templates) for grams in [template_bigrams(text)]],
        "template int, license string, b int, low int, high int, words string",
    )
    # two words each
    grams = F.regexp_extract_all("words", F.lit(r"([^ ]+ [^ ]+)"), F.lit(1))
    known = table.select("template", "license", "b", "low", "high", F.explode(grams).alias("bigram"))

    plain = F.regexp_replace(F.lower(text_col), r"[^\p{L}\p{N}\n]+", " ")
    lines, paragraphs = F.split("plain", "\n"), F.split("plain", r"\n[ \n]*\n")
    several = lambda p: p.contains("\n")
    parts = F.array_distinct(
        F.concat(lines, F.filter(paragraphs, several), F.when(several(F.col("plain")), F.array("plain")).otherwise(F.array().cast("array<string>")))
    )
    words = F.filter(F.split("part", r"[ \n]+"), lambda w: w != "")
    n = F.size("words")
    pairs = F.greatest(n - 1, F.lit(0))  # Spark may make bigrams before it drops short parts
    bigrams = F.array_distinct(
        F.zip_with(F.slice("words", 1, pairs), F.slice("words", F.lit(2), pairs), lambda a, b: F.concat_ws(" ", a, b))
    )
    listed = ", ".join(f"'{w}'" for w in vocabulary)  # letters and digits alone
    strange = F.size(F.array_distinct(F.expr(f"filter(words, w -> w not in ({listed}))")))
    # what is exploded is computed once: of a projection, filters above and the filter that explode implies would repeat it
    return (
        docs.select(F.col(id_col), plain.alias("plain"))
        .select(id_col, F.xxhash64("plain").alias("of"), F.posexplode_outer(parts).alias("at", "part"))
        .filter(F.length("part") > 2 * least)
        .select(id_col, "of", "at", F.explode_outer(F.array(words)).alias("words"))
        .filter((n > least) & (strange <= 4 * (n - 1) * (1 - threshold) / (2 - threshold)))
        .filter(F.size(F.array_distinct("words")) - 1 <= most)
        .select(id_col, "of", "at", F.explode_outer(F.array(bigrams)).alias("bigrams"))
        .select(id_col, "of", "at", F.size("bigrams").alias("a"), F.explode("bigrams").alias("bigram"))
        .join(F.broadcast(known), "bigram")
        .filter(F.col("a").between(F.col("low"), F.col("high")))
        .groupBy(id_col, "of", "at", "a", "template", "license", "b")
        .agg(F.count(F.lit(1)).alias("common"))
        .withColumn("dice", 2.0 * F.col("common") / (F.col("a") + F.col("b")))
        .filter(F.col("dice") >= threshold)
        .withColumn("place", F.rank().over(Window.partitionBy(id_col, "of", "at").orderBy(F.desc("dice"))))
        .filter("place = 1")
        .groupBy(id_col, "license")
        .agg(F.max("dice").alias("dice"), F.count_distinct("of", "at").alias("n_parts"))
    )


def oracle(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.8) -> str:
    """The same in DuckDB's SQL over ``documents``, without the bounds."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {quoted(license_)}, {quoted(text)})" for k, (license_, text) in enumerate(templates))
    return f"""
    WITH templates(template, license, text) AS (VALUES {values}),
    spelt AS (
        SELECT template, license, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS words
        FROM templates),
    listed_templates AS (
        SELECT template, license, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS bigrams FROM spelt),
    known AS (SELECT template, license, len(bigrams) AS b, unnest(bigrams) AS bigram FROM listed_templates),
    plain AS (SELECT DISTINCT doc_id, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS plain FROM documents),
    listed AS (
        SELECT doc_id, list_distinct(list_concat(
            string_split(plain, chr(10)),
            list_filter(string_split_regex(plain, '\\n[ \\n]*\\n'), lambda p: contains(p, chr(10))),
            CASE WHEN contains(plain, chr(10)) THEN [plain] ELSE [] END)) AS parts
        FROM plain),
    parts AS (SELECT doc_id, unnest(parts) AS part FROM listed),
    worded AS (SELECT doc_id, part, list_filter(string_split_regex(part, '[ \\n]+'), lambda w: w <> '') AS words FROM parts),
    grams AS (
        SELECT doc_id, part, unnest(list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS bigram
        FROM worded),
    sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id, part) AS a FROM grams),
    scored AS (
        SELECT doc_id, part, license, 2.0::DOUBLE * count(*) / (any_value(a) + any_value(b)) AS dice
        FROM sized JOIN known USING (bigram) GROUP BY doc_id, part, template, license
        QUALIFY rank() OVER (PARTITION BY doc_id, part ORDER BY dice DESC) = 1)
    SELECT doc_id, license, max(dice) AS dice, count(DISTINCT part) AS n_parts
    FROM scored WHERE dice >= {threshold} GROUP BY doc_id, license
    """
