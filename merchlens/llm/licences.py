"""Licence scan by sentence rules.

A text is cut into sentences, each is normalised and looked up among known licence
sentences.  The identifiers of the recognised sentences, in order, are then matched
against licence rules, which are ordered sequences of identifiers.  A rule matches
where its identifiers follow each other; sentences that are not known, such as copyright
lines, and reservations may stand between.

Everything is a column expression over one row: no join, no shuffle, whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.llm.registry import query, read

# --- Fixed values: licence sentences, normalised (lower case, words only) -------------
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "distributed under the mit license": "mit-notice",
    "spdx license identifier mit": "mit-tag",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "licensed under the apache license version 2 0": "apache-notice",
    "licensed under the apache license version 2 0 the license": "apache-notice",
    "spdx license identifier apache 2 0": "apache-tag",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "licensed under the gnu general public license version 3": "gpl3-notice",
    "released under the gnu general public license version 3": "gpl3-notice",
    "spdx license identifier gpl 3 0 only": "gpl3-tag",
    "spdx license identifier gpl 3 0 or later": "gpl3-later-tag",
    "spdx license identifier gpl 2 0 only": "gpl2-tag",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later-grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "either version 3 of the license or at your option any later version": "gpl3-later",
    "either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-warranty",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-fitness",
    "see the gnu general public license for more details": "gpl-see",
    "licensed under cc by 4 0": "cc-by-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-notice",
    "licensed under cc by nd 4 0": "cc-by-nd-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-notice",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-terms",
    "spdx license identifier mpl 2 0": "mpl-tag",
    "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form": "apache-grant",
    "released under the apache license version 2 0": "apache-notice",
    "this work is licensed under the gnu general public license version 2": "gpl2-notice",
    "licensed under the gnu general public license version 2": "gpl2-notice",
    "released under the gnu general public license version 2": "gpl2-notice",
    "spdx license identifier gpl 2 0 or later": "gpl2-later-tag",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-terms",
    "either version 2 1 of the license or at your option any later version": "lgpl21-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later-grant",
    "licensed under the gnu lesser general public license version 2 1": "lgpl21-notice",
    "licensed under the gnu lesser general public license version 3": "lgpl3-notice",
    "released under the gnu lesser general public license version 3": "lgpl3-notice",
    "spdx license identifier lgpl 2 1 only": "lgpl21-tag",
    "spdx license identifier lgpl 2 1 or later": "lgpl21-later-tag",
    "spdx license identifier lgpl 3 0 only": "lgpl3-tag",
    "spdx license identifier lgpl 3 0 or later": "lgpl3-later-tag",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-later-grant",
    "licensed under the gnu affero general public license version 3": "agpl3-notice",
    "released under the gnu affero general public license version 3": "agpl3-notice",
    "spdx license identifier agpl 3 0 only": "agpl3-tag",
    "spdx license identifier agpl 3 0 or later": "agpl3-later-tag",
    "licensed under cc0 1 0": "cc0-notice",
    "released under cc0 1 0": "cc0-notice",
    "dedicated to the public domain under cc0 1 0": "cc0-notice",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-waiver",
    "spdx license identifier cc0 1 0": "cc0-tag",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-notice",
    "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license": "cc-by-nc-sa-notice",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd-notice",
    "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license": "cc-by-nc-nd-notice",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "cc-by-nd-notice",
    "licensed under the bsd 3 clause license": "bsd3-notice",
    "released under the bsd 3 clause license": "bsd3-notice",
    "spdx license identifier bsd 3 clause": "bsd3-tag",
    "licensed under the bsd 2 clause license": "bsd2-notice",
    "released under the bsd 2 clause license": "bsd2-notice",
    "spdx license identifier bsd 2 clause": "bsd2-tag",
    "licensed under the isc license": "isc-notice",
    "released under the isc license": "isc-notice",
    "spdx license identifier isc": "isc-tag",
    "all rights reserved": "reserved",
}
# Licence, rule and its identifiers in order; a rule of fewer sentences than the text of
# the licence has is a notice of it.
RULES = [
    ("MIT", "mit-text", ["mit-grant", "mit-notice-condition", "mit-warranty"]),
    ("MIT", "mit-notice", ["mit-notice"]),
    ("MIT", "mit-tag", ["mit-tag"]),
    ("Apache-2.0", "apache-header", ["apache-notice", "apache-compliance", "apache-copy", "apache-warranty"]),
    ("Apache-2.0", "apache-notice", ["apache-notice"]),
    ("Apache-2.0", "apache-tag", ["apache-tag"]),
    ("GPL-3.0-or-later", "gpl3-header", ["gpl-terms", "gpl3-later", "gpl-warranty"]),
    ("GPL-3.0-or-later", "gpl3-grant", ["gpl3-later-grant"]),
    ("GPL-3.0-or-later", "gpl3-later-tag", ["gpl3-later-tag"]),
    ("GPL-2.0-or-later", "gpl2-header", ["gpl-terms", "gpl2-later", "gpl-warranty"]),
    ("GPL-3.0-only", "gpl3-notice", ["gpl3-notice"]),
    ("GPL-3.0-only", "gpl3-tag", ["gpl3-tag"]),
    ("GPL-2.0-only", "gpl2-tag", ["gpl2-tag"]),
    ("CC-BY-4.0", "cc-by-notice", ["cc-by-notice"]),
    ("CC-BY-SA-4.0", "cc-by-sa-notice", ["cc-by-sa-notice"]),
    ("CC-BY-NC-4.0", "cc-by-nc-notice", ["cc-by-nc-notice"]),
    ("CC-BY-ND-4.0", "cc-by-nd-notice", ["cc-by-nd-notice"]),
    ("BSD-3-Clause", "bsd3-text", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", "bsd2-text", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("ISC", "isc-text", ["isc-grant"]),
    ("Unlicense", "unlicense-text", ["unlicense-grant"]),
    ("MPL-2.0", "mpl-notice", ["mpl-terms"]),
    ("MPL-2.0", "mpl-tag", ["mpl-tag"]),
    ("Apache-2.0", "apache-text", ["apache-grant"]),
    ("GPL-2.0-only", "gpl2-notice", ["gpl2-notice"]),
    ("GPL-2.0-or-later", "gpl2-later-tag", ["gpl2-later-tag"]),
    ("LGPL-2.1-or-later", "lgpl21-header", ["lgpl-terms", "lgpl21-later"]),
    ("LGPL-2.1-or-later", "lgpl21-later-tag", ["lgpl21-later-tag"]),
    ("LGPL-2.1-only", "lgpl21-notice", ["lgpl21-notice"]),
    ("LGPL-2.1-only", "lgpl21-tag", ["lgpl21-tag"]),
    ("LGPL-3.0-or-later", "lgpl3-grant", ["lgpl3-later-grant"]),
    ("LGPL-3.0-or-later", "lgpl3-later-tag", ["lgpl3-later-tag"]),
    ("LGPL-3.0-only", "lgpl3-notice", ["lgpl3-notice"]),
    ("LGPL-3.0-only", "lgpl3-tag", ["lgpl3-tag"]),
    ("AGPL-3.0-or-later", "agpl3-grant", ["agpl3-later-grant"]),
    ("AGPL-3.0-or-later", "agpl3-later-tag", ["agpl3-later-tag"]),
    ("AGPL-3.0-only", "agpl3-notice", ["agpl3-notice"]),
    ("AGPL-3.0-only", "agpl3-tag", ["agpl3-tag"]),
    ("CC0-1.0", "cc0-notice", ["cc0-notice"]),
    ("CC0-1.0", "cc0-waiver", ["cc0-waiver"]),
    ("CC0-1.0", "cc0-tag", ["cc0-tag"]),
    ("CC-BY-NC-SA-4.0", "cc-by-nc-sa-notice", ["cc-by-nc-sa-notice"]),
    ("CC-BY-NC-ND-4.0", "cc-by-nc-nd-notice", ["cc-by-nc-nd-notice"]),
    ("BSD-3-Clause", "bsd3-notice", ["bsd3-notice"]),
    ("BSD-3-Clause", "bsd3-tag", ["bsd3-tag"]),
    ("BSD-2-Clause", "bsd2-notice", ["bsd2-notice"]),
    ("BSD-2-Clause", "bsd2-tag", ["bsd2-tag"]),
    ("ISC", "isc-notice", ["isc-notice"]),
    ("ISC", "isc-tag", ["isc-tag"]),
]
# May stand between the sentences of a rule.
PASSED_OVER = ("reserved",)
# --------------------------------------------------------------------------------------

# A sentence ends with a mark before white space, a colon before a line end, or a blank line.
BOUNDARY = r"([.;!?])\s+|(:)[ \t]*\n\s*|\n[ \t\r]*\n"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def recognised(text: Column) -> Column:
    """array<struct<sentence:int,line:int,id:string>> of the known sentences, in order.

    ``sentence`` counts from 0.  A sentence over several lines is looked up whole (line 0)
    and line by line (from 1): notices often stand on a line of their own without a stop.
    """
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])

    def lookup(sentence):
        return F.try_element_at(known, normalised(sentence))

    def places(sentence, i):
        whole = F.array(F.struct(i.alias("sentence"), F.lit(0).alias("line"), lookup(sentence).alias("id")))
        lines = F.transform(
            F.split(sentence, "\n"),
            lambda x, j: F.struct(i.alias("sentence"), (j + 1).alias("line"), lookup(x).alias("id")),
        )
        return F.when(F.contains(sentence, F.lit("\n")), F.concat(whole, lines)).otherwise(whole)

    sentences = F.split(F.regexp_replace(text, BOUNDARY, "$1$2\x01"), "\x01")
    return F.filter(F.flatten(F.transform(sentences, places)), lambda p: p.id.isNotNull())


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, licence, rule, n_matches, first_sentence, last_sentence), one row per document row and rule that matches.

    ``n_matches`` counts matches that do not overlap; the first one goes from ``first_sentence`` to
    ``last_sentence``.  Any number of unknown sentences may stand between those of a rule,
    so the span says how far apart they are.  Texts without a known sentence, null and empty texts give no row.  Other
    columns are ignored.
    """
    found = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), recognised(F.col(f"`{text}`")).alias("found"))
    core = found.select(
        "doc_id", F.filter("found", lambda p: ~p.id.isin(*PASSED_OVER)).alias("core")
    ).filter(F.size("core") > 0)
    sequence = F.array_join(F.transform("core", lambda p: F.concat(F.lit("<"), p.id, F.lit(">"))), "")
    rules = F.array(
        *[
            F.struct(
                F.lit(licence).alias("licence"),
                F.lit(rule).alias("rule"),
                F.lit("".join(f"<{i}>" for i in ids)).alias("pattern"),
                F.lit(len(ids)).alias("n_ids"),
            )
            for licence, rule, ids in RULES
        ]
    )
    hits = core.withColumn("sequence", sequence).withColumn("r", F.explode(rules))
    hits = hits.filter(F.contains("sequence", F.col("r.pattern")))
    before = F.expr("substring_index(sequence, r.pattern, 1)")
    first = F.size(F.split(before, "<")) - 1
    return hits.select(
        "doc_id",
        "r.licence",
        "r.rule",
        (
            (F.length("sequence") - F.length(F.replace("sequence", F.col("r.pattern"), F.lit(""))))
            / F.length("r.pattern")
        ).cast("bigint").alias("n_matches"),
        F.get("core", first).sentence.cast("bigint").alias("first_sentence"),
        F.get("core", first + F.col("r.n_ids") - 1).sentence.cast("bigint").alias("last_sentence"),
    )


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)


OP5_SQL = rf"""
WITH known(norm, id) AS (VALUES {_values(list(SENTENCES.items()))}),
rules(licence, rule, pattern, n_ids) AS (VALUES {_values([(a, b, "".join(f"<{i}>" for i in c), len(c)) for a, b, c in RULES])}),
parts AS (SELECT doc_id, string_split(regexp_replace(text, '{BOUNDARY}', '\1\2' || chr(1), 'g'), chr(1)) AS parts
  FROM documents WHERE text IS NOT NULL),
sentences AS (SELECT doc_id, unnest(generate_series(1, len(parts))) AS i, unnest(parts) AS s FROM parts),
lines AS (
  SELECT doc_id, i, 0 AS j, s FROM sentences
  UNION ALL
  SELECT doc_id, i, unnest(generate_series(1, len(string_split(s, chr(10))))) AS j, unnest(string_split(s, chr(10))) AS s
  FROM sentences WHERE contains(s, chr(10))),
core AS (
  SELECT doc_id, i, j, id FROM (SELECT *, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS norm FROM lines) l
  JOIN known k ON l.norm = k.norm WHERE id <> 'reserved'),
seq AS (
  SELECT doc_id, string_agg('<' || id || '>', '' ORDER BY i, j) AS sequence, list(i - 1 ORDER BY i, j) AS places
  FROM core GROUP BY doc_id)
SELECT doc_id, licence, rule, n_matches, CAST(places[first] AS BIGINT) AS first_sentence,
       CAST(places[first + CAST(n_ids AS INT) - 1] AS BIGINT) AS last_sentence
FROM (SELECT *, CAST((length(sequence) - length(replace(sequence, pattern, ''))) // length(pattern) AS BIGINT) AS n_matches,
        length(substr(sequence, 1, instr(sequence, pattern) - 1))
          - length(replace(substr(sequence, 1, instr(sequence, pattern) - 1), '<', '')) + 1 AS first
      FROM seq JOIN rules ON contains(sequence, pattern))
"""


@query("op5_licence_scan", OP5_SQL)
def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence rules that match in every document."""
    return scan(read(spark, sf_dir, "documents"))
