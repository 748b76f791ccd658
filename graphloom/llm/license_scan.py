"""Operator 7: licence recognition by sentences and ordered rules, with built-in functions only.

After German, Manabe and Inoue, "A sentence-matching method for automatic license identification of
source code files" (2010): a text is cut into sentences, each is normalised and replaced by the
number of the known licence sentence it equals (0: unknown), and the sequence of numbers is matched
against rules in a fixed order.  A rule that matches takes its sentences out of the sequence, so a
licence's full text is not reported again for a notice that is part of it.  Known sentences that no
rule takes are counted as left over.  Sentences that are wrapped over lines, as in comments, are put on one
line first (the SQL reads single lines only).

There is no shuffle and no Python: each document is one row from scan to result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: sentences of public licence texts, normalised; a sentence's number is its place from 1
SENTENCES = [
    "released under the mit license",
    "this work is licensed under the gnu general public license version 3",
    "licensed under the apache license version 2 0",
    "licensed under cc by nc 4 0",
    "all rights reserved",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "you may not use this file except in compliance with the license",
    "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "see the license for the specific language governing permissions and limitations under the license",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "see the gnu general public license for more details",
    "this work is licensed under a creative commons attribution 4 0 international license",
    "this is free and unencumbered software released into the public domain",
]
#: Rules in order: (licence, numbers of its sentences in sequence).
RULES = [
    ("MIT-text", (6, 7, 8)),
    ("Apache-2.0-header", (3, 9, 10, 11)),
    ("BSD-3-Clause-text", (13, 14, 15, 16)),
    ("BSD-2-Clause-text", (13, 14, 15)),
    ("GPL-3.0-or-later-header", (17, 18, 19)),
    ("GPL-3.0-or-later", (17,)),
    ("MIT", (1,)),
    ("GPL-3.0", (2,)),
    ("Apache-2.0", (3,)),
    ("CC-BY-NC-4.0", (4,)),
    ("CC-BY-4.0", (20,)),
    ("Unlicense", (21,)),
    ("All-rights-reserved", (5,)),
]
GAP = 2  #: unknown sentences that may stand between two of a rule
#: A text with a known sentence holds one of these words.
HINT = "(?i)(licen|rights reserved|permission|copyright|redistrib|software)"

#: The same for :func:`scan`, which also reads wrapped sentences: single words, at least one for each sentence.
WORDS = "(?i)(licen|reserved|permission|copyright|redistrib|software|warranty)"
#: Real headers that put known sentences into one: (normalised sentence, numbers of the known ones in it).
JOINED = [("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", (3, 9))]
END = "\u0001"  #: marks the place after . ! ? and white space, which a wrapped sentence doesn't go across


def pattern(numbers: tuple[int, ...]) -> str:
    """The rule as a regular expression over a sequence like <0><6><7>."""
    return f"(<0>){{0,{GAP}}}".join(f"<{n}>" for n in numbers)


def normalised(sentence: Column) -> Column:
    """ASCII lower case, with anything but letters and digits as single spaces."""
    lower = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))


def sequence(text: Column) -> Column:
    """Numbers of a text's sentences, as <n><n>...; sentences end at . ! ? before white space and at
    line breaks, and those without a letter or digit don't count."""
    lines = F.split(F.regexp_replace(text, "([.!?])[ \\t\\f\\x0B]+", "$1\n"), "[\\r\\n]+")
    known = F.array(*[F.lit(s) for s in SENTENCES])
    said = F.filter(F.transform(lines, normalised), lambda s: s != "")
    return F.array_join(F.transform(said, lambda s: F.concat(F.lit("<"), F.array_position(known, s).cast("string"), F.lit(">"))), "")


def unwrapped(text: Column) -> Column:
    """The text with every known sentence that line breaks, comment marks or blank lines interrupt on
    one line of its own.  Such a sentence begins a line or follows . ! ? and ends a line or with . ! ?;
    everything else stays, so that one-line notices are read as they stand."""
    text = F.regexp_replace(text, "(?im)^[ \\t]*(dnl|rem)(?=[ \\t])", "")
    text = F.regexp_replace(text, "([.!?])\\s+", f"$1\n{END}")
    for sentence, numbers in JOINED + [(s, (i,)) for i, s in enumerate(SENTENCES, 1)]:
        spelled = f"[^A-Za-z0-9{END}]+".join(sentence.split(" "))
        known = "\n".join(SENTENCES[n - 1] for n in numbers)
        text = F.regexp_replace(text, f"(?i)(^|[\\r\\n{END}])[^A-Za-z0-9\\r\\n{END}]*+{spelled}(?=[^A-Za-z0-9\\r\\n]*+([\\r\\n]|$))", f"\n{known}")
    return text


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, licenses (names of the rules that matched, in rule
    order, comma-joined), n_matches, n_known (known sentences), n_left (those no rule took).

    Null and empty texts match nothing.  A rule may match several times; each match counts.  Null and
    repeated doc_ids, other columns and texts of any length make no difference; an empty table gives
    an empty one.
    """
    text = F.col("text").cast("string")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike(WORDS), sequence(unwrapped(text))).otherwise("").alias("s0"))
    found = found.withColumn("n_known", F.regexp_count("s0", F.lit("<[1-9]")).cast("long"))
    for i, (_, numbers) in enumerate(RULES):
        p = pattern(numbers)
        found = found.withColumn(f"c{i}", F.regexp_count(f"s{i}", F.lit(p)).cast("long")).withColumn(f"s{i + 1}", F.regexp_replace(f"s{i}", p, "<L>"))
    names = F.concat_ws(",", *[F.when(F.col(f"c{i}") > 0, F.lit(name)) for i, (name, _) in enumerate(RULES)])
    matches = sum((F.col(f"c{i}") for i in range(1, len(RULES))), F.col("c0"))
    return found.select("doc_id", names.alias("licenses"), matches.alias("n_matches"), "n_known", F.regexp_count(f"s{len(RULES)}", F.lit("<[1-9]")).cast("long").alias("n_left"))


def scan_sql() -> str:
    """The same over a DuckDB view ``documents``."""
    known = "[" + ", ".join(f"'{s}'" for s in SENTENCES) + "]"
    steps = [
        f"""s AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '{HINT}') THEN array_to_string(list_transform(list_filter(list_transform(
            string_split_regex(regexp_replace(text, '([.!?])[ \\t\\f\\x0B]+', '\\1' || chr(10), 'g'), '[\\r\\n]+'),
            lambda x: trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> ''),
            lambda x: '<' || coalesce(list_position({known}, x), 0) || '>'), '') ELSE '' END AS s0 FROM documents)"""
    ]
    for i, (_, numbers) in enumerate(RULES):
        p = pattern(numbers)
        before = "s" if i == 0 else f"r{i - 1}"
        steps.append(f"r{i} AS (SELECT *, len(regexp_extract_all(s{i}, '{p}')) AS c{i}, regexp_replace(s{i}, '{p}', '<L>', 'g') AS s{i + 1} FROM {before})")
    names = ", ".join(f"CASE WHEN c{i} > 0 THEN '{name}' END" for i, (name, _) in enumerate(RULES))
    return f"""WITH {", ".join(steps)} SELECT doc_id, concat_ws(',', {names}) AS licenses, CAST({" + ".join(f"c{i}" for i in range(len(RULES)))} AS BIGINT) AS n_matches,
        CAST(len(regexp_extract_all(s0, '<[1-9]')) AS BIGINT) AS n_known, CAST(len(regexp_extract_all(s{len(RULES)}, '<[1-9]')) AS BIGINT) AS n_left FROM r{len(RULES) - 1}"""
