"""Licence scans: sparse word n-gram logistic regression over paragraphs, a calibrated unknown class, and comparison with templates.

DataFrame expressions only, training included. The features are the words and word pairs of the templates, so a paragraph with
none of them can't be told from the unknown class and needs no row; all others are scored in full.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import stored, table
from textloom.llm.fingerprints import let

# Notices by which licences are usually declared, and sentences of their published texts, by family. None has more
# words than a window reads on, so long texts are found by several of their sentences.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org licenses LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004",
        "See the License for the specific language governing permissions and limitations under the License",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT) Copyright (c)",
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and or sell copies of the Software",
    ],
    "isc": [
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
        "See accompanying file LICENSE_1_0.txt or copy at boost.org LICENSE_1_0.txt",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under GPL-2.0.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "either version 2 of the License, or at your option any later version",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under GPL-3.0.",
        "either version 3 of the License, or at your option any later version",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "lgpl": ["Licensed under the GNU Lesser General Public License.", "Licensed under LGPL-2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "Licensed under AGPL-3.0.", "SPDX-License-Identifier: AGPL-3.0-or-later", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "bsd": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org MPL 2.0",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "zlib": [
        "SPDX-License-Identifier: Zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal",
        "SPDX-License-Identifier: CC0-1.0",
    ],
}
FAMILIES = [*TEMPLATES, "unknown"]
#: Copies of each template with other words left out, and most paragraphs of the corpus that stand for the unknown class.
COPIES, UNKNOWN = 8, 2000
STEPS, RATE, MOMENTUM, DECAY = 12, 6.0, 0.7, 2e-4
#: Share of the paragraphs that hold no template that may be taken for a licence, and share of a template's features a confirmed paragraph has.
FALSE_SHARE, CONTAINED = 0.001, 0.75
#: Lines of which no template is held, alone or with the lines around them.
APART = "not joined and not held and not covered"


def hashes(text: Column) -> Column:
    """The hashed words of a line in their order; words are runs of letters, digits and dots within numbers, in lower case."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|\p{N}+(?:\.\p{N}+)*)"), F.lit(1)), lambda x: F.xxhash64(x))


def of_hashes(h: Column) -> Column:
    """Distinct words and word pairs of hashed words, which should be a variable."""
    two = F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.array_distinct(F.when(F.size(h) > 1, F.concat(h, two)).otherwise(h))


def grams(text: Column) -> Column:
    """Distinct hashed words and word pairs of a paragraph."""
    return let(hashes(text), of_hashes)


def templates(spark: SparkSession) -> DataFrame:
    """(family, template, text) of the fixed notices."""
    rows = [F.struct(F.lit(f).alias("family"), F.lit(f"{f}/{n}").alias("template"), F.lit(t).alias("text")) for f, ts in TEMPLATES.items() for n, t in enumerate(ts)]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, row, at, end, joined, h, held, covered, seen: the lines that have words, and what wrapped notices they are part of.

    Lines are counted from 0; row tells rows that repeat a doc_id apart; h is the line's hash and seen its features. A notice may be
    wrapped at any width, so each line is also read on into the lines after it, as far as a line without words and by as many words
    as the longest template has: a joined row (`at` to `end`) for each such window that holds CONTAINED of a template's features.
    `held` lines hold as much of a template by themselves; `covered` ones stand in a joined row.
    """
    shown = templates(docs.sparkSession).select(F.size(hashes(F.col("text"))).alias("n"), grams(F.col("text")).alias("all")).collect()
    span, least = max(r["n"] for r in shown), min(math.ceil(CONTAINED * len(r["all"])) for r in shown)
    known = sorted({g for r in shown for g in r["all"]})
    every = F.array(*(F.array(*map(F.lit, r["all"])) for r in shown))
    own = lambda h: F.filter(of_hashes(h), lambda g: g.isin(*known))
    holds = lambda seen: F.when(F.size(seen) >= least, F.exists(every, lambda t: F.size(F.array_intersect(seen, t)) >= CONTAINED * F.size(t))).otherwise(False)

    def after(all_of: Column, i: Column) -> Column:
        """The lines after line i, as far as one without words."""
        rest = F.slice(all_of, i + 2, F.lit(span))
        return let(rest, lambda r: let(F.array_position(F.transform(r, lambda x: F.size(x)), F.lit(0)), lambda stop: F.when(stop > 0, F.slice(r, 1, stop.cast("int") - 1)).otherwise(r)))

    def window(h: Column, rest: Column, i: Column) -> Column:
        """(end, seen) if the end of line i with the lines after it holds a template, else null."""
        words = F.concat(F.slice(h, F.greatest(F.size(h) - span, F.lit(0)) + 1, F.lit(span)), F.slice(F.flatten(F.transform(rest, lambda x: F.slice(x, 1, span))), 1, span))
        step = lambda a, x: F.when(a.words < span, F.struct((a.words + F.size(x)).alias("words"), (a.lines + 1).alias("lines"))).otherwise(a)
        end = i + F.aggregate(rest, F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines")), step, lambda a: a.lines)
        return let(let(words, own), lambda seen: F.when(holds(seen), F.struct(end.alias("end"), seen.alias("seen"))))

    def told(lines: Column, all_of: Column) -> Column:
        read_on = lambda h, i: let(after(all_of, i), lambda rest: F.when((F.size(h) > 0) & (F.size(rest) > 0), window(h, rest, i)))
        one = lambda h, i: let(own(h), lambda seen: F.struct(i.alias("at"), (F.size(h) > 0).alias("some"), F.xxhash64(F.get(lines, i)).alias("h"), seen.alias("seen"), holds(seen).alias("held"), read_on(h, i).alias("on")))
        return F.transform(all_of, one)

    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n")
    parts = let(lines, lambda ls: let(F.transform(ls, hashes), lambda hs: told(ls, hs)))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), parts.alias("parts"))
    ons = let(F.filter("parts", lambda x: x.on.isNotNull()), lambda on: F.transform("parts", lambda x: F.struct(x.alias("x"), F.exists(on, lambda o: (o["at"] <= x["at"]) & (o["on"]["end"] >= x["at"])).alias("covered"))))
    rows = rows.select("doc_id", "row", F.explode(ons).alias("part")).where("part.x.some").select("doc_id", "row", "part.x.*", "part.covered")
    line = F.struct(F.col("at").alias("end"), F.lit(False).alias("joined"), "seen")
    both = F.when(F.col("on").isNull(), F.array(line)).otherwise(F.array(line, F.struct(F.col("on.end").alias("end"), F.lit(True).alias("joined"), F.col("on.seen").alias("seen"))))
    return rows.select("doc_id", "row", "at", "h", "held", "covered", F.explode(both).alias("unit")).select("doc_id", "row", "at", "h", "held", "covered", "unit.*")


def examples(rows: DataFrame) -> DataFrame:
    """(example, family, test, grams): templates with words left out by hash, and a bounded sample of paragraphs as the unknown class.

    The sample is of distinct lines, so that copies don't fill it; lines that are held or covered are left out. Every fourth example
    is for calibration only.
    """
    known = templates(rows.sparkSession).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    words = F.filter(F.split("text", " "), lambda w, i: (F.col("copy") == 0) | (F.pmod(F.xxhash64("template", "copy", i), F.lit(6)) != 0))
    known = known.select("family", F.concat_ws("#", "template", "copy").alias("example"), F.array_join(words, " ").alias("text"))
    own = templates(rows.sparkSession).select(F.explode(grams(F.col("text"))).alias("gram")).agg(F.collect_set("gram").alias("vocabulary"))
    known = known.select("example", "family", grams(F.col("text")).alias("grams")).join(F.broadcast(own), F.lit(True)).select("example", "family", F.array_intersect("grams", "vocabulary").alias("grams"))
    lines = rows.where(APART).groupBy("h").agg(F.min("seen").alias("grams")).orderBy("h").limit(UNKNOWN)
    lines = lines.select(F.concat(F.lit("line#"), F.hex("h")).alias("example"), F.lit("unknown").alias("family"), "grams")
    return known.unionByName(lines).withColumn("test", F.pmod(F.xxhash64("example"), F.lit(4)) == 0)


def _softmax(logits: Column) -> Column:
    """Of an array; each part is worked out once."""
    powers = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return let(powers, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total)))


def _sums(column: str) -> Column:
    """Sums of an array's places over a group."""
    return F.array(*(F.sum(F.get(column, F.lit(c))) for c in range(len(FAMILIES))))


def model(spark: SparkSession, weights: dict[int, list[float]]) -> DataFrame:
    """(gram, w) of a few hundred features as a table; gram 0 is the bias."""
    told = json.dumps([{"gram": g, "w": w} for g, w in weights.items()])
    return spark.range(1).select(F.explode(F.from_json(F.lit(told), "array<struct<gram:bigint,w:array<double>>>")).alias("t")).select("t.gram", "t.w")


def trained(rows: DataFrame) -> dict[int, list[float]]:
    """Weights of each feature for each family, 0 being the bias, by full-batch gradient descent with momentum; classes weigh alike.

    Each step joins the bounded set of examples, one partition, with the weights, sums by example, and sums gradients by feature.
    """
    size = rows.where("not test").groupBy("family").agg(F.count("*").alias("size"))
    train = rows.where("not test").join(F.broadcast(size), "family").withColumn("share", F.lit(1.0 / len(FAMILIES)) / F.col("size"))
    number = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")) - 1
    long = stored(train.select("example", number.alias("number"), "share", F.explode(F.concat("grams", F.array(F.lit(0).cast("bigint")))).alias("gram"))).coalesce(1)
    weights = {r["gram"]: [0.0] * len(FAMILIES) for r in long.select("gram").distinct().collect()}
    moves = {g: [0.0] * len(FAMILIES) for g in weights}
    for _ in range(STEPS):
        now = model(rows.sparkSession, weights)
        told = long.join(F.broadcast(now), "gram").groupBy("example", "number", "share").agg(_sums("w").alias("logits")).withColumn("p", _softmax(F.col("logits")))
        wrong = told.select("example", F.transform("p", lambda x, c: (x - F.when(c == F.col("number"), 1.0).otherwise(0.0)) * F.col("share")).alias("wrong"))
        slope = long.join(F.broadcast(wrong), "example").groupBy("gram").agg(_sums("wrong").alias("slope"))
        for r in slope.collect():
            g = r["gram"]
            moves[g] = [MOMENTUM * m - RATE * (d + DECAY * w) for m, d, w in zip(moves[g], r["slope"], weights[g], strict=True)]
            weights[g] = [w + m for w, m in zip(weights[g], moves[g], strict=True)]
    return weights


def scores(rows: DataFrame, weights: dict[int, list[float]], by: list[str]) -> DataFrame:
    """`by` and p (probability of each family) for rows of (by, gram), gram 0 among them."""
    found = rows.join(F.broadcast(model(rows.sparkSession, weights)), "gram").groupBy(*by).agg(_sums("w").alias("logits"))
    return found.select(*by, _softmax(F.col("logits")).alias("p"))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph, family, probability, template, contained of each paragraph that declares a licence.

    A paragraph is a line, or a notice that is wrapped over neighbouring lines; `paragraph` is the line that it begins in, and each
    template's best window, the latest of equal ones, stands for those that overlap it. A paragraph's family is the likeliest but
    unknown; it counts if its probability exceeds that which FALSE_SHARE of all lines that no template is held of exceed (0.5 at
    least), and if it holds CONTAINED of the features of a template of that family; the best such template is named. All lines of
    all texts are scored. Null and empty texts have none; rows that repeat a doc_id are reported each; equal templates tie to the
    first by name; empty tables stay empty; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = stored(paragraphs(docs))
    weights = trained(stored(examples(rows)))
    licence = F.slice("p", 1, len(FAMILIES) - 1)
    key = ["row", "at", "joined"]
    grams_of = rows.select(*key, F.explode(F.concat("seen", F.array(F.lit(0).cast("bigint")))).alias("gram"))
    told = scores(grams_of, weights, key).withColumn("probability", F.array_max(licence))
    family = F.get(F.array(*map(F.lit, FAMILIES)), (F.array_position(licence, F.col("probability")) - 1).cast("int"))
    told = stored(told.select(*key, "probability", family.alias("family")).join(rows.withColumn("apart", F.expr(APART)), key).select("doc_id", *key, "end", "apart", "probability", "family", F.when(F.col("probability") > 0.5, F.col("seen")).alias("seen")))
    least = max(0.5, told.where("apart").agg(F.percentile_approx("probability", 1 - FALSE_SHARE, 1000000)).first()[0] or 0.0)
    told = told.where(F.col("probability") > least)
    shown = F.broadcast(templates(spark).select("family", "template", grams(F.col("text")).alias("all")))
    contained = F.size(F.array_intersect("seen", "all")) / F.size("all")
    ok = told.join(shown, "family").withColumn("contained", contained).where(F.col("contained") >= CONTAINED)
    order = Window.partitionBy("row", "template").orderBy("at", F.desc("joined"))
    better = (F.lead("at").over(order) <= F.col("end")) & (F.lead("contained").over(order) >= F.col("contained"))
    better |= (F.lag("end").over(order) >= F.col("at")) & (F.lag("contained").over(order) > F.col("contained"))
    # a window that ends within a notice may hold most of a template that is much like the notice's own
    most = 2 * max(len(t.split()) for ts in TEMPLATES.values() for t in ts)
    near = F.collect_list(F.struct("at", "contained", "all")).over(Window.partitionBy("row").orderBy("at").rangeBetween(0, most))
    like = lambda x: (x["at"] <= F.col("end")) & (x["contained"] > F.col("contained")) & (F.size(F.array_intersect("all", x["all"])) >= CONTAINED * F.size("all"))
    ok = ok.withColumn("better", F.coalesce(better, F.lit(False)) | F.exists(near, like)).where("not (joined and better)")
    top = F.max(F.struct("contained", F.col("template"))).alias("t")
    out = ok.groupBy("doc_id", "row", "at", "joined", "family", "probability").agg(top)
    return out.select("doc_id", F.col("at").alias("paragraph"), "family", "probability", F.col("t.template").alias("template"), F.col("t.contained").alias("contained"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of documents that declares a licence."""
    return scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
