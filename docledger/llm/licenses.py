"""License scans: TF-IDF cosine of notices, headers and licence files to templates, then
inheritance by path.

All DataFrame expressions. Units of a file are its lines and its blocks (adjacent lines,
comment marks taken off), as far as they hold a licence word; equal units are weighed
once. Templates are whole paragraphs as licences and their usual headers have them, and
short notices. A file with a unit near a template has that licence; a file without one
takes that of the licence file in its nearest ancestor directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.sources.workspace import persisted

# Licence texts and the usual notices, paragraph by paragraph.
#: Short notices as people write them, by licence.
NOTICES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Released under the BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0. No copyright reserved."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
)
#: Paragraphs of the headers of source files.
HEADERS = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under "
     "the terms of the GNU Affero General Public License as published by the Free Software "
     "Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not "
     "use this file except in compliance with the License. You may obtain a copy of the License "
     "at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software "
     "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
     "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
     "language governing permissions and limitations under the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under "
     "the terms of the GNU General Public License as published by the Free Software Foundation; "
     "either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under "
     "the terms of the GNU General Public License as published by the Free Software Foundation, "
     "either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under "
     "the terms of the GNU Lesser General Public License as published by the Free Software "
     "Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
     "v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
     "https://mozilla.org/MPL/2.0/."),
)
#: Paragraphs that the text of a licence itself has.
LICENCES = (
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "2. Grant of Copyright License. Subject to the terms and conditions of this "
     "License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, "
     "no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative "
     "Works of, publicly display, publicly perform, sublicense, and distribute the Work and such "
     "Derivative Works in Source or Object form."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without "
     "modification, are permitted provided that the following conditions are met: "
     "1. Redistributions of source code must retain the above copyright notice, this list of "
     "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce "
     "the above copyright notice, this list of conditions and the following disclaimer in the "
     "documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without "
     "modification, are permitted provided that the following conditions are met: "
     "1. Redistributions of source code must retain the above copyright notice, this list of "
     "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce "
     "the above copyright notice, this list of conditions and the following disclaimer in the "
     "documentation and/or other materials provided with the distribution. 3. Neither the name "
     "of the copyright holder nor the names of its contributors may be used to endorse or "
     "promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "3. Neither the name of the copyright holder nor the names of its "
     "contributors may be used to endorse or promote products derived from this software "
     "without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without "
     "modification, are permitted provided that the following conditions are met:"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose "
     "with or without fee is hereby granted, provided that the above copyright notice and this "
     "permission notice appear in all copies."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of "
     "this software and associated documentation files (the \"Software\"), to deal in the "
     "Software without restriction, including without limitation the rights to use, copy, "
     "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
     "permit persons to whom the Software is furnished to do so, subject to the following "
     "conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all "
     "copies or substantial portions of the Software."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including "
     "commercial applications, and to alter it and redistribute it freely, subject to the "
     "following restrictions:"),
)
#: (licence, text, whether only a licence file has it)
TEMPLATES = (*[(a, b, False) for a, b in NOTICES + HEADERS], *[(a, b, True) for a, b in LICENCES])
#: A unit of a file is looked at if it has one of these; so has every template.
ANCHORS = "(?i)licen[cs]|copyright|public domain|permission|redistribution"
#: What opens and what ends a line of comment, with the space around it.
OPENS = "^[ \\t]*(?:/\\*+|\\*+/?|//+|#+|--+|;+|%+|<!--)?[ \\t]*"
ENDS = "[ \\t\\r]*(?:\\*/|-->)?[ \\t\\r]*$"
GAP = "\n[ \\t\\r]*(?:\n[ \\t\\r]*)+"
#: Least cosine of a unit to a template.
NEAR = 0.7
#: A file is a licence file by its name, by a paragraph that only such files have, or if
#: near units hold half its words.
FILE_NAME = "(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"
FILE_SHARE = 0.5


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def _units(files: DataFrame) -> DataFrame:
    """path, version, n_words, kind, place, unit, key: lines and blocks with a licence word."""
    # (?d): only a line feed ends a line.
    bare = F.regexp_replace(F.regexp_replace("text", f"(?md){OPENS}", ""), f"(?md){ENDS}", "")
    hits = files.where(F.col("text").rlike(ANCHORS)).select(
        "path", F.xxhash64("text").alias("version"), F.size(_tokens(F.col("text"))).alias("n_words"),
        bare.alias("bare"))

    def having(parts: Column) -> Column:
        return F.filter(parts, lambda x: x.rlike(ANCHORS))

    kinds = F.create_map(F.lit("line"), having(F.split("bare", "\n")),
                         F.lit("block"), having(F.split("bare", GAP)))
    return hits.select("path", "version", "n_words", F.explode(kinds).alias("kind", "units")).select(
        "path", "version", "n_words", "kind", F.posexplode("units").alias("place", "unit")).withColumn(
        "key", F.md5("unit")).distinct()


def _idf(templates: DataFrame, number: int) -> DataFrame:
    """token, idf: ln((1 + N) / (1 + df)) + 1 over the templates."""
    return templates.select("place", F.explode(F.array_distinct("tokens")).alias("token")).groupBy(
        "token").agg((F.log(F.lit(1.0 + number) / (F.count(F.lit(1)) + 1)) + 1).alias("idf"))


def _weighed(tokens: DataFrame, key: str, idf: DataFrame, number: int) -> DataFrame:
    """key, token, w, norm of rows (key, token): a token no template has weighs the most."""
    rare = F.log(F.lit(1.0 + number)) + 1
    counted = tokens.groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf")).join(
        F.broadcast(idf), "token", "left").select(  # as many rows as the templates have tokens
        key, "token", (F.col("tf") * F.coalesce("idf", rare)).alias("w"))
    squares = counted.groupBy(F.col(key).alias("of")).agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return counted.join(squares, F.col(key) == F.col("of")).drop("of")


def _near(spark: SparkSession, units: DataFrame) -> DataFrame:
    """key, license, of_file, score: the nearest template of each distinct unit, if near."""
    number = len(TEMPLATES)
    templates = spark.createDataFrame(
        [(i, *t) for i, t in enumerate(TEMPLATES)],
        "place int, license string, notice string, of_file boolean").withColumn(
        "tokens", _tokens(F.col("notice")))
    idf = _idf(templates, number)
    notices = _weighed(templates.select("place", F.explode("tokens").alias("token")), "place", idf, number)
    notices = notices.join(templates.select("place", "license", "of_file"), "place").select(
        "place", "license", "of_file", "token", F.col("w").alias("notice_w"), F.col("norm").alias("notice_norm"))
    texts = units.select("key", "unit").dropDuplicates(["key"])
    weighed = _weighed(texts.select("key", F.explode(_tokens(F.col("unit"))).alias("token")), "key", idf, number)
    dots = weighed.join(F.broadcast(notices), "token").groupBy("key", "place", "license", "of_file").agg(
        F.round(F.sum(F.col("w") * F.col("notice_w")) / (F.any_value("norm") * F.any_value("notice_norm")), 6)
        .alias("score"))
    best = F.struct("score", "license", "of_file")
    return dots.where(F.col("score") >= NEAR).groupBy("key").agg(F.max(best).alias("best")).select(
        "key", "best.*")


def scanned(files: DataFrame) -> DataFrame:
    """path, own_license, score, license_file, license, inherited_from.

    One row per distinct path. Of several near units the highest score wins, then
    the name of the licence; the same holds for rows that repeat a path. A file
    without near unit has a null own_license and score; its license is that of the
    licence file in its nearest ancestor directory (its own first), whose path is
    inherited_from, or null. Several licence files of a directory: highest score,
    then the first path. Null texts have no units; rows with a null path are left
    out. Other columns are ignored.
    """
    files = files.where("path IS NOT NULL").select("path", "text")
    units = persisted(_units(files), "units")
    found = units.join(_near(files.sparkSession, units), "key").groupBy("path", "version", "kind").agg(
        F.max(F.struct("score", "license")).alias("best"), F.max("of_file").alias("of_file"),
        F.sum(F.size(_tokens(F.col("unit")))).alias("near_words"),
        F.any_value("n_words").alias("n_words"))
    own = persisted(found.withColumn(
        "license_file", F.col("path").rlike(FILE_NAME) | F.col("of_file")
        | (F.col("near_words") >= FILE_SHARE * F.col("n_words")),
    ).groupBy("path").agg(
        F.max("best").alias("best"), F.max("license_file").alias("license_file")).select(
        "path", F.col("best.license").alias("own_license"), "best.score", "license_file"), "own")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    folders = own.where("license_file").groupBy(folder.alias("folder")).agg(
        F.min_by(F.struct(F.col("own_license").alias("license"), F.col("path").alias("source")),
                 F.struct(-F.col("score"), "path")).alias("given"))
    paths = files.select("path").distinct().join(own, "path", "left")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1),
                        lambda i: F.struct(i.alias("depth"), F.array_join(
                            F.slice(parts, 1, i), "/").alias("folder")))
    given = paths.where("own_license IS NULL").select(
        "path", F.explode(above).alias("a")).select("path", "a.*").join(folders, "folder").groupBy(
        "path").agg(F.max_by("given", "depth").alias("given"))
    return paths.join(given, "path", "left").select(
        "path", "own_license", "score", F.coalesce("license_file", F.lit(False)).alias("license_file"),
        F.coalesce("own_license", "given.license").alias("license"),
        F.col("given.source").alias("inherited_from"))
