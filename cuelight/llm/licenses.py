"""License scans on DataFrame functions alone.

A text is its lower-case words of letters and digits, and its shingles of five words. Texts and templates are cut into overlapping
windows of shingles; windows that agree in a MinHash band make a (document, template) candidate. Candidates are verified exactly: the
part of the template's distinct shingles that the document has must reach the threshold.

Band settings, by window of m shingles (texts step s, templates step 1, b bands of r rows):

* m = 1, s = 1, b = r = 1 for templates under 11 shingles. The window is the shingle, so one common shingle is found for certain.
* m = 8, s = 4, b = 4, r = 2 for longer ones. A document with 80 % of a template's shingles has missing ones in at most one inner edit
  per 25 shingles (an edited word costs five), so it has an unbroken run of m + s - 1 = 11 shingles, or J >= 0.6 with a window at either
  end of the edit. A run of 11 holds a whole aligned window, whose copy is a window of the template, and agrees in every band; at J = 0.6
  a window is found with probability 1 - (1 - 0.36)^4 = 0.83, and several windows meet the template.

The r * b orders of MinHash are one 64-bit hash under different exclusive-or masks. Windows share blocks of s shingles, whose least values
are computed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.tables import registered, table

# License notices in public use, by the name they are reported under.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "This project is licensed under the MIT License",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
           "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
           "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
           "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
           "substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
           "the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                    "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
                    "the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                  "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
                  "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
                  "KIND, either express or implied.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
               "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
               "this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

SHINGLE = 5
#: longest template windowed by single shingles
SHORT = 10
SIZE, STEP, BANDS, ROWS = 8, 4, 4, 2
MASKS = [int.from_bytes(bytes([17 * i + 31] * 8), "big", signed=True) for i in range(1, BANDS * ROWS + 1)]


def _bound(value, use):
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _shingles(text: str):
    """Hashes of the shingles in text order; a text of fewer words is one shingle, a text without words has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    none = F.array().cast("array<bigint>")
    return _bound(F.transform(words, lambda w: F.xxhash64(w)), lambda w: F.when(F.size(w) == 0, none).when(
        F.size(w) < SHINGLE, F.array(F.xxhash64(w))).otherwise(F.transform(
            F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(SHINGLE)]))))


def _bands(mins) -> list:
    """Band keys of a window's least values."""
    return [F.xxhash64(F.lit(b), *[mins[b * ROWS + r] for r in range(ROWS)]) for b in range(BANDS)]


def _masked(mask: int):
    return lambda x: x.bitwiseXOR(F.lit(mask))


def _mins(values) -> list:
    """Least value under each mask."""
    return [F.array_min(F.transform(values, _masked(m))) for m in MASKS]


def template_table(spark, templates: dict[str, str]) -> DataFrame:
    rows = spark.createDataFrame(sorted(templates.items()), "license string, notice string")
    return rows.select("license", _shingles("notice").alias("sh"))


def template_bands(templates: DataFrame) -> DataFrame:
    """``(license, band)`` of the templates: single shingles of short ones, every window of the others."""
    windows = F.transform(F.sequence(F.lit(1), F.size("sh") - (SIZE - 1)), lambda i: F.array(*_bands(_mins(F.slice("sh", i, SIZE)))))
    return templates.select("license", F.explode_outer(
        F.when(F.size("sh") <= SHORT, F.col("sh")).otherwise(F.flatten(windows))).alias("band")).where("band is not null").distinct()


def document_bands(text: str):
    """The band keys of all windows of a text."""
    per = SIZE // STEP

    def of_blocks(b):
        def window(i):
            return F.array(*_bands([F.least(*[F.element_at(b, i + k)[j] for k in range(per)]) for j in range(len(MASKS))]))

        return F.when(F.size(b) < per, F.array().cast("array<bigint>")).otherwise(
            F.flatten(F.transform(F.sequence(F.lit(1), F.size(b) - (per - 1)), window)))

    def of_shingles(s):
        starts = F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1)), F.lit(STEP))
        return F.concat(s, _bound(F.transform(starts, lambda i: _bound(F.slice(s, i, STEP), lambda v: F.array(*_mins(v)))), of_blocks))

    return _bound(_shingles(text), of_shingles)


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8) -> DataFrame:
    """``(doc_id, license, n_template, n_found, containment)``: every license whose template the text holds to the threshold.

    Null, empty and shorter texts have no match unless they are the template's whole text. Repeated rows are reported once per doc_id
    and license, with the most shingles found; rows without a doc_id are reported under a null doc_id. Other columns are ignored.
    The templates are a short list given with the call, so their tables are broadcast.
    """
    spark = docs.sparkSession
    known = template_table(spark, TEMPLATES if templates is None else templates)
    rows = docs.select("doc_id", "text").withColumn("_row", F.struct("doc_id", F.xxhash64("text").alias("t")))
    bands = rows.select("_row", F.explode_outer(document_bands("text")).alias("band"))
    found = bands.join(F.broadcast(template_bands(known)), "band").select("_row", "license").distinct()

    parts = known.select("license", F.array_distinct("sh").alias("ts"))
    found = found.join(F.broadcast(parts), "license").groupBy("_row").agg(F.collect_list(F.struct("license", "ts")).alias("cand"))
    found = found.select(F.col("_row.doc_id").alias("_id"), F.col("_row.t").alias("_t"), "cand")
    keyed = rows.select(F.col("_row.doc_id").alias("_id"), F.col("_row.t").alias("_t"), "text")
    texts = keyed.join(found, keyed["_id"].eqNullSafe(found["_id"]) & (keyed["_t"] == found["_t"]))
    counted = texts.select(keyed["_id"].alias("doc_id"), _bound(F.array_distinct(_shingles("text")), lambda d: F.transform("cand", lambda c: F.struct(
        c["license"].alias("license"), c["ts"].alias("ts"), F.size(F.array_intersect(c["ts"], d)).alias("n")))).alias("c"))
    counted = counted.select("doc_id", F.explode_outer("c").alias("c"))
    counted = counted.select("doc_id", F.col("c.license").alias("license"), F.size("c.ts").cast("long").alias("n_template"),
                             F.col("c.n").cast("long").alias("n_found"))
    counted = counted.groupBy("doc_id", "license", "n_template").agg(F.max("n_found").alias("n_found"))
    share = F.col("n_found") / F.col("n_template")
    return counted.withColumn("containment", share).where(share >= containment)


def _sql() -> str:
    notices = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in TEMPLATES.items())

    def shingles(name, key, text, source):
        leads = ", ".join(f"lead(w, {k}) over d as w{k}" for k in range(1, SHINGLE))
        joined = " || ' ' || ".join(["w", *(f"w{k}" for k in range(1, SHINGLE))])
        return f"""
{name}_words as (select {key}, unnest(ws) as w, generate_subscripts(ws, 1) as i, len(ws) as n
  from (select {key}, regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+') as ws from {source})),
{name}_next as (select *, {leads} from {name}_words window d as (partition by {key} order by i)),
{name} as (
  select distinct {key}, {joined} as sh from {name}_next where w{SHINGLE - 1} is not null
  union all select {key}, string_agg(w, ' ' order by i) as sh from {name}_words where n < {SHINGLE} group by {key})"""

    return f"""
with {shingles("ts", "license", "notice", f"(values {notices}) as t(license, notice)")},
tn as (select license, count(*) as n_template from ts group by license),
{shingles("ds", "doc_id", "text", "documents")}
select doc_id, license, n_template, count(*) as n_found, count(*)::double / n_template as containment
from ds join ts using (sh) join tn using (license) group by doc_id, license, n_template having count(*)::double / n_template >= 0.8e0
"""


@registered("op3_license_scan", _sql())
def op3(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))
