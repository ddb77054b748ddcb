"""Operator 6: licence scans by canonical digest lookup.

A text is made canonical (case, punctuation, copyright lines, equivalent spellings) and its
SHA-256 is joined with the digests of known licence texts. The whole document is looked up, and
so is each of its lines and paragraphs, as a notice is often part of a longer text. The known
digests are a small table that is broadcast, so neither texts nor their digests are shuffled.

Known are the full texts in `license_texts` (also without their titles or their advice on how to
apply them), the usual headers, and one-line notices; more come as a table.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table

#: Spellings that mean the same, and what stands for them, after lower-casing.
SPELLINGS = (
    ("©", " copyright "), ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("non-infringement", "noninfringement"),
    ("&", " and "), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("cancelled", "canceled"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("labour", "labor"), ("organisation", "organization"),
    ("practise", "practice"), ("programme", "program"), ("recognise", "recognize"), ("utilisation", "utilization"), ("whilst", "while"), ("per cent", "percent"),
    ("all rights reserved", ""), ("https://", ""), ("http://", ""), ("www.", ""),
)
#: (c) before a year or a placeholder is the sign; (c) elsewhere numbers a clause.
SIGN = (r"\(c\)[ ]*([0-9<\[{])", r" copyright \1")
#: Copyright as a word of a sentence, which may begin a line; what is left begins a copyright line.
SENTENCE = (r"copyright((ed|able|s)\b|[.;)\x22'-]|,[\s]*[a-z]|[\s]+(notices?|laws?|holders?|owners?|ownership|licenses?|statements?|interests?|and|or|in|on|to|of|if|are|the[\s]+(software|library|program)|permissions?|rights?|treaty|treaties|disclaimers?|doctrines?|protection|claims?|line)\b)", r"right of copy\1")
#: A notice that follows a holder's name on a copyright line gets a line of its own.
NAMED = (r"(copyright[^\n]*?[^a-z0-9\n] *)((licensed|released|distributed) under |this [a-z]+ is (licensed|released) under |permission (is hereby granted|to use))", "\\1\n\\2")
LINE = (r"(^|\n)[^a-z0-9\n]*copyright[^\n]*", r"\1")
PUNCTUATION = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f" + "\u00a0\u2000-\u200a\u2010-\u2027]+"
PARAGRAPHS = r"\n[ \n]*\n"

#: One-line notices, by licence.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)
#: Where the terms end and advice on how to apply them begins.
ADVICE = re.compile(r"END OF TERMS AND CONDITIONS\n|ADDENDUM: How to use this License")
#: Known digests that are broadcast (some 100 MB); a longer table is joined by a shuffle.
MOST_BROADCAST = 1_000_000


def known_texts() -> list[tuple[str, str]]:
    """License and text of all that is known, each in all its forms."""
    found = list(NOTICES)
    for path in sorted((Path(__file__).parent / "license_texts").iterdir()):
        name, _, kind = path.stem.partition(" ")
        text = path.read_text(encoding="utf-8")
        found.append((name, text))
        if cut := ADVICE.search(text):
            found += [(name, text[: cut.start()]), (name, text[: cut.end()])]
        title, _, rest = text.partition("\n\n")
        if kind:  # a header is known by its first paragraph, which names the licence
            found.append((name, title))
        elif title.endswith("License"):
            found += [(name, rest), (name, f"The {title} ({name})\n\n{rest}"), (name, f"The {title}\n\n{rest}")]
    return found


def canonical(text: str) -> str:
    """The canonical form of a known text: canonical_lines() joined by a blank."""
    text = text.lower()
    for spelling, to in SPELLINGS:
        text = text.replace(spelling, to)
    for pattern, to in (SIGN, SENTENCE, NAMED, LINE):
        text = re.sub(pattern, to, text)
    return " ".join(re.sub(PUNCTUATION, " ", text).split())


def canonical_lines(texts: DataFrame) -> DataFrame:
    """texts with text made canonical line by line; most texts say nothing of copyright and skip those steps."""
    low = F.lower("text")
    for spelling, to in SPELLINGS:
        low = F.replace(low, F.lit(spelling), F.lit(to))
    texts = texts.withColumn("text", low)
    signed = F.regexp_replace("text", SIGN[0], SIGN[1].replace("\\", "$"))
    texts = texts.withColumn("text", F.when(F.contains("text", F.lit("(c)")), signed).otherwise(F.col("text")))
    named = F.col("text")
    for pattern, to in (SENTENCE, NAMED, LINE):
        named = F.regexp_replace(named, pattern, to.replace("\\", "$"))
    texts = texts.withColumn("text", F.when(F.contains("text", F.lit("copyright")), named).otherwise(F.col("text")))
    return texts.withColumn("text", F.regexp_replace("text", PUNCTUATION, " "))


def on_one_line(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(text, "[ \n]+", " "))


def known_digests(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """license, digest, each digest once; more: license, text. Broadcast if there are few."""
    known = spark.createDataFrame([(name, hashlib.sha256(canonical(text).encode()).hexdigest()) for name, text in known_texts()], "license string, digest string")
    few = more is None or more.count() <= MOST_BROADCAST
    if more is not None:
        known = known.unionByName(canonical_lines(more.select("license", "text")).select("license", F.sha2(on_one_line("text").cast("binary"), 256).alias("digest")))
    empty = hashlib.sha256(b"").hexdigest()
    known = known.where(F.col("digest") != empty).groupBy("digest").agg(F.min("license").alias("license"))
    return F.broadcast(known) if few else known


def scanned(docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """doc_id, license (of the whole text, or null), notices (licences of single lines and paragraphs, sorted), one row per document.

    Null and empty texts, and those with nothing but punctuation and copyright lines, have no
    licence. A text known under two licences goes by the name that sorts first. Repeated rows
    each give a row, a null doc_id included; other columns are ignored. Texts are taken whole,
    however long; an empty table gives an empty table.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    lines = canonical_lines(keyed)
    part = lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit"))
    whole = F.array(F.struct(F.lit(True).alias("whole"), on_one_line("text").alias("unit")))
    each = F.transform(F.split("text", "\n"), lambda x: part(F.trim(x)))
    blocks = F.transform(F.filter(F.split("text", PARAGRAPHS), lambda x: F.contains(x, F.lit("\n"))), lambda x: part(on_one_line(x)))
    units = lines.select("doc_id", "row", F.inline(F.array_distinct(F.concat(whole, each, blocks)))).where("unit <> ''")
    digests = units.select("doc_id", "row", "whole", F.sha2(F.col("unit").cast("binary"), 256).alias("digest"))
    met = digests.join(known_digests(docs.sparkSession, more), "digest")
    found = met.groupBy("doc_id", "row").agg(F.min(F.when(F.col("whole"), F.col("license"))).alias("license"), F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("license")))).alias("notices"))
    k, f = keyed.select("doc_id", "row").alias("k"), found.alias("f")
    both = k.join(f, F.col("k.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("k.row") == F.col("f.row")), "left")
    return both.select("k.doc_id", "license", F.array_join(F.coalesce("notices", F.array()), ",").alias("notices"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


#: Texts up to this length stand in the SQL as they are, so that it makes them canonical itself.
SQL_CHARS = 3000
_STEPS = r"""
WITH raw AS (SELECT -1 AS doc_id, license, true AS known, text FROM (VALUES {texts}) t(license, text)
             UNION ALL SELECT doc_id, NULL, false, coalesce(text, '') FROM documents),
spelled AS (SELECT doc_id, license, known, {spelled} AS text FROM raw),
signed AS (SELECT doc_id, license, known, regexp_replace(text, '\(c\)[ ]*([0-9<\[{{])', ' copyright \1', 'g') AS text FROM spelled),
told AS (SELECT doc_id, license, known, regexp_replace(text, 'copyright((ed|able|s)\b|[.;)\x22''-]|,[\s]*[a-z]|[\s]+(notices?|laws?|holders?|owners?|ownership|licenses?|statements?|interests?|and|or|in|on|to|of|if|are|the[\s]+(software|library|program)|permissions?|rights?|treaty|treaties|disclaimers?|doctrines?|protection|claims?|line)\b)', 'right of copy\1', 'g') AS text FROM signed),
named AS (SELECT doc_id, license, known, regexp_replace(text, '(copyright[^\n]*?[^a-z0-9\n] *)((licensed|released|distributed) under |this [a-z]+ is (licensed|released) under |permission (is hereby granted|to use))', concat('\1', chr(10), '\2'), 'g') AS text FROM told),
bare AS (SELECT doc_id, license, known, regexp_replace(text, '(^|\n)[^a-z0-9\n]*copyright[^\n]*', '\1', 'g') AS text FROM named),
plain AS (SELECT doc_id, license, known, regexp_replace(text, '[\x01-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{2010}}-\x{{2027}}]+', ' ', 'g') AS text FROM bare),
known AS (SELECT digest, min(license) AS license FROM (
  SELECT sha256(trim(regexp_replace(text, '[ \n]+', ' ', 'g'))) AS digest, license FROM plain WHERE known
  UNION ALL SELECT * FROM (VALUES {digests}) d(digest, license)) GROUP BY digest),
units AS (
  SELECT doc_id, true AS whole, trim(regexp_replace(text, '[ \n]+', ' ', 'g')) AS unit FROM plain WHERE NOT known
  UNION ALL SELECT doc_id, false, trim(unnest(string_split(text, chr(10)))) FROM plain WHERE NOT known
  UNION ALL SELECT doc_id, false, trim(regexp_replace(block, '[ \n]+', ' ', 'g')) FROM (SELECT doc_id, unnest(string_split_regex(text, '\n[ \n]*\n')) AS block FROM plain WHERE NOT known) WHERE contains(block, chr(10))),
found AS (
  SELECT doc_id, min(license) FILTER (WHERE whole) AS license,
         string_agg(DISTINCT license, ',' ORDER BY license) FILTER (WHERE NOT whole) AS notices
  FROM units JOIN known ON sha256(unit) = digest WHERE unit <> '' GROUP BY doc_id)
SELECT d.doc_id, license, coalesce(notices, '') AS notices FROM documents d LEFT JOIN found USING (doc_id)
"""


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    texts, digests = [], []
    for name, text in known_texts():
        (texts if len(text) <= SQL_CHARS else digests).append((name, text))
    spelled = "lower(text)"
    for spelling, to in SPELLINGS:
        spelled = f"replace({spelled}, '{spelling}', '{to}')"
    return _STEPS.format(spelled=spelled, texts=", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in texts), digests=", ".join(f"('{hashlib.sha256(canonical(t).encode()).hexdigest()}', '{n}')" for n, t in digests))


SQL = _sql()
